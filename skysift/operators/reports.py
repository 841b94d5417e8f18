"""Rule quality: backtests, coverage, scorecards, hygiene, visibility, drafting and tuning rules from examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.operators.detect import evaluate
from skysift.plans.rules import Detection, RuleSet


def fire_counts(rules: RuleSet, df: DataFrame, corpus: str) -> DataFrame:
    """Rows (corpus, rule_key, fires)."""
    return evaluate(rules, df, keep=[corpus]).groupBy(F.col(corpus).alias("corpus"), "rule_key").agg(F.count("*").alias("fires"))


def backtest(counts: DataFrame, expectations: DataFrame, unexpected: str = "warn") -> DataFrame:
    """Expectations (rule_key, corpus or null for all, at_least, at_most, exactly) against fire counts: rows with passed and verdict."""
    total = counts.groupBy("rule_key").agg(F.sum("fires").alias("all_fires"))
    e = expectations.join(counts.withColumnRenamed("rule_key", "rk").withColumnRenamed("corpus", "ck"), (F.col("rule_key") == F.col("rk")) & (F.col("corpus") == F.col("ck")), "full_outer")
    e = e.withColumn("rule_key2", F.coalesce("rule_key", "rk")).join(total.withColumnRenamed("rule_key", "tk"), F.col("rule_key2") == F.col("tk"), "left")
    fires = F.when(F.col("rule_key").isNotNull() & F.col("corpus").isNull(), F.coalesce("all_fires", F.lit(0))).otherwise(F.coalesce("fires", F.lit(0)))
    ok = F.coalesce(fires >= F.col("at_least"), F.lit(True)) & F.coalesce(fires <= F.col("at_most"), F.lit(True)) & F.coalesce(fires == F.col("exactly"), F.lit(True))
    verdict = F.when(F.col("rule_key").isNull(), F.lit(unexpected)).when(ok, "pass").otherwise("fail")
    return e.select(F.col("rule_key2").alias("rule_key"), F.coalesce("corpus", "ck").alias("corpus"), fires.alias("fires"), verdict.alias("verdict"))


def rule_table(spark, rules: RuleSet) -> DataFrame:
    """Rules as rows (rule_key, title, level, status, tags, has_id, logsource)."""
    rows = [(r.key, r.title, r.level, r.status, r.tags, r.id is not None, r.logsource, bool(r.raw.get("author")), bool(r.raw.get("description")), bool(r.raw.get("falsepositives"))) for r in rules.rules]
    return spark.createDataFrame(rows, "rule_key string, title string, level string, status string, tags array<string>, has_id boolean, logsource map<string,string>, has_owner boolean, has_description boolean, has_false_positives boolean")


def techniques(table: DataFrame) -> DataFrame:
    """Rows (technique, rule_key) from tags attack.tNNNN[.NNN]."""
    return table.select("rule_key", F.explode_outer("tags").alias("tag")).where(F.lower("tag").rlike(r"^attack\.t\d{4}")).select(F.upper(F.substring("tag", 8, 20)).alias("technique"), "rule_key").distinct()


def coverage(table: DataFrame) -> DataFrame:
    """Rows (technique, n_rules)."""
    return techniques(table).groupBy("technique").agg(F.count("*").alias("n_rules"))


def gaps(covered: DataFrame, targets: DataFrame) -> DataFrame:
    """Target techniques that no rule covers; a covered parent covers its sub-techniques."""
    c = covered.select(F.col("technique").alias("c"))
    return targets.join(c, (F.col("technique") == F.col("c")) | (F.regexp_extract("technique", r"^(T\d+)\.", 1) == F.col("c")), "left_anti")


def scorecard(table: DataFrame, counts: DataFrame, verdicts: DataFrame, covered: DataFrame, noisy: int = 1000, bad: float = 0.5) -> DataFrame:
    """keep, tune or retire for each rule; a rule that alone covers a technique is never retired."""
    sole = covered.where("n_rules = 1")
    only = techniques(table).join(sole, "technique").select(F.col("rule_key").alias("sk")).distinct()
    n = counts.groupBy("rule_key").agg(F.sum("fires").alias("fires"))
    j = table.select("rule_key").join(n, "rule_key", "left").join(verdicts.select(F.col("rule_id").alias("rule_key"), "fp_ratio"), "rule_key", "left").join(only, F.col("rule_key") == F.col("sk"), "left")
    fires, fp = F.coalesce("fires", F.lit(0)), F.coalesce("fp_ratio", F.lit(0.0))
    verdict = F.when((fires == 0) & F.col("sk").isNull(), "retire").when((fp > bad) & (fires > noisy) & F.col("sk").isNull(), "retire").when((fp > bad) | (fires > noisy), "tune").otherwise("keep")
    return j.select("rule_key", fires.alias("fires"), fp.alias("fp_ratio"), F.col("sk").isNotNull().alias("sole_coverage"), verdict.alias("verdict"))


def hygiene(table: DataFrame, counts: DataFrame, noisy: int = 1000) -> DataFrame:
    """Flags of each rule: silent, noisy, untagged, unowned, undocumented, unidentified."""
    n = counts.groupBy("rule_key").agg(F.sum("fires").alias("fires"))
    j = table.join(n, "rule_key", "left").withColumn("fires", F.coalesce("fires", F.lit(0)))
    return j.select("rule_key", (F.col("fires") == 0).alias("silent"), (F.col("fires") > noisy).alias("noisy"), (F.size("tags") == 0).alias("untagged"), (~F.col("has_owner")).alias("unowned"), (~(F.col("has_description") & F.col("has_false_positives"))).alias("undocumented"), (~F.col("has_id")).alias("unidentified"))


def visibility(events: DataFrame, source: str, needs: DataFrame) -> DataFrame:
    """Needs (technique, source) against the sources seen: rows (technique, seen, needed, score)."""
    seen = events.select(F.col(source).alias("s")).distinct()
    j = needs.join(seen, F.col("source") == F.col("s"), "left")
    return j.groupBy("technique").agg(F.count("s").alias("seen"), F.count("*").alias("needed")).withColumn("score", F.col("seen") / F.col("needed"))


def draft(examples: DataFrame, baseline: DataFrame, fields: list[str], stable: float = 0.9, size: int = 4) -> dict:
    """A rule's selection from examples: fields with one stable value there, ranked by how rare it is in the baseline.

    Counts cover all rows of both; one row of aggregates comes to the driver.
    """
    aggregates = [F.max_by(F.struct("v", "n"), F.struct("n", "v")).alias("top")]
    picked = []
    total, base = examples.count(), max(1, baseline.count())
    for f in fields:
        row = examples.groupBy(F.col(f).cast("string").alias("v")).agg(F.count("*").alias("n")).where("v IS NOT NULL").agg(*aggregates).first()
        if row["top"] and row["top"]["n"] >= stable * total:
            rare = 1 - baseline.where(F.col(f).cast("string") == row["top"]["v"]).count() / base
            picked.append((rare * row["top"]["n"] / total, f, row["top"]["v"]))
    chosen = sorted(picked, key=lambda x: (-x[0], x[1]))[:size]
    return {"selection": {f: v for _, f, v in chosen}}


def tune(false: DataFrame, true: DataFrame, fields: list[str], least: float = 0.5) -> dict | None:
    """A filter that removes false positives and no true one: the (field, value) most false rows have and no true row has."""
    best = None
    total = max(1, false.count())
    pairs = lambda df: reduce(DataFrame.union, [df.groupBy(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")).agg(F.count("*").alias("n")) for f in fields]).where("v IS NOT NULL")
    row = pairs(false).join(pairs(true).drop("n"), ["f", "v"], "left_anti").orderBy(F.desc("n"), "f", "v").first()
    if row and row["n"] >= least * total:
        best = {"filter": {row["f"]: row["v"]}, "removes": row["n"] / total}
    return best


def field_catalogue(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """Rows (field, rule_key, used_as, modifiers) of a rule set: fields of detections, of references to other fields, of
    correlations (group, value, alias) and of the output list. One row for each distinct use."""
    rows: set[tuple] = set()

    def walk(d: Detection, key: str) -> None:
        for i in d.items:
            if i.field is not None:
                rows.add((i.field, key, "detection", "|".join(i.modifiers)))
                if "fieldref" in i.modifiers:
                    rows.update((str(v), key, "reference", "fieldref") for v in i.values)
            if i.block:
                walk(i.block, key)
        for x in [*d.any_of, *d.named.values()]:
            walk(x, key)

    for r in rules.rules:
        for d in r.detections.values():
            walk(d, r.key)
        rows.update((f, r.key, "output", "") for f in r.fields)
    for c in rules.correlations:
        rows.update((g, c.key, "group", "") for g in c.group_by if g not in c.aliases)
        rows.update((v, c.key, "value", "") for v in c.value_fields)
        rows.update((f, c.key, "alias", "") for m in c.aliases.values() for f in m.values())
    return spark.createDataFrame(sorted(rows), "field string, rule_key string, used_as string, modifiers string")
