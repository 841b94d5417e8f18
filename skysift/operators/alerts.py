"""After detection: scope, enrichment, risk, deduplication, silences, inhibition, incidents, verdicts, OCSF."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.functions.literals import quote
from skysift.functions.graph import components

#: Rows up to which a lookup side is broadcast, as counted.
BROADCAST_ROWS = 100_000
LEVELS = ("informational", "low", "medium", "high", "critical")


def _glob(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)^" + ".*".join(map(quote, pattern.split("*"))) + r"\z")


def scope(df: DataFrame, rules: list[str] = (), tags: list[str] = (), levels: list[str] = ()) -> DataFrame:
    """Alerts of rules by id or title glob, with a tag by prefix (`attack.*`), of a level; empty lists don't restrict."""
    tests = []
    if rules:
        tests.append(reduce(lambda a, b: a | b, [(F.col("rule_id") == r) | _glob(F.col("rule_title"), r) for r in rules]))
    if tags:
        tests.append(F.exists("tags", lambda t: reduce(lambda a, b: a | b, [_glob(t, x) for x in tags])))
    if levels:
        tests.append(F.col("level").isin(list(levels)))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def enrich(alerts: DataFrame, lookup: DataFrame, on: dict[str, str], take: dict[str, str], default: dict[str, object] | None = None) -> DataFrame:
    """Left lookup join: alerts.on-key = lookup.on-value; take maps lookup columns to new names; defaults fill misses.

    The lookup holds one row a key (others are dropped, the smallest kept) and is broadcast only if its counted size allows.
    """
    keys = list(on.values())
    side = lookup.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(*(F.min(c).alias(n) for c, n in take.items()))
    side = F.broadcast(side) if lookup.count() <= BROADCAST_ROWS else side
    out = alerts.join(side, reduce(lambda a, b: a & b, [F.col(a) == F.col(f"__{b}") for a, b in on.items()]), "left").drop(*(f"__{k}" for k in keys))
    return out.fillna(default) if default else out


def render(template: str) -> Column:
    """`${column}` placeholders; nulls are empty."""
    parts = re.split(r"\$\{([^}]+)\}", template)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if n % 2 else F.lit(p) for n, p in enumerate(parts)])


def risk_score(tags: dict[str, float] | None = None, levels: dict[str, float] | None = None, default: float = 0.0, how: str = "max", attribute: str | None = None) -> Column:
    """Score of an alert: its own attribute, else its tags' scores (max or sum; `prefix.*`), else its level's, else the default."""
    found = []
    for t, s in (tags or {}).items():
        found.append(F.when(F.exists("tags", _tag(t)), F.lit(float(s))))
    of_tags = F.lit(None).cast("double")
    if found:
        hits = F.array_compact(F.array(*found))
        of_tags = F.when(F.size(hits) > 0, F.array_max(hits) if how == "max" else F.aggregate(hits, F.lit(0.0), lambda a, b: a + b))
    of_level = F.lit(None).cast("double")
    for k, v in (levels or {}).items():
        of_level = F.when(F.col("level") == k, float(v)).otherwise(of_level)
    own = F.col(attribute).cast("double") if attribute else F.lit(None).cast("double")
    return F.coalesce(own, of_tags, of_level, F.lit(float(default)))


def _tag(pattern: str):
    return lambda x: _glob(x, pattern)


def risk_objects(df: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """One row for each distinct non-null (type, value) object of an alert; selectors map columns to types."""
    objects = F.array_distinct(F.array(*(F.struct(F.lit(t).alias("object_type"), F.col(c).cast("string").alias("object_value")) for c, t in selectors.items())))
    return df.withColumn("__o", F.explode_outer(F.filter(objects, lambda o: o["object_value"].isNotNull()))).where("__o IS NOT NULL").select(*df.columns, "__o.*")


def _mute(df: DataFrame, keys: list[str], ts: str, seq: str, hold: int) -> DataFrame:
    """The first row of each key, then each that is at least hold seconds after the last one kept."""
    rest = [c for c in df.columns if c not in keys]
    one = F.struct(F.col(ts).alias("__t"), F.col(seq).alias("__q"), F.struct(*rest).alias("__row"))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"))
    kind = grouped.schema["all"].dataType.simpleString()
    kept = F.aggregate("all", F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(kind).alias("out")), lambda s, x: F.when(s["last"].isNull() | (x["__t"] >= s["last"] + hold), F.struct(x["__t"].alias("last"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s), lambda s: s["out"])
    return grouped.select(*keys, F.explode_outer(kept).alias("x")).where("x IS NOT NULL").select(*keys, "x.__row.*").select(df.columns)


def risk_incidents(df: DataFrame, window: int, threshold: float | None = None, tactics: int | None = None, cooldown: int = 0, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Rows of risk objects at which an entity's window score or number of distinct tactics reaches its bar.

    The window is (t - window, t]. Adds window_score and window_tactics. Needs object_type, object_value, score and tactics array<string>.
    """
    keys = ["object_type", "object_value"]
    by = Window.partitionBy(*keys)
    rows = by.orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
    gone = by.orderBy(ts).rangeBetween(Window.unboundedPreceding, -window)
    near = by.orderBy(ts).rangeBetween(-window + 1, 0)
    score = F.sum("score").over(rows) - F.coalesce(F.sum("score").over(gone), F.lit(0.0))
    arrived = F.filter(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(seq).alias("q"), "tactics")).over(near), lambda e: (e["t"] < F.col(ts)) | (e["q"] <= F.col(seq)))
    out = df.withColumn("window_score", score).withColumn("window_tactics", F.size(F.array_distinct(F.flatten(F.transform(arrived, lambda e: F.coalesce(e["tactics"], F.array().cast("array<string>")))))))
    tests = ([F.col("window_score") >= threshold] if threshold is not None else []) + ([F.col("window_tactics") >= tactics] if tactics is not None else [])
    out = out.where(reduce(lambda a, b: a | b, tests))
    return _mute(out, keys, ts, seq, cooldown) if cooldown else out


def dedup(df: DataFrame, keys: list[str], resolve: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Alerts of a fingerprint fold into one until it has been quiet for `resolve` seconds: rows (keys, first, last, n)."""
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    run = F.sum(F.when(F.col(ts) - F.lag(ts).over(w) >= resolve, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("n")).drop("__run")


def dedup_records(df: DataFrame, keys: list[str], resolve: int, repeat: int | None = None, ts: str = "ts", seq: str = "seq", until: int | None = None) -> DataFrame:
    """What deduplication sends: rows (keys, at, kind, n). `firing` for the first alert of a run; `repeat` for the first
    alert in each later interval of `repeat` seconds since the run began; `resolved` once it has been quiet for `resolve`
    seconds, unless that lies after `until`. n counts the run's alerts so far."""
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    run = F.sum(F.when(F.col(ts) - F.lag(ts).over(w) >= resolve, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(*keys, "__run").orderBy(ts, seq)
    marked = df.select(*keys, ts, seq).withColumn("__run", run).withColumn("n", F.row_number().over(inside).cast("long")).withColumn("__next", F.lead(ts).over(inside))
    marked = marked.withColumn("__first", F.min(ts).over(Window.partitionBy(*keys, "__run")))
    turn = F.floor((F.col(ts) - F.col("__first")) / (repeat or 1))
    marked = marked.withColumn("__turn", turn).withColumn("__before", F.lag("__turn").over(inside))
    kinds = [F.when(F.col("n") == 1, F.struct(F.col(ts).alias("at"), F.lit("firing").alias("kind")))]
    if repeat:
        kinds.append(F.when(F.col("__turn") > F.col("__before"), F.struct(F.col(ts).alias("at"), F.lit("repeat").alias("kind"))))
    over = F.col("__next").isNull() & (F.lit(True) if until is None else F.col(ts) + resolve <= until)
    kinds.append(F.when(over, F.struct((F.col(ts) + resolve).alias("at"), F.lit("resolved").alias("kind"))))
    return marked.withColumn("__k", F.explode_outer(F.array_compact(F.array(*kinds)))).where("__k IS NOT NULL").select(*keys, "__k.at", "__k.kind", "n")


def staged(df: DataFrame, *, inhibitions: list[dict] = (), silences: list[dict] = (), dedup_keys: list[str] = (), group_keys: list[str] = (), resolve: int = 300, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The alert stages in their order: inhibit, silence, dedup, group. Stages without settings are left out.

    An inhibition is a dict of source and target (columns), equal (keys) and duration. Deduplication keeps the first alert
    of each run; grouping gives incidents of what is left.
    """
    for x in inhibitions:
        df = inhibit(df, x["source"], x["target"], x["equal"], x["duration"], ts, seq)
    df = silence(df, list(silences), ts)
    if dedup_keys:
        w = Window.partitionBy(*dedup_keys).orderBy(ts, seq)
        df = df.withColumn("__gap", F.col(ts) - F.lag(ts).over(w)).where(F.col("__gap").isNull() | (F.col("__gap") >= resolve)).drop("__gap")
    return incidents(df, list(group_keys), resolve, ts, seq) if group_keys else df


def silence(df: DataFrame, silences: list[dict], ts: str = "ts") -> DataFrame:
    """Drops alerts that a silence covers: all its matchers (column -> glob) match and start <= ts < end."""
    tests = [reduce(lambda a, b: a & b, [F.coalesce(_glob(F.col(k).cast("string"), v), F.lit(False)) for k, v in s["match"].items()]) & (F.col(ts) >= s.get("start", 0)) & (F.col(ts) < s.get("end", 2**62)) for s in silences]
    return df.where(~reduce(lambda a, b: a | b, tests)) if tests else df


def inhibit(df: DataFrame, source: Column, target: Column, equal: list[str], duration: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Drops target alerts for which a source alert with equal keys came before, at most `duration` seconds ago.

    A row that is source and target at once doesn't inhibit itself. Exact where no source is itself inhibited.
    """
    w = Window.partitionBy(*equal).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(source, F.col(ts))).over(w)
    return df.withColumn("__src", last).where(~F.coalesce(target & (F.col(ts) - F.col("__src") <= duration), F.lit(False))).drop("__src")


def incidents(df: DataFrame, keys: list[str], resolve: int, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Alerts grouped by keys until quiet for `resolve` seconds: rows (incident_id, keys, first_seen, last_seen, n_alerts, n_rules, max_level)."""
    w = Window.partitionBy(*keys).orderBy(ts, seq)
    run = F.sum(F.when(F.col(ts) - F.lag(ts).over(w) >= resolve, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rank = reduce(lambda a, kv: a.when(F.col("level") == kv[1], kv[0]), list(enumerate(LEVELS))[1:], F.when(F.col("level") == LEVELS[0], 0))
    out = df.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("n_alerts"), F.countDistinct("rule_title").alias("n_rules"), F.max(rank).alias("__l"))
    level = F.get(F.array(*map(F.lit, LEVELS)), F.col("__l"))
    ident = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.col("first_seen").cast("string")), 256)
    return out.select(ident.alias("incident_id"), *keys, "first_seen", "last_seen", "n_alerts", "n_rules", level.alias("max_level"))


def entity_incidents(alerts: DataFrame, alert_id: str, entities: list[str], stop: list[str] = (), ceiling: int | None = None) -> DataFrame:
    """Alerts that share an entity value, directly or through others: rows (alert_id, incident), incident = smallest alert id.

    Stop values link nothing; nor do values of more than `ceiling` alerts. Links are stars, from a value's smallest alert.
    Chains of any length are followed; raises if the components don't settle. Alerts of the same values are one node, their
    smallest: there are as many nodes and links as different sets of values, and the alerts themselves are joined once.
    """
    ident = F.col(alert_id)
    values = F.filter(F.array_distinct(F.array(*(F.col(e).cast("string") for e in entities))), lambda v: v.isNotNull() & ~v.isin(list(stop) or [""]))
    rows = alerts.select(alert_id, F.when(ident.isNotNull(), F.sort_array(values)).alias("values"))
    repeated = not rows.where(ident.isNotNull()).groupBy(alert_id).count().where("count > 1").isEmpty()
    if repeated:  # an alert of several rows has the values of them all
        rows = rows.groupBy(alert_id).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))
    kinds = rows.where(F.size("values") > 0).groupBy("values").agg(F.min(alert_id).alias("a"), F.count("*").alias("n"))
    pairs = kinds.select("a", "n", F.explode("values").alias("v"))
    stars = pairs.groupBy("v").agg(F.min("a").alias("b"), F.sum("n").alias("n"))
    stars = stars.where(F.col("n") <= ceiling) if ceiling else stars
    edges = pairs.drop("n").join(stars.drop("n"), "v").select("a", "b").distinct()
    label = components(edges).toDF("a", "label")
    if ceiling:  # alerts whose values are all above it are alone, whatever they have in common
        kinds = kinds.join(edges.select("a").distinct(), "a", "left_semi")
    kinds = kinds.join(label, "a", "left").select("values", F.coalesce("label", "a").alias("incident"))
    named = rows.join(kinds, "values", "left").select(alert_id, F.coalesce("incident", alert_id).alias("incident"))
    return alerts.select(alert_id).join(named, alert_id, "left") if repeated else named


def dispositions(records: DataFrame, now: int, window: int, benign_counts: bool = False, least: int = 5) -> DataFrame:
    """Rows (rule_id, total, tp, fp, btp, fp_ratio): verdicts of the window, one a dedup key, ratio from `least` on."""
    recent = records.where((F.col("ts") > now - window) & (F.col("ts") <= now)).dropDuplicates(["rule_id", "dedup_key"])
    n = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    out = recent.groupBy("rule_id").agg(F.count("*").alias("total"), n("true_positive").alias("tp"), n("false_positive").alias("fp"), n("benign_true_positive").alias("btp"))
    bad = F.col("fp") + F.col("btp") if benign_counts else F.col("fp")
    return out.withColumn("fp_ratio", F.when(F.col("total") >= least, bad / F.col("total")))


def ocsf(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Alerts as OCSF detection findings (class 2004)."""
    severity = reduce(lambda a, kv: a.when(F.col("level") == kv[1], kv[0] + 1), list(enumerate(LEVELS))[1:], F.when(F.col("level") == LEVELS[0], 1))
    return df.select(F.lit(2004).alias("class_uid"), F.lit(2).alias("category_uid"), F.lit(1).alias("activity_id"), F.lit(200401).alias("type_uid"), (F.col(ts) * 1000).alias("time"), F.coalesce(severity, F.lit(0)).alias("severity_id"), F.struct(F.col("rule_title").alias("title"), F.col("rule_id").alias("uid")).alias("finding_info"), F.filter("tags", lambda t: t.startswith("attack.")).alias("attacks"))
