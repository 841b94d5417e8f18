"""Correlations over detection hits, in batch: window functions over (group key; time, arrival).

Hits are ordered by (ts, seq): a hit sees itself and what arrived before, never a later hit of the same second.
Sums and counts over the trailing closed window [t - span, t] are a running total minus the running total of what has
left, so they cost O(1) a row; so do distinct counts. Numbers are totalled as decimals, which subtract without a rest.
Percentiles gather the window's values. Ordered sequences fold the window. Whatever depends on earlier firings (reset) is
replayed sequentially for each group.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.functions import replay
from skysift.functions.fields import Resolver, epoch, number, text
from skysift.operators.detect import evaluate
from skysift.plans import conditions
from skysift.plans.rules import BadRule, Correlation, RuleSet

OPS = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "eq": lambda a, b: a == b, "neq": lambda a, b: a != b}
TIME_FIELDS = ("@timestamp", "timestamp", "EventTime", "TimeCreated", "eventTime", "ts", "time")
SEPARATOR = "\x1f"


def _column(resolver: Resolver, name: str, of) -> Column:
    f = resolver.find(name)
    return F.lit(None) if f is None else of(f)


def hits(rules: RuleSet, events: DataFrame, time_field: str | None = None, seq: str | None = None, route: bool = False) -> DataFrame:
    """Detection hits with __ts (epoch seconds) and __seq (arrival order). Events without a time are left out."""
    resolver = Resolver(events.schema)
    name = time_field or next((t for t in TIME_FIELDS if resolver.find(t) is not None), None)
    if name is None or resolver.find(name) is None:
        raise BadRule("events have no time field")
    order = F.col(seq).cast("long") if seq else F.monotonically_increasing_id()
    timed = events.withColumn("__ts", F.greatest(epoch(resolver.find(name)), F.lit(0).cast("long"))).withColumn("__seq", order).where("__ts IS NOT NULL")
    return evaluate(rules, timed, route)


def _key_of(rules: RuleSet, ref: str) -> list[str]:
    found = [r.key for r in rules.rules if ref in (r.id, r.name, r.title)]
    return found or [c.key for c in rules.correlations if ref in (c.id, c.name, c.title)]


def order(rules: RuleSet) -> list[Correlation]:
    """Correlations so that each comes after those it refers to; unknown references and cycles are errors."""
    by = {c.key: c for c in rules.correlations}
    state: dict[str, int] = {}
    out: list[Correlation] = []

    def visit(c: Correlation, depth: int) -> None:
        if state.get(c.key) == 1:
            raise BadRule(f"correlation {c.key!r} refers to itself")
        if depth > 10:
            raise BadRule("correlations are chained more than 10 deep")
        if state.get(c.key) == 2:
            return
        state[c.key] = 1
        for ref in c.rules:
            keys = _key_of(rules, ref)
            if not keys:
                raise BadRule(f"{c.key!r} refers to unknown rule {ref!r}")
            for k in keys:
                if k in by:
                    visit(by[k], depth + 1)
        state[c.key] = 2
        out.append(c)

    for c in rules.correlations:
        visit(c, 0)
    return out


def prepared(c: Correlation, found: DataFrame, rules: RuleSet) -> tuple[DataFrame, list[str]]:
    """Hits of the referenced rules as (ts, seq, ref, number, distinct, g0...): references canonical, aliases resolved."""
    resolver = Resolver(found.schema)
    refs = {k: r for r in c.rules for k in _key_of(rules, r)}
    ref = reduce(lambda a, kv: a.when(F.col("rule_key") == kv[0], F.lit(kv[1])), list(refs.items())[1:], F.when(F.col("rule_key") == next(iter(refs)), F.lit(refs[next(iter(refs))])))

    def group(name: str) -> Column:
        if name in c.aliases:
            parts = [F.when(F.col("rule_key") == k, _column(resolver, f, text)) for r, f in c.aliases[name].items() for k in _key_of(rules, r)]
            return F.coalesce(*parts).cast("string")
        return _column(resolver, name, text).cast("string")

    num = _column(resolver, c.value_fields[0], number).cast("double") if c.value_fields else F.lit(None).cast("double")
    distinct = F.lit(None).cast("string")
    if c.value_fields:
        parts = [_column(resolver, n, text).cast("string") for n in c.value_fields]
        distinct = F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws(SEPARATOR, *parts))
    names = [f"g{i}" for i in range(len(c.group_by))]
    out = found.where(F.col("rule_key").isin(list(refs))).select(F.col("__ts").alias("ts"), F.col("__seq").alias("seq"), ref.alias("ref"), num.alias("number"), distinct.alias("distinct"), *(group(g).alias(n) for g, n in zip(c.group_by, names, strict=True)))
    return out, names


def _sessions(df: DataFrame, part: list[Column], c: Correlation) -> DataFrame:
    """Adds sid. Gaps split by LAG and a running sum; only runs longer than the cap are folded."""
    w = Window.partitionBy(*part).orderBy("ts", "seq")
    gapped = df.withColumn("__new", F.when(F.col("ts") - F.lag("ts").over(w) > c.gap, 1).otherwise(0)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*part, "__run")
    marked = gapped.withColumn("__long", F.max("ts").over(run) - F.min("ts").over(run) > c.timespan).withColumn("__t0", F.min("ts").over(run))
    starts = marked.where("__long").groupBy(*part, "__run").agg(F.array_sort(F.collect_set("ts")).alias("times"))
    folded = F.aggregate(
        "times", F.struct(F.lit(None).cast("long").alias("start"), F.array().cast("array<bigint>").alias("all")),
        lambda s, t: F.when(s["start"].isNull() | (t - s["start"] > c.timespan), F.struct(t.alias("start"), F.concat(s["all"], F.array(t)).alias("all"))).otherwise(s), lambda s: s["all"],
    )
    names = [f"__k{i}" for i in range(len(part))]
    starts = starts.select(*(p.alias(n) for p, n in zip(part, names, strict=True)), F.col("__run").alias("__r"), folded.alias("__starts"))
    on = reduce(lambda a, b: a & b, [p.eqNullSafe(F.col(n)) for p, n in zip(part, names, strict=True)], F.col("__run") == F.col("__r"))
    joined = marked.join(starts, on, "left").drop("__r", *names)
    own = F.aggregate("__starts", F.lit(None).cast("long"), lambda s, t: F.when(t <= F.col("ts"), t).otherwise(s))
    return joined.withColumn("sid", F.coalesce(own, F.col("__t0"))).drop("__new", "__run", "__long", "__t0", "__starts")


def aggregated(c: Correlation, df: DataFrame, groups: list[str]) -> DataFrame:
    """Adds `value`: the aggregate of the window as each hit arrives; null where it has none."""
    part: list[Column] = [F.col(g) for g in groups] or [F.lit(0)]
    if c.window == "tumbling":
        df = df.withColumn("sid", F.col("ts") - F.pmod(F.col("ts"), F.lit(c.timespan)))
        part = [*part, F.col("sid")]
    elif c.window == "session":
        df = _sessions(df, part, c)
        part = [*part, F.col("sid")]
    running = Window.partitionBy(*part).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    sliding = c.window == "sliding"
    left = Window.partitionBy(*part).orderBy("ts").rangeBetween(Window.unboundedPreceding, -(c.timespan + 1))
    within = Window.partitionBy(*part).orderBy("ts").rangeBetween(-c.timespan, 0)

    def total(x: Column) -> Column:
        now = F.coalesce(x.over(running), F.lit(0))
        return now - F.coalesce(x.over(left), F.lit(0)) if sliding else now

    def gathered(x: Column) -> Column:
        """The window's values that have arrived, as an array of structs."""
        one = F.struct("ts", "seq", x.alias("x"))
        if not sliding:
            return F.collect_list(F.when(x.isNotNull(), one)).over(running)
        # same-second hits that arrive later are in the range frame but not in the window
        return F.filter(F.collect_list(F.when(x.isNotNull(), one)).over(within), lambda e: (e["ts"] < F.col("ts")) | (e["seq"] <= F.col("seq")))

    def summed(df: DataFrame) -> DataFrame:
        """Adds __s, the sum of the window's numbers: exact in decimals, so that it meets a threshold or doesn't whatever
        came before. Numbers no decimal(27,18) holds (huge, tiny, infinite, NaN) are added as doubles and never taken
        off again: time is cut into blocks of span + 1, and a window is the end of one block and the start of the next."""
        exact = F.col("number").try_cast("decimal(27,18)")
        df = df.withColumn("__x", F.when(exact.cast("double") == F.col("number"), exact))
        df = df.withColumn("__s", total(F.sum("__x")).cast("double")).withColumn("__w", F.when(F.col("__x").isNull(), F.col("number")))
        if not sliding:
            return df.withColumn("__s", F.col("__s") + total(F.sum("__w"))).drop("__x", "__w")
        size = c.timespan + 1
        block = [*part, F.col("__b")]
        df = df.withColumn("__b", F.col("ts") - F.pmod(F.col("ts"), F.lit(size)))
        df = df.withColumn("__now", F.sum("__w").over(Window.partitionBy(*block).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)))
        df = df.withColumn("__all", F.sum("__w").over(Window.partitionBy(*block)))
        df = df.withColumn("__later", F.sum("__w").over(Window.partitionBy(*block).orderBy(F.desc("ts")).rangeBetween(Window.unboundedPreceding, -1)))
        # of the block before: what is later than the last hit to have left, or all of it
        df = df.withColumn("__gone", F.last(F.struct("__b", "__later")).over(left))
        df = df.withColumn("__past", F.last(F.struct("__b", "__all")).over(Window.partitionBy(*part).orderBy("__b").rangeBetween(Window.unboundedPreceding, -size)))
        before = F.col("__b") - size
        kept = F.when(F.col("__gone.__b") == before, F.col("__gone.__later")).when(F.col("__past.__b") == before, F.col("__past.__all"))
        df = df.withColumn("__s", F.col("__s") + (F.coalesce(kept, F.lit(0.0)) + F.coalesce("__now", F.lit(0.0))))
        return df.drop("__x", "__w", "__b", "__now", "__all", "__later", "__gone", "__past")

    finite = F.when(~F.isnan("number") & (F.abs("number") < float("inf")), F.col("number"))
    if c.type == "event_count":
        value = total(F.count(F.lit(1))).cast("double")
    elif c.type == "value_sum":
        df, value = summed(df), F.col("__s")
    elif c.type == "value_avg":
        df = summed(df.withColumn("__n", total(F.count("number"))))
        value = F.when(F.col("__n") > 0, F.col("__s") / F.col("__n")).otherwise(0.0)
    elif c.type == "value_count":
        # a value counts from a hit with no earlier one in reach until it has left unreplaced: O(1) a row, nothing gathered
        same = Window.partitionBy(*part, "distinct").orderBy("ts", "seq")
        far = lambda gap: gap.isNull() | (gap > c.timespan) if sliding else gap.isNull()
        here = F.col("distinct").isNotNull()
        df = df.withColumn("__s", F.when(here & far(F.col("ts") - F.lag("ts").over(same)), 1).otherwise(0))
        df = df.withColumn("__n", F.when(here & far(F.lead("ts").over(same) - F.col("ts")), 1).otherwise(0))
        value = (F.sum("__s").over(running) - (F.coalesce(F.sum("__n").over(left), F.lit(0)) if sliding else F.lit(0))).cast("double")
    elif c.type in ("value_percentile", "value_median"):
        # bound by a lambda, a value is computed once; as a column it is inlined wherever it is mentioned
        once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

        def at_rank(v: Column) -> Column:
            rank = F.lit((c.percentile if c.type == "value_percentile" else 50.0) / 100) * (F.size(v) - 1)
            ends = F.struct(F.get(v, F.floor(rank).cast("int")).alias("low"), F.get(v, F.ceil(rank).cast("int")).alias("high"), (rank - F.floor(rank)).alias("part"))
            return once(ends, lambda e: reduce(lambda plain, rest: plain + F.nanvl(rest, F.lit(0.0)), replay.between(e["low"], e["high"], e["part"])))

        value = once(F.sort_array(F.transform(gathered(finite), lambda e: e["x"])), lambda v: F.when(F.size(v) > 0, at_rank(v)))
    elif c.type == "temporal":
        last = [F.max(F.when(F.col("ref") == r, F.col("ts"))).over(running) for r in c.rules]
        for i, x in enumerate(last):
            df = df.withColumn(f"__f{i}", F.coalesce(x >= F.col("ts") - c.timespan if sliding else x.isNotNull(), F.lit(False)))
        flags = {r: F.col(f"__f{i}") for i, r in enumerate(c.rules)}
        value = reduce(lambda a, b: a + b, [f.cast("int") for f in flags.values()]).cast("double")
        if c.expression:
            both = lambda op: lambda xs: reduce(op, xs)
            ok = conditions.fold(conditions.parse(c.expression), c.rules, lambda n: flags[n], lambda x: ~x, both(lambda a, b: a & b), both(lambda a, b: a | b), lambda xs, n: reduce(lambda a, b: a + b, [x.cast("int") for x in xs]) >= n)
            value = F.when(ok, value)
    else:
        stage = reduce(lambda a, ir: a.when(F.col("ref") == ir[1], ir[0]), list(enumerate(c.rules))[1:], F.when(F.col("ref") == c.rules[0], 0))
        events = F.array_sort(F.transform(gathered(stage.cast("int")), lambda e: F.struct(e["ts"].alias("ts"), e["x"].alias("x"))))
        reached = F.aggregate(events, F.lit(0), lambda p, e: F.when(e["x"] == p, p + 1).otherwise(p))
        value = F.when(reached == len(c.rules), float(len(c.rules))).otherwise(0.0)
    return df.withColumn("value", value).drop("__s", "__n", *(f"__f{i}" for i in range(len(c.rules))))


def _suppressed(c: Correlation, fired: DataFrame, groups: list[str]) -> DataFrame:
    """Greedy muting: after a firing at t, none before t + suppress. Folds the firing times of each group, in the JVM."""
    part = [F.col(g) for g in groups] or [F.lit(0)]
    times = fired.groupBy(*(p.alias(f"__k{i}") for i, p in enumerate(part))).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "value"))).alias("all"))
    empty = F.array().cast("array<struct<ts:bigint,seq:bigint,value:double>>")
    kept = F.aggregate(
        "all", F.struct(F.lit(None).cast("long").alias("last"), empty.alias("out")),
        lambda s, x: F.when(s["last"].isNull() | (x["ts"] >= s["last"] + c.suppress), F.struct(x["ts"].alias("last"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s), lambda s: s["out"],
    )
    named = [F.col(f"__k{i}").alias(g) for i, g in enumerate(groups)]
    return times.select(*named, F.explode_outer(kept).alias("x")).where("x IS NOT NULL").select(*groups, "x.ts", "x.seq", "x.value")


def _replayed(c: Correlation, df: DataFrame, groups: list[str]) -> DataFrame:
    schema = T.StructType([df.schema[g] for g in groups] + [T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("value", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = replay.State(), []
        key = [pdf[g].iloc[0] for g in groups]
        for r in pdf.sort_values(["ts", "seq"]).itertuples():
            got = replay.step(c, s, int(r.ts), r.ref, None if pd.isna(r.number) else float(r.number), None if pd.isna(r.distinct) else r.distinct)
            if got is not None:
                out.append((*key, int(r.ts), int(r.seq), got))
        return pd.DataFrame(out, columns=[f.name for f in schema])

    keys = [F.col(g) for g in groups] or [F.lit(0)]
    return df.groupBy(*keys).applyInPandas(run, schema)


def fire(c: Correlation, found: DataFrame, rules: RuleSet) -> DataFrame:
    """Rows (correlation_key, title, level, ts, seq, value, <group fields>): one for each firing."""
    df, groups = prepared(c, found, rules)
    if c.action == "reset":
        out = _replayed(c, df, groups)
    else:
        out = aggregated(c, df, groups).where(F.col("value").isNotNull())
        for k, v in c.predicates:
            out = out.where(OPS[k](F.col("value"), F.lit(v)))
        if c.suppress is not None:
            out = _suppressed(c, out, groups)
    return out.select(F.lit(c.key).alias("rule_key"), F.lit(c.title).alias("rule_title"), F.lit(c.id).cast("string").alias("rule_id"), F.lit(c.level).cast("string").alias("level"), F.array(*map(F.lit, c.tags)).cast("array<string>").alias("tags"), F.lit(c.type).alias("correlation_type"), F.col("ts").alias("__ts"), F.col("seq").alias("__seq"), "value", *(F.col(g).alias(n) for g, n in zip(groups, c.group_by, strict=True)))


def correlate(rules: RuleSet, events: DataFrame, time_field: str | None = None, seq: str | None = None, route: bool = False) -> dict[str, DataFrame]:
    """Correlation key -> its firings. Chained correlations read the firings of those they refer to."""
    base = hits(rules, events, time_field, seq, route) if rules.rules else None
    fired: dict[str, DataFrame] = {}
    for c in order(rules):
        parents = [fired[k] for r in c.rules for k in _key_of(rules, r) if k in fired]
        own = any(k not in fired for r in c.rules for k in _key_of(rules, r))
        sources = ([base] if own else []) + parents
        fired[c.key] = fire(c, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources), rules)
    return fired


def detections_kept(rules: RuleSet, found: DataFrame) -> DataFrame:
    """Detections without those of rules that only feed correlations (generate: false)."""
    hidden = {k for c in rules.correlations if not c.generate for r in c.rules for k in _key_of(rules, r)}
    return found.where(~F.col("rule_key").isin(sorted(hidden))) if hidden else found


def with_events(c: Correlation, found: DataFrame, rules: RuleSet, id_field: str, limit: int = 10, full: bool = False) -> DataFrame:
    """Firings of a sliding correlation with event_refs: the last `limit` contributing events (timestamp, id), with full
    also the events themselves (event, a struct of all columns). Only `limit` rows are looked back at."""
    resolver = Resolver(found.schema)
    known = [x for x in found.columns if not x.startswith("__")]
    ids = found.select(F.col("__seq").alias("__s"), text(resolver.find(id_field)).alias("eid"), *([F.struct(*known).alias("event")] if full else [])).dropDuplicates(["__s"])
    df, groups = prepared(c, found, rules)
    df = df.join(ids, F.col("seq") == F.col("__s")).drop("__s")
    part = [F.col(g) for g in groups] or [F.lit(0)]
    last = Window.partitionBy(*part).orderBy("ts", "seq").rowsBetween(1 - limit, 0)
    near = F.filter(F.collect_list(F.struct(F.col("ts").alias("timestamp"), F.col("eid").alias("id"), *(["event"] if full else []))).over(last), lambda e: e["timestamp"] >= F.col("ts") - c.timespan)
    out = aggregated(c, df.withColumn("event_refs", near), groups)
    for k, v in c.predicates:
        out = out.where(OPS[k](F.col("value"), F.lit(v)))
    return out.select("ts", "seq", "value", *(F.col(g).alias(n) for g, n in zip(groups, c.group_by, strict=True)), "event_refs")
