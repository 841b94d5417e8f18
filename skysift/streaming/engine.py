"""Structured Streaming: detections without state, correlations with keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skysift.functions import replay
from skysift.operators.correlate import hits, prepared
from skysift.operators.detect import evaluate
from skysift.plans.rules import Correlation, RuleSet


def detections(rules: RuleSet, stream: DataFrame, route: bool = False) -> DataFrame:
    """The batch plan on a stream: stateless, append mode."""
    return evaluate(rules, stream, route)


#: Version of exported state.
VERSION = 1


class _Replay(StatefulProcessor):
    """Feeds a group's hits, in (ts, seq) order within a micro-batch, to the sequential definition.

    State goes by event time: a timer, set anew with each hit, drops a group when the watermark has passed the last
    moment at which its window, gap or suppression can matter.
    """

    def __init__(self, c: Correlation, groups: list[str], most: int | None = None):
        self.c, self.groups, self.most = c, groups, most
        self.keep = c.timespan + (c.gap or 0) + (c.suppress or 0) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "entries string, start long, last long, fired long, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s, until = replay.State(), None
        if self.state.exists():
            entries, s.start, s.last, s.fired, until = self.state.get()
            s.entries = json.loads(entries)
        pdf = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        out, number = [], lambda x: None if pd.isna(x) else float(x)
        for r in pdf.itertuples():
            got = replay.step(self.c, s, int(r.ts), r.ref, number(r.number), None if pd.isna(r.distinct) else r.distinct)
            if got is not None:
                out.append((*key, int(r.ts), int(r.seq), got))
        if self.most is not None:
            s.entries = s.entries[-self.most :]
        end = max(1000 * (int(pdf["ts"].max()) + self.keep), until or 0)
        if end != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(end)
        self.state.update((json.dumps(s.entries), s.start, s.last, s.fired, end))
        yield pd.DataFrame(out, columns=[*self.groups, "ts", "seq", "value"])

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        r = next(initialState.itertuples())
        whole = lambda x: None if pd.isna(x) else int(x)
        self.handle.registerTimer(int(r.until))
        self.state.update((r.entries, whole(r.start), whole(r.last), whole(r.fired), int(r.until)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def correlation(c: Correlation, rules: RuleSet, stream: DataFrame, time_field: str | None = None, seq: str | None = None, late: str = "10 minutes", most: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Firings of one correlation over a stream, append mode; the state store must be RocksDB.

    Arrival order is that of micro-batches, then (ts, seq) inside one; seq names a column of the source (an offset, say),
    else a hash of the event orders hits of one second. Rows more than `late` behind the latest event time seen are left
    out, as the watermark says. A state lives until the watermark passes the end of what it can still affect, so replays
    give what the first run gave, whatever the wall clock. A null group key is a group of its own. `most` bounds the
    entries of a group's window, the newest staying, where memory matters more than exact values; by default nothing is
    dropped. `initial`, rows of snapshot(), starts a new query where another left off.
    """
    order = seq or "__order"
    known = stream if seq else stream.withColumn(order, F.xxhash64(*stream.columns))
    found = hits(rules, known, time_field, order)
    df, groups = prepared(c, found, rules)
    keys = groups or ["all"]
    df = df if groups else df.withColumn("all", F.lit(""))
    df = df.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    schema = ", ".join([f"{g} string" for g in keys] + ["ts long", "seq long", "value double"])
    start = None
    if initial is not None:
        if versions := [r[0] for r in initial.select("version").distinct().collect() if r[0] != VERSION]:
            raise ValueError(f"snapshot of version {versions[0]}, not {VERSION}")
        start = initial.select(*(F.col("groups")[i].alias(g) for i, g in enumerate(keys)), "entries", "start", "last", "fired", "until").groupBy(*keys)
    out = df.groupBy(*keys).transformWithStateInPandas(_Replay(c, keys, most), schema, "Append", "EventTime", start)
    return out.select(F.lit(c.key).alias("rule_key"), *(F.col(g).alias(n) for g, n in zip(groups, c.group_by, strict=True)), "ts", "seq", "value")


def snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The open windows of a stopped or running query, from its checkpoint: rows (version, groups array<string>, entries
    JSON, start, last, fired, until). A table of them is an export that correlation(initial=...) imports."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "window").load()
    groups = F.array(*(F.col("key")[f.name].cast("string") for f in state.schema["key"].dataType.fields))
    return state.select(F.lit(VERSION).alias("version"), groups.alias("groups"), "value.*")


def live_windows(spark: SparkSession, checkpoint: str, c: Correlation) -> DataFrame:
    """What each open window holds against its thresholds: rows (groups, n, first, last, value, met)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                entries = json.loads(r.entries)
                value = replay.value(c.type, entries, c.rules, c.percentile, c.expression) if entries else None
                met = value is not None and all(replay.OPS[k](value, v) for k, v in c.predicates)
                out.append((r.groups, len(entries), entries[0][0] if entries else None, entries[-1][0] if entries else None, value, met))
            yield pd.DataFrame(out, columns=["groups", "n", "first", "last", "value", "met"])

    return snapshot(spark, checkpoint).select("groups", "entries").mapInPandas(run, "groups array<string>, n int, first long, last long, value double, met boolean")


def windowed_counts(rules: RuleSet, stream: DataFrame, time_column: str, span: str, late: str, by: list[str]) -> DataFrame:
    """One final count for each rule, key and tumbling window, with a watermark: the cheap mode for counts."""
    found = evaluate(rules, stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, late))
    out = found.groupBy(F.window(time_column, span).alias("w"), "rule_key", *by).agg(F.count("*").alias("n"))
    return out.select("rule_key", *by, F.col("w.start").alias("start"), "n")


def dispatch(stream: DataFrame, sink, checkpoint: str, reload=None):
    """foreachBatch with at-least-once delivery; reload(), if given, returns the rules to use from this batch on."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(df, n, reload() if reload else None)).option("checkpointLocation", checkpoint).start()
