"""Streaming correlations against the sequential definition, micro-batch by micro-batch."""

from __future__ import annotations

import json

import pytest

from skysift.functions import replay
from skysift.plans import rules as R
from skysift.streaming import engine

EVENTS = "ts long, seq long, user string, kind string, amount double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ruleset(kind: str, window: str, **more):
    condition = more.pop("condition", {"gte": 2})
    body = {"type": kind, "rules": more.pop("rules", ["a"]), "group-by": more.pop("group_by", ["user"]), "timespan": "60s", "condition": condition, **({} if window == "sliding" else {"window": window}), **more}
    attributes = more.pop("attributes", {})
    body = {k: v for k, v in body.items() if k != "attributes"}
    docs = [{"title": n, "id": n, "name": n, "detection": {"s": {"kind": n}, "condition": "s"}} for n in ("a", "b")]
    return R.load("\n---\n".join(json.dumps(d) for d in [*docs, {"title": "c", "id": "c", "name": "c", "correlation": body, "custom_attributes": attributes}]))


def batches():
    """Two micro-batches: a late row, a null group, ties of one second, a hit whose window spans the batches."""
    first = [(100, 1, "u", "a", 1.0), (100, 2, "u", "b", 2.0), (130, 3, "v", "a", None), (150, 4, "u", "a", 3.0), (151, 5, None, "a", 1.0), (152, 6, None, "b", 1.0)]
    second = [(158, 7, "u", "b", 9.0), (140, 8, "u", "a", 4.0), (170, 9, "v", "a", 5.0), (171, 10, "v", "a", 5.0), (1000, 11, "u", "a", 1.0), (1001, 12, "u", "a", 2.0)]
    return first, second


def expected(c, wanted):
    out, states = [], {}
    for batch in batches():
        for ts, seq, user, kind, amount in sorted(batch):
            if kind in wanted:
                got = replay.step(c, states.setdefault(user, replay.State()), ts, kind, amount if c.value_fields else None, None)
                if got is not None:
                    out.append((user, ts, seq, got))
    return sorted(out, key=str)


def stream(spark, rs, folder, out, stop_after=None, late="10 minutes"):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    found = engine.correlation(rs.correlations[0], rs, source, "ts", "seq", late)
    q = found.writeStream.outputMode("append").option("checkpointLocation", str(folder / "checkpoint")).format("parquet").option("path", str(out)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def put(folder, n, rows):
    (folder / "in").mkdir(exist_ok=True)
    names = [c.split()[0] for c in EVENTS.split(", ")]
    (folder / "in" / f"{n}.json").write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows))


CASES = [
    ("event_count", "sliding", {}), ("event_count", "tumbling", {}), ("event_count", "session", {"gap": "20s"}), ("event_count", "sliding", {"attributes": {"skysift.action": "reset"}}), ("event_count", "sliding", {"attributes": {"skysift.suppress": "30s"}}),
    ("value_sum", "sliding", {"condition": {"field": "amount", "gte": 5}}), ("temporal", "sliding", {"rules": ["a", "b"]}), ("temporal_ordered", "sliding", {"rules": ["a", "b"]}),
]


@pytest.mark.parametrize(("kind", "window", "more"), CASES)
def test_batches_equal_the_sequential_definition(spark, tmp_path, kind, window, more):
    rs = ruleset(kind, window, **more)
    c = rs.correlations[0]
    # a restart from the checkpoint lies between the two micro-batches
    for n, rows in enumerate(batches()):
        put(tmp_path, n, rows)
        stream(spark, rs, tmp_path, tmp_path / "out")
    got = sorted(((r.user, r.ts, r.seq, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == expected(c, c.rules)
    assert got or kind.startswith("temporal")


def test_state_goes_by_event_time(spark, tmp_path):
    rs = ruleset("event_count", "sliding")
    put(tmp_path, 0, [(100, 1, "u", "a", 1.0)])
    stream(spark, rs, tmp_path, tmp_path / "out", late="1 second")
    put(tmp_path, 1, [(150, 2, "u", "a", 1.0), (5000, 3, "w", "a", 1.0)])
    stream(spark, rs, tmp_path, tmp_path / "out", late="1 second")
    # far behind the watermark: left out, and the state of u is gone
    put(tmp_path, 2, [(160, 4, "u", "a", 1.0), (5001, 5, "w", "a", 1.0)])
    stream(spark, rs, tmp_path, tmp_path / "out", late="1 second")
    assert sorted((r.user, r.ts) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("u", 150), ("w", 5001)]


def test_no_sequence_and_no_group(spark, tmp_path):
    rs = ruleset("event_count", "sliding", group_by=[])
    put(tmp_path, 0, [(100, 1, "u", "a", 1.0), (101, 2, "v", "a", 1.0)])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    source = spark.readStream.schema(EVENTS).json(str(tmp_path / "in"))
    q = engine.correlation(rs.correlations[0], rs, source, "ts").writeStream.format("memory").queryName("lone").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.ts for r in spark.sql("SELECT * FROM lone").collect()] == [101]


def test_snapshot_introspection_and_import(spark, tmp_path):
    rs = ruleset("event_count", "sliding", condition={"gte": 3})
    c = rs.correlations[0]
    put(tmp_path, 0, [(100, 1, "u", "a", 1.0), (101, 2, "u", "a", 1.0), (102, 3, None, "a", 1.0)])
    stream(spark, rs, tmp_path, tmp_path / "out")
    seen = {r.groups[0]: (r.n, r.first, r.last, r.value, r.met) for r in engine.live_windows(spark, str(tmp_path / "checkpoint"), c).collect()}
    assert seen == {"u": (2, 100, 101, 2.0, False), None: (1, 102, 102, 1.0, False)}
    engine.snapshot(spark, str(tmp_path / "checkpoint")).write.parquet(str(tmp_path / "export"))
    other = tmp_path / "other"
    other.mkdir()
    put(other, 0, [(110, 4, "u", "a", 1.0), (111, 5, None, "a", 1.0)])
    source = spark.readStream.schema(EVENTS).json(str(other / "in"))
    found = engine.correlation(c, rs, source, "ts", "seq", initial=spark.read.parquet(str(tmp_path / "export")))
    q = found.writeStream.format("parquet").option("path", str(other / "out")).option("checkpointLocation", str(other / "k")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    assert [(r.user, r.ts, r.value) for r in spark.read.parquet(str(other / "out")).collect()] == [("u", 110, 3.0)]
