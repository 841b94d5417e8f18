from __future__ import annotations

import itertools
import json
import random

import pytest

from skysift.functions import replay
from skysift.operators import correlate, detect
from skysift.plans import rules

EVENTS = [
    (1, 10, "Alpha -x", None, [1, 5], {"p": "a"}, "10.0.0.1"),
    (2, 20, None, 3.0, [], {"p": "b"}, "10.1.0.1"),
    (3, 30, "beta*", 12.0, None, {"p": None}, "2001:db8::1"),
    (4, 40, "ÄRGER\n", 7.0, [7], None, "nonsense"),
]
SCHEMA = "id long, t long, name string, n double, xs array<int>, o struct<p:string>, ip string"


def fire(spark, selection, condition="s"):
    body = {**({"s": selection} if condition == "s" else selection), "condition": condition}
    rs = rules.load(json.dumps({"title": "r", "detection": body}))
    return sorted(r.id for r in detect.evaluate(rs, spark.createDataFrame(EVENTS, SCHEMA), keep=["id"]).collect())


@pytest.mark.parametrize(
    ("selection", "condition", "ids"),
    [
        ({"name": "alpha -X"}, "s", [1]),
        ({"name|cased": "alpha -x"}, "s", []),
        ({"name": "beta\\*"}, "s", [3]),
        ({"name": "*a*"}, "s", [1, 3]),
        ({"name|contains": "ä"}, "s", [4]),
        ({"name": "ärger"}, "s", []),
        ({"name|windash|endswith": "-x"}, "s", [1]),
        ({"n": 7}, "s", [4]),
        ({"n|gt": "6.5"}, "s", [3, 4]),
        ({"n|contains": "2"}, "s", [3]),
        ({"n": None}, "s", [1]),
        ({"name|neq": "beta\\*"}, "s", [1, 4]),
        ({"a": {"name|contains": "a"}}, "not a", [2, 4]),
        ({"a": {"missing": 1}}, "not a", [1, 2, 3, 4]),
        ({"a": {"missing": 1}}, "all of b*", [1, 2, 3, 4]),
        ({"a": {"missing": 1}}, "1 of b*", []),
        ({"xs": 5}, "s", [1]),
        ({"xs[all]|gte": 1}, "s", [1, 4]),
        ({"xs[none]|gte": 6}, "s", [1, 2, 3]),
        ({"xs[all_or_empty]|gte": 6}, "s", [2, 3, 4]),
        ({"xs[-1]": 5}, "s", [1]),
        ({"o.p": ["A", "B"]}, "s", [1, 2]),
        ({"o.p|exists": False}, "s", [3, 4]),
        ({"ip|cidr": "10.0.0.0/16"}, "s", [1]),
        ({"ip|cidr": "2001:db8::/32"}, "s", [3]),
        ({"name|re": "^b.ta"}, "s", [3]),
        (["ALPHA"], "s", [1]),
    ],
)
def test_matchers(spark, selection, condition, ids):
    assert fire(spark, selection, condition) == ids


def test_errors(spark):
    for selection, condition in (({"a": {"x": 1}}, "b"), ({"name|all|contains": "x"}, "s"), ({"name|re": "(?=x)"}, "s")):
        with pytest.raises(ValueError):
            fire(spark, selection, condition)


HITS = "id long, t long, k string, kind string, v double"


def _random(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = [(r.randrange(0, 120), r.choice([None, "x", "y"]), r.choice(["a", "b"]), r.choice([None, 1.0, 2.0, 5.0])) for _ in range(90)]
    return [(i, *x) for i, x in enumerate(sorted(rows, key=lambda x: x[0]))]


CASES = [
    ("event_count", {"gte": 3}, {}), ("value_count", {"gte": 2, "field": "v"}, {}), ("value_sum", {"gte": 6, "field": "v"}, {}), ("value_avg", {"gt": 2, "field": "v"}, {}),
    ("value_median", {"gte": 2, "field": "v"}, {}), ("value_percentile", {"gt": 4, "field": "v", "percentile": 80}, {}), ("temporal", {"gte": 2}, {}), ("temporal_ordered", {"gte": 2}, {}),
    ("event_count", {"gte": 2}, {"window": "tumbling"}), ("event_count", {"gte": 2}, {"gap": "4s"}), ("value_sum", {"gte": 3, "field": "v"}, {"gap": "4s"}), ("temporal", {"gte": 2}, {"window": "tumbling"}),
    ("event_count", {"gte": 2}, {"suppress": "15s"}), ("event_count", {"gte": 3}, {"action": "reset"}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_correlations_equal_sequential_replay(spark, case):
    kind, condition, more = CASES[case]
    attrs = {k: v for k, v in more.items() if k in ("suppress", "action")}
    body = {"type": kind, "rules": ["a", "b"], "group-by": ["k"], "timespan": "20s", "condition": condition, **{k: v for k, v in more.items() if k not in attrs}}
    docs = [{"title": x, "id": x, "detection": {"s": {"kind": x}, "condition": "s"}} for x in "ab"] + [{"title": "c", "id": "c", "correlation": body, "custom_attributes": attrs}]
    rs = rules.load("\n---\n".join(map(json.dumps, docs)))
    rows = _random(case)
    got = sorted((r["__seq"], round(r["value"], 6)) for r in correlate.correlate(rs, spark.createDataFrame(rows, HITS), "t", "id")["c"].collect())
    states, want = {}, []
    for i, t, k, ref, v in rows:
        value = replay.step(rs.correlations[0], states.setdefault(k, replay.State()), t, ref, v, None if v is None else str(int(v)))
        if value is not None:
            want.append((i, round(value, 6)))
    assert got == want


def test_cycles_and_unknown_references():
    def make(**refs):
        docs = [{"title": k, "id": k, "correlation": {"type": "event_count", "rules": v, "timespan": "1m", "condition": {"gte": 1}}} for k, v in refs.items()]
        return rules.load("\n---\n".join(map(json.dumps, docs)))

    with pytest.raises(rules.BadRule):
        correlate.order(make(a=["b"], b=["a"]))
    with pytest.raises(rules.BadRule):
        correlate.order(make(a=["zzz"]))


def test_plan_is_one_scan_and_pushes_plain_leaves(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame(EVENTS, SCHEMA).write.parquet(path)
    rs = rules.load(json.dumps({"title": "r", "detection": {"s": {"n|gt": 5, "name|cased": "x"}, "condition": "s"}}))
    plan = detect.evaluate(rs, spark.read.parquet(path), keep=["id"])._jdf.queryExecution().toString()
    assert "EqualTo(name,x)" in plan and plan.count("FileScan") <= 2 and "xs" not in plan.split("ReadSchema")[-1]


def _fired(spark, kind: str, condition: dict, rows: list[tuple], span: str = "20s"):
    """(engine's, sequential definition's) firings of one correlation over hits (id, t, k, kind, v)."""
    body = {"type": kind, "rules": ["a"], "group-by": ["k"], "timespan": span, "condition": {"field": "v", **condition}}
    docs = [{"title": "a", "id": "a", "detection": {"s": {"kind": "a"}, "condition": "s"}}, {"title": "c", "id": "c", "correlation": body}]
    rs = rules.load("\n---\n".join(map(json.dumps, docs)))
    got = sorted((r["__seq"], r["value"]) for r in correlate.correlate(rs, spark.createDataFrame(rows, HITS), "t", "id")["c"].collect())
    states, want = {}, []
    for i, t, k, _, v in rows:
        value = replay.step(rs.correlations[0], states.setdefault(k, replay.State()), t, "a", v, None)
        if value is not None:
            want.append((i, value))
    return got, want


def test_averages_meet_their_threshold_exactly_whatever_came_before(spark):
    # taken off a running total, the 17.13s left 30.000000000000004 behind
    rows = [(0, 0, "k", "a", 17.13), (1, 1, "k", "a", 17.13), (2, 100, "k", "a", 29.99), (3, 100, "k", "a", 30.01), (4, 101, "k", "a", 30.0)]
    assert _fired(spark, "value_avg", {"gte": 30}, rows)[0] == [(3, 30.0), (4, 30.0)]
    assert _fired(spark, "value_avg", {"gt": 30}, rows)[0] == []


def test_sums_forget_what_has_left_the_window(spark):
    inf = float("inf")
    rows = [(0, 0, "k", "a", 1e16), (1, 1, "k", "a", inf), (2, 2, "k", "a", 1e-30), (3, 22, "k", "a", 1e300), (4, 23, "k", "a", 1.0), (5, 45, "k", "a", 1.0), (6, 46, "k", "a", 2.0), (7, 200, "k", "a", 3e-25)]
    got, want = _fired(spark, "value_sum", {"gt": 0}, rows)
    assert got == want == [(0, 1e16), (1, inf), (2, inf), (3, 1e300), (4, 1e300), (5, 1.0), (6, 3.0), (7, 3e-25)]
    r = random.Random(5)
    rows = [(i, t, r.choice("xy"), "a", r.choice([0.01, 33.33, 1e-25, -2e-22, 7e18, None])) for i, t in enumerate(sorted(r.randrange(300) for _ in range(200)))]
    got, want = _fired(spark, "value_sum", {"neq": 12345}, rows)
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) <= 1e-12 * max(abs(w[1]), 1e-22) or abs(w[1]) > 1e18 and abs(g[1] - w[1]) < 1e5 for g, w in zip(got, want, strict=True))


def test_sums_meet_their_threshold_exactly_in_any_order(spark):
    # as doubles, six times 0.24 and twice 49.28 add up to 99.99999999999997 to 100.00000000000001, by their order
    orders = list(itertools.combinations(range(8), 2))
    rows = [(8 * n + i, 1000 * n + i, "k", "a", 49.28 if i in large else 0.24) for n, large in enumerate(orders) for i in range(8)]
    assert _fired(spark, "value_sum", {"gt": 100}, rows)[0] == []
    assert _fired(spark, "value_sum", {"gte": 100}, rows)[0] == [(8 * n + 7, 100.0) for n in range(len(orders))]


def test_medians_meet_their_threshold_exactly(spark):
    # low + (high - low) / 2 gives 30.000000000000004 for some of these pairs
    pairs = [(i, round(30 - i / 100, 2), round(30 + i / 100, 2)) for i in range(1, 300)]
    rows = [(2 * i + j, 1000 * i + j, "k", "a", v) for i, *vs in pairs for j, v in enumerate(vs)]
    assert _fired(spark, "value_median", {"gt": 30}, rows) == ([], [])
    got, want = _fired(spark, "value_median", {"gte": 30}, rows)
    assert got == want == [(2 * i + 1, 30.0) for i, *_ in pairs]
    huge = [(0, 0, "k", "a", -1.7e308), (1, 1, "k", "a", 1.7e308), (2, 2, "k", "a", float("nan")), (3, 100, "k", "a", None)]
    got, want = _fired(spark, "value_median", {"lte": 0}, huge)
    assert got == want == [(0, -1.7e308), (1, 0.0), (2, 0.0)]
