from __future__ import annotations

import pytest

from skysift.functions import graph
from skysift.operators import alerts


def test_a_long_chain_is_one_incident(spark):
    rows = [(i, f"e{i}", f"e{i + 1}") for i in range(150)] + [(200, "x", "y"), (201, "y", "z"), (202, None, None)]
    df = spark.createDataFrame(rows, "id long, host string, user string")
    got = dict(map(tuple, alerts.entity_incidents(df, "id", ["host", "user"]).collect()))
    assert got == {**dict.fromkeys(range(150), 0), 200: 200, 201: 200, 202: 202}


def test_components_with_hubs(spark, monkeypatch):
    import random

    from skysift.functions import graph

    monkeypatch.setattr(graph, "HUB", 3)
    monkeypatch.setattr(graph, "HUBS", 100)
    r = random.Random(2)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(39, 115)] + [(r.randrange(500, 600), r.randrange(500, 600)) for _ in range(60)] + [(7, 7)]
    up = {n: n for e in edges for n in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {n: top(n) for e in edges for n in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("local", [0, 40])
def test_components_of_rounds_and_hubs(spark, monkeypatch, local):
    # as the test above and, in order of their ids, two long chains and a star whose rays are all the smallest or largest
    monkeypatch.setattr(graph, "HUB", 3)
    monkeypatch.setattr(graph, "HUBS", 100)
    monkeypatch.setattr(graph, "LOCAL", local)
    chains = [(i, i + 1) for i in range(1000, 1300)] + [(i + 1, i) for i in range(2000, 2300)]
    stars = [(3500, i) for i in range(3400, 3500)] + [(4000, i) for i in range(4001, 4100)] + [(3500, 3500), (2001, 2000)]
    want = {**dict.fromkeys(range(1000, 1301), 1000), **dict.fromkeys(range(2000, 2301), 2000), **dict.fromkeys(range(3400, 3501), 3400), **dict.fromkeys(range(4000, 4100), 4000)}
    found = graph.components(spark.createDataFrame(chains + stars, "a long, b long")).collect()
    assert len(found) == len(want) and dict(map(tuple, found)) == want
    named = graph.components(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in chains + stars], "a string, b string")).collect()
    assert dict(map(tuple, named)) == {f"n{k}": f"n{v}" for k, v in want.items()}
    assert graph.components(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")).collect() == []


def test_alerts_of_equal_values_are_one_node(spark, monkeypatch):
    edges = []
    monkeypatch.setattr(alerts, "components", lambda e: edges.append(e.count()) or graph.components(e))
    rows = [(i, "h", "u") for i in range(300)] + [(400 + i, "u", "h") for i in range(300)] + [(800, "u", "w"), (801, None, None), (802, "", None)]
    df = spark.createDataFrame(rows, "id long, host string, user string")
    got = dict(map(tuple, alerts.entity_incidents(df, "id", ["host", "user"]).collect()))
    assert got == {**dict.fromkeys([*range(300), *range(400, 700), 800], 0), 801: 801, 802: 802}
    assert edges[0] <= 4


def test_incidents_with_stop_values_ceilings_and_repeated_ids(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "y"), (5, "a", None), (6, "a", None), (7, "c", "z"), (7, "d", "z"), (8, "d", None), (9, "c", None), (None, "c", "b")]
    df = spark.createDataFrame(rows, "id long, host string, user string")
    found = lambda **more: sorted(map(tuple, alerts.entity_incidents(df, "id", ["host", "user"], **more).collect()), key=str)
    ends = [(7, 7), (7, 7), (8, 7), (9, 7), (None, None)]
    assert found() == [*((i, 1) for i in range(1, 7)), *ends]
    assert found(stop=["a"]) == found(ceiling=4) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), *ends]
    plain = df.where("id < 7")
    assert sorted(map(tuple, alerts.entity_incidents(plain, "id", ["host", "user"], ceiling=4).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)]
