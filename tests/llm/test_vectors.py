from __future__ import annotations

import numpy as np
import pytest

from skysift.llm import nn_descent
from tests.llm.conftest import rows

VECTORS = "vec_id long, embedding array<double>"


def exact(x: np.ndarray, least: float = 0.95) -> dict:
    """Links, component and kept of each row by brute force."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= least
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(x)).min(1))
        if (low == root).all():
            break
        root = low
    return {i: (int(linked[i].sum()), int(root[i]), int(root[i]) == i) for i in range(len(x))}


def test_links_between_saturated_lists(spark):
    """Each vector has more nearer neighbours in its subgroup than a list holds, and links to all other subgroups."""
    g = np.random.default_rng(4)
    away = lambda n, size: size * (v := g.standard_normal((n, 64))) / np.linalg.norm(v, axis=1, keepdims=True)
    middle = np.eye(64)[0]
    x = np.concatenate([middle + c + away(10, 0.01) for c in away(60, 0.13)])
    want = exact(x)
    assert all(w == (599, 0, i == 0) for i, w in want.items())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    assert rows(nn_descent.near_vectors(spark, df)) == want


def test_rare_links_are_searched_and_audited(spark, monkeypatch):
    """Isolated pairs close to the threshold among many windows; a small first audit sees none of them."""
    g = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(g.standard_normal((4000, 64)))
    side = g.standard_normal((40, 64))
    side = unit(side - (side * x[:40]).sum(1, keepdims=True) * x[:40])
    c = g.uniform(0.951, 0.955, (40, 1))
    x = np.concatenate([x, c * x[:40] + np.sqrt(1 - c * c) * side])
    want = exact(x)
    assert sum(w[0] for w in want.values()) == 80
    monkeypatch.setattr(nn_descent, "WINDOW", 32)
    monkeypatch.setattr(nn_descent, "AUDIT", 16)
    told = []
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    got = rows(nn_descent.near_vectors(spark, df, told=told.append))
    assert sum(got[i] == want[i] for i in want) >= len(want) - 2
    assert told[-1]["audited"] == 80 and told[-1]["recall"] >= nn_descent.RECALL


def test_failed_audit_raises(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "SEARCHES", 1)
    monkeypatch.setattr(nn_descent, "RECALL", 1.1)
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.01])], VECTORS)
    with pytest.raises(RuntimeError, match="audited links"):
        nn_descent.near_vectors(spark, df)
