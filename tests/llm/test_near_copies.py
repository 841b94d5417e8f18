from __future__ import annotations

import random

from skysift.llm import minhash
from tests.llm import brute
from tests.llm.conftest import rows

SCHEMA = "doc_id long, text string, lang string, component_id string"


def copies(n: int = 90) -> list[tuple]:
    """A group of edited copies, each at a different distance, among unrelated texts, ties, empties and one-word texts."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 16)):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [" ".join(word() for _ in range(r.randrange(1, 60))) for _ in range(60)]
    out += [out[-1], out[-1].upper(), "", None, "one", "ONE", "one two", "a b c d e", "a b c d e f", " \t\n ", "ä b", "x" * 5000]
    out.append(" ".join(word() for _ in range(20_000)))
    return [(i, t, "en", "clash") for i, t in enumerate(out)]


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 16)
    docs = copies()
    got = rows(minhash.near_copies(spark, spark.createDataFrame(docs, SCHEMA).repartition(4), shingle=2))
    assert got == brute.near_copies([(d[0], d[1]) for d in docs])


def test_empty_nulls_and_repeats(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_copies(spark, empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f", None, None), (1, "a b c d e f", None, None), (1, "a b c d e f", None, None), (2, None, None, None)], SCHEMA)
    got = sorted(minhash.near_copies(spark, odd, shingle=2).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(1, 1, True), (1, 1, True), (2, 2, True), (None, 1, False)]
    kept = minhash.keep_one(spark, odd, shingle=2)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2]
    a, b = "a b c d e f", "u v w x y z"
    repeated = spark.createDataFrame([(0, b, "p", "q"), (1, a, "p", "q"), (1, b, "p", "q"), (None, b, "p", "q"), (None, "lone text here", "p", "q"), (None, None, "p", "q"), (None, "", "p", "q")], "doc_id long, text string, __kept string, row string")
    got = minhash.keep_one(spark, repeated, shingle=2)
    assert got.columns == repeated.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(0, b), (1, a), (None, "lone text here"), (None, None), (None, "")], key=str)


def test_signature_is_consistent():
    import numpy as np

    for n in (1, 2, 5, 60, 400, 3000):
        a = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        s = minhash.signature(a)
        assert set(s.tolist()) <= set(a.tolist()) and (s == minhash.signature(a)).all()
