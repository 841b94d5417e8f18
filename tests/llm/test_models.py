from __future__ import annotations

import random
from collections import Counter

import numpy as np

from skysift.llm import secrets, toxicity

DOCS = "doc_id long, text string, lang string, score string"


def prose(r: random.Random, bad: bool) -> str:
    w = ["".join(r.choice("aeinorst") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(10, 60))]
    if bad:
        for _ in range(r.randrange(2, 5)):
            w[r.randrange(len(w))] = r.choice(["loser", "scum", "vequ" + r.choice("abcde") + "x"])
    return " ".join(w)


def table(spark, n=300):
    r = random.Random(1)
    data = [(i, prose(r, i % 4 == 0), "en", "clash") for i in range(n)] + [(1000, None, "en", "c"), (1001, "", "en", "c"), (1002, "ok " * 50_000, "en", "c")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(0, n // 2)] + [(None, 1, 1), (7, 1, None), (5000, 0, 1), (8, 1, 1), (8, 1, 1)]
    return spark.createDataFrame(data, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = table(spark)
    got = {r.doc_id: r for r in toxicity.scores(spark, docs, labels).collect()}
    held = range(150, 300)
    assert sum(got[i].is_toxic == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert not got[1000].is_toxic and not got[1001].is_toxic and not got[1002].is_toxic
    clean = toxicity.clean_documents(spark, docs, labels)
    assert clean.columns == docs.columns and {1000, 1001, 1002} <= {r.doc_id for r in clean.collect()}
    assert {r.score for r in clean.where("doc_id < 1000").collect()} == {"clash"}
    twice = docs.union(docs.where("doc_id IN (150, 152)"))
    assert sum(r.doc_id in (150, 152) for r in toxicity.scores(spark, twice, labels).collect()) == 4
    assert toxicity.scores(spark, docs.limit(0), labels).collect() == []
    assert not any(r.is_toxic for r in toxicity.scores(spark, docs, labels.limit(0)).collect())


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(0)
    x = (r.random((600, 4)) < 0.4).astype(float)
    grades = np.clip(x[:, :3].sum(1), 0, 2).astype(int)
    w, cuts = toxicity.fit(x, grades)
    assert cuts[0] < cuts[1] and (w[:3] > w[3] + 1).all()
    model = toxicity.OrdinalModel({}, cuts.tolist())
    assert np.all(np.diff(model.expected(np.array([-1.0, 0.0, 2.0, 9.0]))) > 0)


def test_no_words_no_model():
    assert toxicity.train([(Counter(a=1), 0)]).weights == {}


def test_grades_come_from_labels_where_these_are_graded():
    graded = [(Counter(a=1), 0), (Counter(b=1), 1), (Counter(c=1), 2)]
    assert toxicity.grades_of(graded, ["a"]).tolist() == [0, 1, 2]
    assert toxicity.grades_of([(Counter(a=1), 0), (Counter(b=1), 1), (Counter(b=1, c=1), 1)], ["b", "c"]).tolist() == [0, 1, 2]


def other_findings(n: int, seed: int) -> list:
    """Held-out findings from another generator than the training one: other services, other carriers, other look-alikes."""
    import base64
    import uuid

    r = random.Random(seed)
    noise = lambda k: bytes(r.randrange(256) for _ in range(k))
    b64 = lambda k: base64.urlsafe_b64encode(noise(k)).decode().rstrip("=")
    out = []
    for k in range(n):
        good = [
            ("assigned", b64(21), "export API_KEY="), ("assigned", noise(16).hex(), "config.secret: '"), ("aws_key", "ASIA" + base64.b32encode(noise(10)).decode(), "aws_access_key_id "),
            ("jwt", f"eyJ{b64(24)}.eyJ{b64(60)}.{b64(32)}", "Authorization: Bearer "), ("github", "ghs_" + "".join(c for c in b64(60) if c.isalnum())[:36], "clone with "), ("assigned", b64(9) + "!", "db password = "),
        ]
        bad = [
            ("long", str(uuid.UUID(bytes=noise(16))), "request id "), ("long", noise(20).hex(), "merge commit "), ("long", noise(32).hex(), "sha256: "), ("assigned", "read_from_environment", "token = "), ("assigned", "<your-key-here>", "api_key="),
            ("assigned", "CHANGEME", "password: "), ("long", "some/long/path/with/many/parts/2024", "open "), ("assigned", "PasswordResetTokenView", "token="), ("long", "very-long-article-title-about-things-12", "slug "),
        ]
        out += [(*good[k % len(good)][:2], "app/settings.py", good[k % len(good)][2], "\n", 1), (*bad[k % len(bad)][:2], "app/settings.py", bad[k % len(bad)][2], "\n", 0)]
    return out


def test_secrets_held_out():
    forest = secrets.train()
    held = other_findings(180, seed=77)
    p = forest.predict(np.array([secrets.features(*f[:5]) for f in held], float))
    right = (p >= secrets.ACCEPT) == np.array([f[5] for f in held])
    assert right.mean() >= 0.9


def test_language_counts_equal_brute_force(spark, monkeypatch):
    import re

    texts = ["Abc abc DE-fghij x", None, "", "abc\nabcd éabc 12ab", "z" * 30 + " tail", "q" * 24]
    monkeypatch.setattr(secrets, "SUPPORT", 1)
    got = secrets.language(spark, spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    runs = [w for t in texts for w in re.findall("[a-z]+", (t or "").lower())]
    words = Counter(w for w in runs if 3 <= len(w) <= 24)
    pairs = Counter(a + b for w in runs for a, b in zip(w, w[1:], strict=False))
    assert got == secrets.Language.of(dict(pairs), dict(words))
    # the dictionary covers what it knows, longest first
    assert got.covered("abcd_abc9zz") == (7 / 11, 4)


def test_secrets_spans(spark):
    key = "AKIA" + "Q7W3E9R1T5Y2U8P4"
    docs = spark.createDataFrame([(1, f"é {key} x", "src0", "c"), (2, "password=changeme", "docs/readme", "c"), (3, None, None, None), (4, "", None, None), (5, "word " * 40_000, "a", "b"), (5, f"{key}", "a", "b")], DOCS.replace("lang", "source"))
    got = secrets.scan(spark, docs).collect()
    assert [(r.start, r.end, r.is_secret) for r in got if r.doc_id == 1] == [(2, 22, True)]
    assert [r.is_secret for r in got if r.doc_id == 2] == [False]
    assert {r.doc_id for r in got} == {1, 2, 5}
    assert secrets.scan(spark, docs.limit(0).drop("source")).collect() == []
