"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(cut_k - x.w): one weight vector shared by all thresholds, with ordered cut points. Features are
the presence of words that the labelled sample ties to toxicity far beyond chance. The result is the expected grade.

Labels above 1 are grades as they stand. Where labels carry a verdict only, 0 or 1, toxic documents are graded by their
number of distinct associated features: 0 clean, 1 mildly toxic (up to the toxic class's median), 2 severely toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.llm._common import prepare

#: Labelled documents of either class that are fitted at most, words kept, least chi-square of a word, grades.
SAMPLE, WORDS, CHI_SQUARE, GRADES = 2000, 4000, 40.0, 3
#: Lengths of word beginnings that are features.
PREFIXES = (4, 5, 6)
#: Expected grade from which a document is rejected.
REJECT = 0.12
_find = re.compile(r"\w+").findall


def tokens(text: str | None) -> list[str]:
    return _find(text.lower()) if text else []


def features(words: Counter) -> Counter:
    """Words and the beginnings of longer words, with their counts: inflected forms share a beginning."""
    out = Counter(words)
    for w, n in words.items():
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "-"] += n
    return out


@dataclass
class OrdinalModel:
    """Weights of words and the ordered cut points."""

    weights: dict[str, float]
    cuts: list[float]

    def score(self, words: list[str]) -> float:
        """Words of the text -> x.w over the distinct features."""
        known, found = self.weights, set()
        for w in set(words):
            if w in known:
                found.add(w)
            for k in PREFIXES:
                if len(w) > k and (p := w[:k] + "-") in known:
                    found.add(p)
        return sum(known[x] for x in found)

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over thresholds of P(grade > k)."""
        z = scores[:, None] - np.array(self.cuts)[None, :]
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).sum(1)


def select_words(rows: list[tuple[Counter, int]], size: int = WORDS, least: float = CHI_SQUARE) -> list[str]:
    """Words whose presence and toxicity (a grade above 0) depend on each other: chi-square with a bar that chance doesn't reach."""
    toxic = sum(y > 0 for _, y in rows)
    clean = len(rows) - toxic
    if not toxic or not clean:
        return []
    seen = [Counter(), Counter()]
    for words, y in rows:
        seen[y > 0].update(words.keys())
    scored = []
    for w in seen[1]:
        a, b = seen[1][w], seen[0][w]
        c, d = toxic - a, clean - b
        chi = (a * d - b * c) ** 2 * len(rows) / max((a + b) * (c + d) * toxic * clean, 1)
        # only words of the toxic class: a word that marks clean text must not buy off a slur
        if chi >= least and a * clean > b * toxic:
            scored.append((-chi, w))
    return [w for _, w in sorted(scored)[:size]]


def grades_of(rows: list[tuple[Counter, int]], words: list[str]) -> np.ndarray:
    """Severity grades: those of the labels if any is above 1, else 0 for clean and 1 or 2 for toxic by the number of distinct selected features."""
    y = np.array([y for _, y in rows])
    if y.max(initial=0) > 1:
        return np.minimum(y, GRADES - 1)
    chosen = set(words)
    hits = np.array([len(chosen & c.keys()) for c, _ in rows])
    middle = np.median(hits[y > 0]) if (y > 0).any() else 0.0
    return np.where(y > 0, np.where(hits > middle, 2, 1), 0)


def fit(presence: np.ndarray, grades: np.ndarray, n_grades: int = GRADES, rounds: int = 800, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood weights and cut points (proportional odds), by Adam; gaps between cuts stay positive.

    Weights stay at 0 or above: a word tied to toxicity never makes a text look cleaner.
    """
    n, d = presence.shape
    w = np.zeros(d)
    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 1.0)[:-1] / (n + n_grades)
    start = np.log(share / (1 - share))
    raw = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 1e-2))))
    m, v = np.zeros(d + len(raw)), np.zeros(d + len(raw))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate(([raw[0]], np.exp(raw[1:]))))
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        z = presence @ w
        upper, lower = sigmoid(edges[grades + 1] - z), sigmoid(edges[grades] - z)
        upper[grades == n_grades - 1], lower[grades == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        grad_w = presence.T @ (du - dl) / n + decay * w  # d(-log p)/dz = (du - dl)
        grad_c = np.array([(dl[grades == k + 1].sum() - du[grades == k].sum()) / n for k in range(n_grades - 1)])
        below = np.cumsum(grad_c[::-1])[::-1]
        grad = np.concatenate((grad_w, [below[0]], below[1:] * np.exp(raw[1:])))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, raw = np.maximum(w - move[:d], 0.0), raw - move[d:]
    return w, np.cumsum(np.concatenate(([raw[0]], np.exp(raw[1:]))))


def train(rows: list[tuple[Counter, int]]) -> OrdinalModel:
    """The model of (word counts, label) rows, label 0 for clean. With one class only there is nothing to learn: all is clean."""
    rows = [(features(c), y) for c, y in rows]
    words = select_words(rows)
    if not words:
        return OrdinalModel({}, [40.0] * (GRADES - 1))
    grades = grades_of(rows, words)
    at = {w: i for i, w in enumerate(words)}
    presence = np.zeros((len(rows), len(words)))
    for i, (c, _) in enumerate(rows):
        presence[i, [at[w] for w in c if w in at]] = 1.0
    w, cuts = fit(presence, grades)
    return OrdinalModel(dict(zip(words, w.tolist(), strict=True)), cuts.tolist())


def labelled_sample(documents: DataFrame, labels: DataFrame, size: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[Counter, int]]:
    """At most `size` labelled documents of either class, chosen by a hash of their keys, as word counts on the driver."""
    out = []
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(f"k IS NOT NULL AND y BETWEEN 0 AND {GRADES - 1}").groupBy("k").agg(F.max("y").alias("y"))
    chosen = known.where("y > 0").orderBy(F.xxhash64("k"), "k").limit(size).union(known.where("y = 0").orderBy(F.xxhash64("k"), "k").limit(size))
    # 2 * size short rows: their number is the bound on what is broadcast
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [Counter(tokens(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([list(c) for c in got], pa.list_(pa.string())), pa.array([list(c.values()) for c in got], pa.list_(pa.int32()))], names=["y", "w", "n"])

    for r in rows.select("t", "y").mapInArrow(count, "y int, w array<string>, n array<int>").toLocalIterator():
        out.append((Counter(dict(zip(r[1], r[2], strict=True))), r[0]))
    return sorted(out, key=lambda x: (x[1], sorted(x[0].items())[:20]))


def scores(spark: SparkSession, documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: bool = False) -> DataFrame:
    """Rows (key, n_words, score, expected_severity, grade, is_toxic), one for each document row.

    With keep, the first column is instead `document`, a struct of all columns of documents, so no name can clash.
    A null, empty or wordless text has severity of the intercept alone. Labels that are null, no grade, or of no document
    are ignored; a key labelled more than once counts by its highest label. Documents of a repeated key, or repeated rows,
    each train and are each scored. Without both classes nothing is toxic. Training reads at most SAMPLE documents of
    either class; every document is scored, on its whole text. An empty table gives an empty one.
    """
    prepare(spark)
    model = train(labelled_sample(documents, labels, key=key, text=text, label=label))
    shared = spark.sparkContext.broadcast(model)  # WORDS words at most
    first = F.struct(*documents.columns).alias("document") if keep else F.col(key).alias("k")
    source = documents.select(first, F.col(text).alias("t"))
    lead = source.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            words = [tokens(t) for t in b.column(1).to_pylist()]
            score = np.array([m.score(w) for w in words], float)
            expected = m.expected(score) if len(score) else score
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(score), pa.array(expected), pa.array(np.rint(expected).astype(np.int32)), pa.array(expected >= REJECT)],
                names=[lead, "n_words", "score", "expected_severity", "grade", "is_toxic"],
            )

    schema = T.StructType([source.schema[0]])
    for name, kind in (("n_words", T.LongType()), ("score", T.DoubleType()), ("expected_severity", T.DoubleType()), ("grade", T.IntegerType()), ("is_toxic", T.BooleanType())):
        schema = schema.add(name, kind)
    out = source.mapInArrow(run, schema)
    return out if keep else out.withColumnRenamed("k", key)


def clean_documents(spark: SparkSession, documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents below the rejection bar, with their columns as they were. One map-side pass after training."""
    return scores(spark, documents, labels, keep=True, **options).where("NOT is_toxic").select("document.*")
