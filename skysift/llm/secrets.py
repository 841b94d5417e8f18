"""Secret scanning: patterns propose findings, a random forest removes false ones.

Features of a finding: its length and alphabet, how probable its character transitions are in the corpus's own words, how
much of it words of the corpus's dictionary cover, its path, and the words around it. Transitions and dictionary are
counted over all documents in a pass of their own; the dictionary holds the words that occur SUPPORT times
and make up at least one in DICTIONARY of all words, so it can't hold more than DICTIONARY. The forest is trained from labelled findings: a caller's, or a
deterministic set (labelled_findings) that writes secrets and look-alikes into contexts made of the corpus's words.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm._bytes import LOWER, joined, span_hashes
from skysift.llm._common import Scratch, prepare

#: Trees, their depth, rows of a leaf, labelled findings used at most, characters of context, bar of acceptance.
TREES, DEPTH, LEAF, FINDINGS, CONTEXT, ACCEPT = 40, 8, 3, 6000, 60, 0.5
#: Words of the dictionary at most; occurrences of a word at least (pieces of keys repeat less); letters of a word; words
#: that training contexts are drawn from.
DICTIONARY, SUPPORT, LETTERS, DRAWN = 50_000, 10, (3, 24), 1000
PATTERNS = (
    ("aws_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("github", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{30,}+"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("private_key", r"-----BEGIN (?P<label>[A-Z ]{0,20}PRIVATE KEY)-----(?:(?:[^-]|-(?!----))*+-----END (?P=label)-----)?"),
    ("assigned", r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?)(?!-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)[^\s\"'<>]{6,}+"),
    ("long", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]{0,40}[0-9])[A-Za-z0-9+/_=-]{24,}"),
)
_pattern = re.compile("|".join(f"(?P<{n}>{p})" for n, p in PATTERNS))
_assign = re.compile(r"(?i)^(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\x20\t]*[=:][\x20\t]*[\"']?")
_word = re.compile(r"[A-Za-z]{2,}").findall
COMMON = frozenset("the and for you are with this that from have not was but all can your one has had his her they will what when where there their would about which example test sample password secret token key changeme default value here insert replace dummy fake placeholder admin user name data file path commit hash checksum none null true false string number public private".split())
GOOD, BAD = frozenset("password passwd pwd secret token key credential credentials auth api login access".split()), frozenset("example sample test dummy fake placeholder checksum sha256 sha1 md5 commit hash digest uuid integrity revision build image".split())
ENGLISH = "the of and to in is that it was for on are with as his they be at one have this from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know"
FEATURES = ("length", "digits", "upper", "lower", "symbols", "distinct", "entropy", "transitions", "dictionary", "longest_word", "repeats", "sequence", "hex", "kind_aws", "kind_github", "kind_jwt", "kind_private", "kind_assigned", "kind_long", "path_test", "path_doc", "near_good", "near_bad", "after_equals", "template")


@dataclass
class Language:
    """What the corpus's words are like: the log-odds of each pair of letters, the dictionary, and its most frequent words."""

    pairs: dict[str, float]
    dictionary: frozenset[str]
    frequent: list[str]

    @classmethod
    def of(cls, pairs: dict[str, int], words: dict[str, int]) -> Language:
        """From counts; the built-in words are always known, so that an empty corpus has a language too."""
        own = (ENGLISH + " " + " ".join(sorted(COMMON))).split()
        total = Counter(pairs)
        total.update(a + b for w in own for a, b in zip(w, w[1:], strict=False))
        n = sum(total.values()) + 676
        odds = {a + b: math.log((total[a + b] + 1) / n * 676) for a in string.ascii_lowercase for b in string.ascii_lowercase}
        most = sorted(words, key=lambda w: (-words[w], w))[:DRAWN]
        return cls(odds, frozenset(words) | {w for w in own if len(w) >= LETTERS[0]}, most + ENGLISH.split()[: max(0, DRAWN // 4 - len(most))])

    def covered(self, low: str) -> tuple[float, int]:
        """Share of the characters inside dictionary words, longest first from the left of each run of letters, and the longest."""
        inside = longest = 0
        for run in _runs(low):
            at = 0
            while at < len(run) - LETTERS[0] + 1:
                size = next((k for k in range(min(LETTERS[1], len(run) - at), LETTERS[0] - 1, -1) if run[at : at + k] in self.dictionary), 0)
                inside, longest, at = inside + size, max(longest, size), at + (size or 1)
        return inside / max(1, len(low)), longest


_runs = re.compile("[a-z]+").findall


def count_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, w, n): how often each pair of letters (pair true) and each word of a batch of texts occurs."""
    for b in batches:
        data, offsets = joined(b.column(0))
        low = LOWER[data]
        letter = (low >= 97) & (low <= 122)
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(low))]
        begins, finishes = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1]
        finishes[:-1] &= ~letter[1:]
        begins[edges] = letter[edges]
        finishes[edges - 1] = letter[edges - 1]
        inner = letter[:-1] & ~finishes[:-1]
        at = np.flatnonzero(inner)
        pairs = np.bincount((low[at].astype(np.int64) - 97) * 26 + low[at + 1] - 97, minlength=676) if len(at) else np.zeros(676, np.int64)
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        fit = (ends - starts >= LETTERS[0]) & (ends - starts <= LETTERS[1])
        starts, ends = starts[fit], ends[fit]
        names: Counter = Counter()
        if len(starts):
            _, first, counts = np.unique(span_hashes(low, starts, ends), return_index=True, return_counts=True)
            raw = low.tobytes()
            for i, n in zip(first.tolist(), counts.tolist(), strict=True):
                names[raw[starts[i] : ends[i]].decode()] += n
        known = np.flatnonzero(pairs).tolist()
        w = [chr(97 + k // 26) + chr(97 + k % 26) for k in known] + list(names)
        n = [int(pairs[k]) for k in known] + list(names.values())
        yield pa.RecordBatch.from_arrays([pa.array([True] * len(known) + [False] * len(names), pa.bool_()), pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["pair", "w", "n"])


def language(spark: SparkSession, documents: DataFrame, text: str = "text") -> Language:
    """The language of all documents: one pass with map-side sums; at most 676 pairs and DICTIONARY words reach the driver."""
    prepare(spark)
    rows = documents.select(F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(count_language, "pair boolean, w string, n long")
    counts = Scratch(spark, "language").write(rows.groupBy("pair", "w").agg(F.sum("n").alias("n")), "counts")
    total = counts.where("NOT pair").agg(F.sum("n")).first()[0] or 0
    pairs = {r[0]: r[1] for r in counts.where("pair").select("w", "n").collect()}
    words = {r[0]: r[1] for r in counts.where(~F.col("pair") & (F.col("n") * DICTIONARY >= total) & (F.col("n") >= SUPPORT)).select("w", "n").collect()}
    return Language.of(pairs, words)


def features(kind: str, value: str, path: str, left: str, right: str, known: Language | None = None) -> list[float]:
    """The FEATURES of a finding."""
    n = max(1, len(value))
    count = Counter(value)
    low = value.lower()
    letters = [a + b for a, b in zip(low, low[1:], strict=False) if a.isalpha() and b.isalpha()]
    known = known or Language.of({}, {})
    share, longest = known.covered(low)
    steps = [ord(b) - ord(a) for a, b in zip(value, value[1:], strict=False)]
    around = {w.lower() for w in _word(left[-CONTEXT:]) + _word(right[:CONTEXT])}
    where = path.lower()
    return [
        len(value), sum(c.isdigit() for c in value) / n, sum(c.isupper() for c in value) / n, sum(c.islower() for c in value) / n, sum(not c.isalnum() for c in value) / n,
        len(count) / n, -sum(c / n * math.log2(c / n) for c in count.values()),
        sum(known.pairs.get(p, 0.0) for p in letters) / max(1, len(letters)), share, longest,
        sum(s == 0 for s in steps) / n, sum(abs(s) == 1 for s in steps) / n, float(re.fullmatch(r"[0-9a-fA-F]+", value) is not None),
        *(float(kind == k) for k, _ in PATTERNS),
        float(re.search(r"test|spec|fixture|mock", where) is not None), float(re.search(r"doc|readme|example|sample", where) is not None),
        len(around & GOOD), len(around & BAD), float(left.rstrip()[-1:] in ("=", ":")), float(re.search(r"[${}<>%]|x{4,}|\*{3,}|\.{3,}", low) is not None),
    ]


def find(text: str) -> Iterator[tuple[str, int, int, int]]:
    """(kind, start, value start, end) of candidates, leftmost, not overlapping."""
    for m in _pattern.finditer(text):
        skip = _assign.match(m[0]).end() if m.lastgroup == "assigned" else 0
        yield m.lastgroup, m.start(), m.start() + skip, m.end()


@dataclass
class Tree:
    """Flat arrays: feature (-1 at a leaf), threshold, children, share of true secrets."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            f = self.feature[at]
            go = f >= 0
            if not go.any():
                return self.share[at]
            lower = x[np.arange(len(x)), np.maximum(f, 0)] <= self.bound[at]
            at = np.where(go, np.where(lower, self.left[at], self.right[at]), at)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Tree:
    """One tree on a bootstrap sample: Gini splits over a random half of the features at each node."""
    nodes: list[list] = []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean())])
        if depth == DEPTH or len(rows) < 2 * LEAF or nodes[me][4] in (0.0, 1.0):
            return me
        best = (0.0, -1, 0.0)
        parent = nodes[me][4] * (1 - nodes[me][4])
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False).tolist():
            order = np.argsort(x[rows, f], kind="stable")
            v, t = x[rows, f][order], y[rows][order]
            n = np.arange(1, len(v))
            ones = np.cumsum(t)[:-1]
            ok = (v[1:] > v[:-1]) & (n >= LEAF) & (len(v) - n >= LEAF)
            if not ok.any():
                continue
            p, q = ones / n, (t.sum() - ones) / (len(v) - n)
            gain = np.where(ok, parent - (n * p * (1 - p) + (len(v) - n) * q * (1 - q)) / len(v), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(v[k]))
        if best[1] < 0:
            return me
        low = x[rows, best[1]] <= best[2]
        nodes[me][:2] = [best[1], best[2]]
        nodes[me][2] = node(rows[low], depth + 1)
        nodes[me][3] = node(rows[~low], depth + 1)
        return me

    node(rng.integers(0, len(x), len(x)), 0)
    cols = list(zip(*nodes, strict=True))
    return Tree(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4]))


class Forest:
    """Mean of the trees' shares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = [grow(x, y.astype(float), rng) for _ in range(trees)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


Finding = tuple[str, str, str, str, str, int]


def labelled_findings(n: int = 1500, seed: int = 5, words: Sequence[str] = ()) -> list[Finding]:
    """Findings (kind, value, path, left, right, label) for training: drawn key formats against look-alikes, in contexts of
    the given words (the corpus's most frequent ones) or of English."""
    r = random.Random(seed)
    words = list(words)
    alnum = string.ascii_letters + string.digits
    draw = lambda a, k: "".join(r.choice(a) for _ in range(k))
    english = ENGLISH.split()
    prose = lambda: " ".join(r.choice(english) for _ in range(r.randrange(3, 9)))
    corpus = lambda: " ".join(r.choice(words or english) for _ in range(r.randrange(3, 9)))
    name = lambda k: [r.choice(words or english) for _ in range(k)]
    out: list[Finding] = []
    for k in range(n):
        text = prose if k % 2 else corpus
        path = r.choice(["app/config.py", "deploy/env.sh", "lib/client.js", "web", "crawl", ""])
        key = r.choice(["password", "token", "secret", "api_key"])
        real = r.choice([
            ("aws_key", "AKIA" + draw(string.ascii_uppercase + string.digits, 16), text() + " "),
            ("github", "ghp_" + draw(alnum, 36), text() + " token "),
            ("jwt", "eyJ" + draw(alnum, r.randrange(17, 120)) + "." + draw(alnum, r.randrange(30, 400)) + "." + draw(alnum, r.choice([43, 86, 342])), text() + " Bearer "),
            ("assigned", "eyJ" + draw(alnum, r.randrange(17, 120)) + "." + draw(alnum, r.randrange(30, 400)) + "." + draw(alnum, r.choice([43, 86, 342])), f"{text()} {key}="),
            ("assigned", draw("0123456789abcdef", r.choice([18, 20, 32, 40, 64])), f"{text()} {key}{r.choice(['=', ' = ', ': '])}"),
            ("assigned", draw(alnum + "!@#%^&*", r.randrange(10, 28)), f"{text()} {key}{r.choice(['=', ' = '])}"),
            ("long", draw(alnum + "+/", r.choice([32, 40, 44])), f"{text()} access key "),
            ("private_key", "-----BEGIN RSA PRIVATE KEY-----" + ("\n" + "\n".join(draw(alnum + "+/", 64) for _ in range(r.randrange(2, 30))) + "\n-----END RSA PRIVATE KEY-----" if k % 2 else ""), text() + "\n"),
        ])
        out.append((real[0], real[1], path, real[2], " " + text(), 1))
        path = r.choice(["tests/test_login.py", "docs/readme.md", "examples/app.js", "web", "crawl", ""])
        false = r.choice([
            ("aws_key", "AKIA" + r.choice(["IOSFODNN7EXAMPLE", "EXAMPLEEXAMPLE00", "XXXXXXXXXXXXXXXX", "1234567890ABCDEF", "TESTKEYTESTKEY12"]), text() + " example "),
            ("assigned", r.choice(["changeme", "password", "your_token_here", "<token>", "${SECRET}", "xxxxxxxx", "********", "example", "placeholder", "None,", "getenv(", "123456", "secret123", "test1234"]), f"{text()} {key}{r.choice(['=', ' = ', ': '])}"),
            ("assigned", r.choice(["_", "-", ".", ""]).join(name(3)), f"{text()} {key}="),
            ("assigned", "".join(w.capitalize() for w in name(r.randrange(2, 5))) + r.choice(["", "()", "1"]), f"{text()} {key} = "),
            ("long", r.choice(["_", "-", "/"]).join(name(r.randrange(5, 9))) + str(r.randrange(100)), text() + " "),
            ("long", draw("0123456789abcdef", r.choice([40, 64, 32])), text() + r.choice([" commit ", " sha256 checksum ", " md5 hash ", " revision ", " digest "])),
            ("long", "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), text() + " uuid "),
            ("long", "/".join(r.choice(english) for _ in range(6)) + "/" + str(r.randrange(100)), text() + " path "),
            ("long", r.choice("0123456789ab") * r.randrange(24, 40), text() + " "),
            ("long", (string.digits + string.ascii_lowercase)[: r.randrange(24, 36)], text() + " "),
            ("long", "_".join(r.choice(english) for _ in range(6)) + "_v2", text() + " "),
            ("github", "ghp_" + "x" * 36, text() + " example "),
        ])
        out.append((false[0], false[1], path, false[2], " " + text(), 0))
    return out


def train(findings: Sequence[Finding] | None = None, known: Language | None = None) -> Forest:
    """A forest from at most FINDINGS labelled findings (the built-in ones, if none are given)."""
    known = known or Language.of({}, {})
    rows = list(findings if findings is not None else labelled_findings(words=known.frequent))[:FINDINGS]
    if not rows:
        raise ValueError("no labelled findings")
    return Forest(np.array([features(*r[:5], known) for r in rows], float), np.array([r[5] for r in rows]))


def scan(spark: SparkSession, documents: DataFrame, findings: Sequence[Finding] | None = None, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """Rows (key, kind, start, end, n_chars, value_sha256, score, is_secret), one for each candidate.

    Positions are code points of the secret itself, end exclusive. A null or empty text has none; a null or missing
    path counts as empty. Equal rows give equal findings, each its own. Every text is read whole, in two map-side passes:
    one counts the corpus's language, one scans. Only the forest (TREES trees of depth DEPTH) and the language (DICTIONARY
    words at most) are broadcast. An empty table gives an empty one.
    """
    prepare(spark)
    known = language(spark, documents, text)
    forest = spark.sparkContext.broadcast((train(findings, known), known))
    where = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in documents.columns else F.lit("")
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), where.alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows, x = [], []
            for i, (t, p) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for kind, start, value, end in find(t or ""):
                    rows.append((i, kind, value, end, end - value, hashlib.sha256(t[value:end].encode()).hexdigest()))
                    x.append(features(kind, t[value:end], p, t[max(0, start - CONTEXT) : value], t[end : end + CONTEXT], forest.value[1]))
            score = forest.value[0].predict(np.array(x, float).reshape(len(x), len(FEATURES)))
            cols = [b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
            cols += [pa.array([r[j] for r in rows], kind) for j, kind in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (5, pa.string()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score, pa.float64()), pa.array(score >= ACCEPT, pa.bool_())], names=["k", "kind", "start", "end", "n_chars", "value_sha256", "score", "is_secret"])

    kind = docs.schema["k"].dataType.simpleString()
    return docs.mapInArrow(run, f"k {kind}, kind string, start long, end long, n_chars long, value_sha256 string, score double, is_secret boolean").withColumnRenamed("k", key)
