"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans. Looser patterns give further candidates, on which labelers vote: format,
gazetteer, words before, words after, surroundings. Expectation-maximisation over the counts of vote patterns estimates
each labeler's reliability. The final span classifier is logistic, fitted to the resulting posteriors over what the
labelers don't look at: the span's shape (separators, letters, length, spread of its characters) and its context (line
start, kind of character and of word on either side, company of other digits), besides its kind. It decides which
candidates become spans. Training sees one row for each distinct signature, whose number the feature set bounds.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm._common import Scratch, prepare

# Possessive forms of the stated patterns: the same matches, without backtracking over what can't match. A look-behind
# keeps a failed run of characters from being tried again at each of its positions; \G lets a match begin where the
# last one ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates that base patterns don't take.
LOOSE = {
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "hidden_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{2,40}(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]{2,10}|\.[A-Za-z]{2,10})",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?",
}
NAMES = "james|mary|john|patricia|robert|jennifer|michael|linda|david|elizabeth|william|susan|maria|anna|paul|peter|thomas|laura|martin|sophie|pierre|marie|hans|klaus|jose|carmen|juan|lucia"
BEFORE = r"(?i)(?:phone|tel|telephone|call|mobile|fax|contact|ssn|social security|iban|account|konto|mail|email|e-mail|name|signed|author|by|dear)[\x20:.#(]{0,4}$"
AFTER = r"(?i)^[\x20,.)]{0,3}(?:phone|tel|ext|mobile|office|home|wrote|said|bank|bic)"
#: Characters looked at on either side.
AROUND = 24
#: Probability from which a candidate is a span.
THRESHOLD = 0.5
LABELERS = ("format", "gazetteer", "before", "after", "clean")
#: The classifier's features beyond kind, each with its values in order (a signature has one character for each).
SHAPE = (("separator", "-. (x"), ("letters", "Aan"), ("length", "smlh"), ("variety", "lmh"), ("left", "ndwp"), ("right", "nwdp"), ("label", "yn"), ("company", "yn"))

#: Characters of which a match has at least one; looking for these first is cheaper.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "hidden_email": ")]", "ssn": "-"}
SPAN = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"


def _cut(text: Column, kind: str, pattern: str) -> Column:
    """struct<v, p>: the matches of a pattern and the pieces between them (one more); null where there is none."""
    possible = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in NEEDS.get(kind, "0123456789" if kind in ("card", "local_phone", "iban") else " ")])
    return F.when(possible & text.rlike(pattern), F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("p")))


def spans_of(cut: Column, kind: str) -> Column:
    """array<struct<kind, start, end, value, left, right>> of the matches in a _cut column, in code points, end exclusive."""
    values, pieces = cut["v"], cut["p"]
    empty = F.array().cast(SPAN)
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda p, v: F.struct(p.alias("p"), v.alias("v")))
    with_next = F.zip_with(pairs, F.slice(pieces, F.lit(2), F.size(values)), lambda x, n: F.struct(x["p"].alias("p"), x["v"].alias("v"), n.alias("n")))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["p"])
        end = start + F.length(x["v"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["v"].alias("value"), F.right(x["p"], F.lit(AROUND)).alias("left"), F.left(x["n"], F.lit(AROUND)).alias("right"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    found = F.aggregate(with_next, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(cut.isNotNull(), found).otherwise(empty)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    back = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substring(back, i, F.lit(1)).cast("int")).otherwise(F.substring(back, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(back, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def valid(kind: str, value: Column) -> Column:
    """The stated checks of base matches."""
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
        "card": F.when((n >= 13) & (n <= 19), luhn(value)).otherwise(False),
        "phone": (n >= 9) & (n <= 15),
    }[kind]


def votes(x: Column) -> Column:
    """Each labeler's vote on a span: 1 personal, -1 not, 0 no opinion; in the order of LABELERS, as one string of + - 0."""
    digits = _digits(x["value"])
    repeated = digits.rlike(r"^(\d)\1+$") | F.lit("01234567890123456789").contains(digits) & (F.length(digits) >= 6)
    well = (
        F.when(x["kind"] == "ssn", F.when(digits.rlike("^(?:000|666|9)|^...00|0000$"), -1).otherwise(1))
        .when(x["kind"] == "local_phone", F.when(digits.rlike("^[01]|^...[01]"), -1).otherwise(1))
        .when(x["kind"] == "iban", F.when(F.length(F.regexp_replace(x["value"], " ", "")).between(15, 34), 1).otherwise(-1))
        .when(x["kind"] == "card", F.when(luhn(x["value"]), 1).otherwise(-1))
        .when(x["kind"] == "person", 0)
        .otherwise(1)
    )
    gazetteer = F.when(F.lower(x["value"]).rlike(rf"\b(?:{NAMES})\b"), 1).when(F.lower(x["value"]).rlike(r"example|test|sample|foo|bar\b"), -1).otherwise(0)
    before = F.when(x["left"].rlike(BEFORE), 1).when(x["left"].rlike(r"[A-Za-z0-9_=/#-]$"), -1).otherwise(0)
    after = F.when(x["right"].rlike(AFTER), 1).when(x["right"].rlike(r"^[A-Za-z0-9_=/%]"), -1).otherwise(0)
    clean = F.when(repeated, -1).when(F.length(digits) > 0, 1).otherwise(0)
    sign = lambda v: F.when(v > 0, "+").when(v < 0, "-").otherwise("0")
    return F.concat(*(sign(v) for v in (well, gazetteer, before, after, clean)))


def signature(x: Column) -> Column:
    """A span's features in the order of SHAPE, one character each."""
    value, left, right = x["value"], x["left"], x["right"]
    size, spread = F.length(value), F.size(F.array_distinct(F.split(value, "")))
    separator = F.when(F.contains(value, F.lit("(")), "(").when(F.contains(value, F.lit("-")), "-").when(F.contains(value, F.lit(".")), ".").when(F.contains(value, F.lit(" ")), " ").otherwise("x")
    letters = F.when(value.rlike("[A-Z]"), "A").when(value.rlike("[a-z]"), "a").otherwise("n")
    length = F.when(size <= 11, "s").when(size <= 16, "m").when(size <= 24, "l").otherwise("h")
    variety = F.when(spread * 3 <= size, "l").when(spread * 2 <= size, "m").otherwise("h")
    before = F.when(F.length(left) == 0, "n").when(left.rlike(r"[\n\r]\s*$"), "n").when(left.rlike(r"[0-9]\W{0,2}$"), "d").when(left.rlike(r"[A-Za-z]\s*$"), "w").otherwise("p")
    after = F.when(F.length(right) == 0, "n").when(right.rlike(r"^\s*[\n\r]"), "n").when(right.rlike(r"^\W{0,2}[0-9]"), "d").when(right.rlike(r"^\s*[A-Za-z]"), "w").otherwise("p")
    label = F.when(left.rlike(r"[A-Za-z]{2}[\x20]?[:=#][\x20]?$"), "y").otherwise("n")
    company = F.when(left.rlike("[0-9]{2}") | right.rlike("[0-9]{2}"), "y").otherwise("n")
    return F.concat(separator, letters, length, variety, before, after, label, company)


def fit_labelers(patterns: list[tuple[str, str, int]], rounds: int = 60, prior: float = 0.5) -> dict[tuple[str, str], float]:
    """Posterior probability of being personal for each (kind, votes) pattern, given (kind, votes, count) rows.

    One-coin-per-vote-value Dawid-Skene: P(vote | class) for each labeler, smoothed, from expectation-maximisation;
    the class share is kept per kind. Starts from the majority vote.
    """
    if not patterns:
        return {}
    post = {}
    for kind, v, _ in patterns:
        lean = v.count("+") - v.count("-")
        post[kind, v] = 1 / (1 + math.exp(-1.2 * lean))
    for _ in range(rounds):
        table = {(j, o, c): 1.0 + (2.0 if (o, c) in (("+", 1), ("-", 0)) else 0.0) for j in range(len(LABELERS)) for o in "+-0" for c in (0, 1)}
        share: dict[str, list[float]] = {}
        for kind, v, n in patterns:
            p = post[kind, v]
            s = share.setdefault(kind, [2 * prior, 2.0])
            s[0] += n * p
            s[1] += n
            for j, o in enumerate(v):
                table[j, o, 1] += n * p
                table[j, o, 0] += n * (1 - p)
        total = {(j, c): sum(table[j, o, c] for o in "+-0") for j in range(len(LABELERS)) for c in (0, 1)}
        new = {}
        for kind, v, _ in patterns:
            odds = math.log(share[kind][0] / max(share[kind][1] - share[kind][0], 1e-9))
            for j, o in enumerate(v):
                odds += math.log(table[j, o, 1] / total[j, 1]) - math.log(table[j, o, 0] / total[j, 0])
            new[kind, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        change = max(abs(new[k] - post[k]) for k in new)
        post = new
        if change < 1e-6:
            break
    return post


def features(kind: str, shape: str) -> list[str]:
    """Names of a span's features: its kind, each shape or context value, and each of these for its kind."""
    own = [f"{n}={o}" for (n, _), o in zip(SHAPE, shape, strict=True)]
    return ["bias", f"kind={kind}", *own, *(f"{kind}&{x}" for x in own)]


def fit_classifier(rows: list[tuple[str, str, float, int]], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic span classifier from rows (kind, shape, probability, count); a row weighs by the logarithm of
    its count, so that common kinds don't drown rare ones."""
    if not rows:
        return {}
    names = sorted({x for k, v, _, _ in rows for x in features(k, v)})
    at = {x: i for i, x in enumerate(names)}
    index = np.array([[at[x] for x in features(k, v)] for k, v, _, _ in rows])
    target, weight = np.array([r[2] for r in rows]), np.log1p(np.array([r[3] for r in rows], float))
    weight /= weight.sum()
    w = np.zeros(len(names))
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-w[index].sum(1))) - target)
        gradient = np.bincount(index.ravel(), np.repeat(error, index.shape[1]), len(names))
        w -= rate * (gradient + decay * w) * 4
    return dict(zip(names, w.tolist(), strict=True))


def with_candidates(texts: DataFrame) -> DataFrame:
    """Of any columns and a text column `t`, without t: adds base and loose, checked base spans and further candidates,
    array<struct<kind, start, end, votes, shape>> by kind, then start. Callers give no other column of these names."""
    rest = [c for c in texts.columns if c != "t"]
    t = F.coalesce(F.col("t"), F.lit(""))
    cut = texts.select(*rest, *(_cut(t, k, p).alias(f"cut_{k}") for k, p in {**BASE, **LOOSE}.items()))
    checked = lambda k: lambda x: valid(k, x["value"])
    base = [F.filter(spans_of(F.col(f"cut_{k}"), k), checked(k)) for k in BASE]
    loose = [spans_of(F.col(f"cut_{k}"), k) for k in LOOSE]
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), votes(x).alias("votes"), signature(x).alias("shape"))
    return cut.select(*rest, F.transform(F.concat(*base), slim).alias("base"), F.transform(F.concat(*loose), slim).alias("loose"))


def train(found: DataFrame) -> dict[str, float]:
    """The span classifier's weights, from the counts of vote and shape patterns in base and loose."""
    both = found.select(F.explode_outer(F.concat("base", "loose")).alias("x")).where("x IS NOT NULL")
    # one row for each pattern; their number is bounded by the votes and shapes there are, whatever the corpus
    rows = [tuple(r) for r in both.groupBy("x.kind", "x.votes", "x.shape").agg(F.count("*")).collect()]
    counts: dict[tuple[str, str], int] = {}
    for kind, v, _, n in rows:
        counts[kind, v] = counts.get((kind, v), 0) + n
    posterior = fit_labelers([(k, v, n) for (k, v), n in sorted(counts.items())])
    return fit_classifier(sorted((k, shape, posterior[k, v], n) for k, v, shape, n in rows))


def likely(weights: dict[str, float], kind: Column, shape: Column) -> Column:
    """The classifier's probability that a span is personal; features it never saw count nothing."""
    entry = lambda x: F.coalesce(F.element_at(known, x), F.lit(0.0))
    known = F.create_map(*(F.lit(y) for kv in sorted(weights.items()) for y in kv)) if weights else F.create_map().cast("map<string,double>")
    z = entry(F.lit("bias")) + entry(F.concat(F.lit("kind="), kind))
    for i, (name, _) in enumerate(SHAPE):
        value = F.concat(F.lit(f"{name}="), F.substring(shape, i + 1, 1))
        z = z + entry(value) + entry(F.concat(kind, F.lit("&"), value))
    return 1 / (1 + F.exp(-z))


def added(weights: dict[str, float]) -> Column:
    """The accepted candidates of `loose` that overlap no span of `base`."""
    if not weights:
        return F.filter("loose", lambda x: F.lit(False))
    return F.filter("loose", lambda x: (likely(weights, x["kind"], x["shape"]) >= THRESHOLD) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def find(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, base, added): arrays of struct<kind, start, end, votes, shape>, positions in code points, end exclusive.

    base holds the strict spans by kind (email, ip, card, phone), then start. added holds the looser candidates that
    overlap no base span and that the span classifier accepts, by kind, then start. A null text has none. Rows with a
    null or repeated key are judged each on its own. An empty table gives an empty one. Texts are scanned once.
    """
    prepare(spark)
    scratch = Scratch(spark, "pii")
    found = scratch.write(with_candidates(documents.select(F.col(key).alias("k"), F.col(text).alias("t"))), "spans")
    return scratch.keep(found.select(F.col("k").alias(key), F.col("base"), added(train(found)).alias("added")))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, and all spans as text."""
    found = find(spark, documents, key, text)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(key, *map(count, BASE), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.concat("base", "added")).alias("spans"))


def redact(spark: SparkSession, documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span, base or added, replaced by <kind> in the text column.

    Overlapping spans become one mark, that of the first. Other columns, whatever their names, and rows stay as they are;
    null texts stay null. Texts are scanned once: documents and their candidates are written to the shared folder, the
    classifier is trained from these, and rewriting reads them.
    """
    prepare(spark)
    whole = documents.select(F.struct(*documents.columns).alias("document"), F.col(text).alias("t"))
    found = Scratch(spark, "redact").write(with_candidates(whole), "spans")
    spans = F.array_sort(F.transform(F.concat("base", added(train(found))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    found = found.select("document", F.col(f"document.`{text}`").alias("t"), spans.alias("spans"))
    t = F.col("t")

    def step(s: Column, x: Column) -> Column:
        mark = F.concat(s["out"], F.substring(t, s["at"] + 1, x["start"] - s["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] < s["at"], s["out"]).otherwise(mark).alias("out"))

    rewritten = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.length(t))))
    new = F.when((F.size("spans") > 0) & t.isNotNull(), rewritten).otherwise(t)
    return found.select(*(new.alias(c) if c == text else F.col(f"document.`{c}`").alias(c) for c in documents.columns))
