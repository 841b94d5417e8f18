"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed once; hashes of k consecutive words come from log2(k) pairwise combinations, and the least of each
`span - k + 1` consecutive ones is a fingerprint. Texts that share `span` consecutive words share a fingerprint, so
documents without a common fingerprint need no closer look. The rest are compared window by window with the
benchmark's own windows, which extends every hit to its exact extent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm._common import Scratch, prepare

#: Words of a window, of a fingerprinted k-gram; bytes of benchmark windows that may be broadcast.
SPAN, GRAM, BROADCAST_BYTES = 10, 4, 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _steps(n: int) -> list[int]:
    """Shifts that build windows of n elements from windows of 1, doubling: n = 7 gives 1, 2, 3."""
    out, have = [], 1
    while have < n:
        out.append(min(have, n - have))
        have += out[-1]
    return out


def _shifted(values: Column, shift: int, combine) -> Column:
    """combine(values[i], values[i + shift]) for every i that has both."""
    left = F.slice(values, F.lit(1), F.greatest(F.size(values) - shift, F.lit(0)))
    right = F.slice(values, F.lit(shift + 1), F.greatest(F.size(values) - shift, F.lit(0)))
    return F.zip_with(left, right, combine)


def gram_hashes(df: DataFrame, source: str, n: int, target: str) -> DataFrame:
    """Adds target: the hash of every n consecutive elements of the words array source."""
    df = df.withColumn(target, F.transform(source, lambda w: F.xxhash64(w)))
    for shift in _steps(n):
        df = df.withColumn(target, _shifted(F.col(target), shift, lambda a, b: F.xxhash64(a, b)))
    return df


def winnowed(df: DataFrame, source: str, span: int, gram: int, target: str) -> DataFrame:
    """Adds target: the distinct least hashes of every span - gram + 1 consecutive gram-word hashes."""
    df = gram_hashes(df, source, gram, target)
    for shift in _steps(span - gram + 1):
        df = df.withColumn(target, _shifted(F.col(target), shift, lambda a, b: F.least(a, b)))
    return df.withColumn(target, F.array_distinct(target))


def windows(source: str, n: Column | int) -> Column:
    """array<struct<at, w>>: every n consecutive words, joined by spaces, with the index of the first."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.size(source) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(F.col(source), i + 1, n), " ").alias("w"))))


def contamination(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (key, n_words, n_hit, n_items, items_sha256, contaminated), one for each document row.

    A benchmark item's windows are its `span` consecutive words; an item of fewer words, but not none, is one window.
    Every document word inside an occurrence of a window is hit. n_items counts distinct non-null item ids.
    A null or wordless text has no words and no hits; an empty benchmark hits nothing. Rows with a null or repeated
    key are judged each on its own text; rows are told apart by the SHA-256 of key and text. The benchmark side is
    broadcast only up to broadcast_bytes bytes as measured, and shuffled beyond.

    Documents are split into words twice at most: once for word counts and fingerprints of all lengths together, and
    once more those that share a fingerprint with the benchmark.
    """
    # explode_outer, here and below: for explode, the optimizer infers a filter on the array and copies the array's whole
    # expression into it, many times over for nested ones
    prepare(spark)
    scratch = Scratch(spark, "decon")
    items = benchmark.select(F.col(item).alias("item"), words(F.col(item_text)).alias("bw")).where(F.size("bw") > 0)
    length = F.least(F.size("bw"), F.lit(span))
    bench = items.select("item", length.alias("len"), F.explode_outer(windows("bw", length)).alias("x")).select("item", "len", F.col("x.w").alias("bw")).where("bw IS NOT NULL").distinct()
    bench = scratch.write(bench, "windows")
    lens = sorted(r[0] for r in bench.select("len").distinct().collect())  # at most span values
    size = bench.agg(F.sum(F.octet_length("bw") + 24)).first()[0] or 0
    side = (lambda df: F.broadcast(df)) if size <= broadcast_bytes else (lambda df: df)

    def prints(df: DataFrame, source: str, n: int, target: str) -> DataFrame:
        return winnowed(df, source, span, gram, target) if n == span else gram_hashes(df, source, n, target)

    def told(n: int) -> Column:
        """fp -> (n, fp); lengths are kept apart."""
        return F.transform(F.array_distinct(f"fp{n}"), lambda x: F.struct(F.lit(n).alias("n"), x.alias("fp")))

    name = F.coalesce(F.col("k").cast("string"), F.lit(""))
    known = F.when(F.col("k").isNotNull(), F.length(name)).otherwise(-1).cast("string")
    docs = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("row", F.sha2(F.concat_ws(":", known, name, F.coalesce("t", F.lit(""))), 256))
    split = docs.select("k", "row", words(F.col("t")).alias("ws"))
    theirs = spark.createDataFrame([], "n int, fp long")
    for n in lens:
        split = prints(split, "ws", n, f"fp{n}")
        windowed = bench.where(F.col("len") == n).select(F.split("bw", " ").alias("iw")).distinct()
        theirs = theirs.union(prints(windowed, "iw", n, "fp").select(F.lit(n), F.explode_outer("fp")))
    theirs = scratch.write(theirs.distinct(), "fingerprints").select(F.col("n").alias("tn"), F.col("fp").alias("tfp"))
    # the first entry of each document has n = 0: it carries the row through the join and counts its repetitions
    entries = F.concat(F.array(F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("fp"))), *map(told, lens))
    mine = split.select("k", "row", F.size("ws").cast("long").alias("n_words"), entries.alias("x")).select("k", "row", "n_words", F.explode_outer("x").alias("x")).select("k", "row", "n_words", "x.n", "x.fp")
    met = mine.join(side(theirs), (F.col("n") == F.col("tn")) & (F.col("fp") == F.col("tfp")), "left").where("n = 0 OR tn IS NOT NULL")
    flags = [F.max(F.when(F.col("n") == n, True)).alias(f"has{n}") for n in lens]
    rows = met.groupBy("row").agg(F.any_value("k").alias("k"), F.any_value("n_words").alias("n_words"), F.count_if(F.col("n") == 0).alias("times"), *flags)
    ns = F.array_compact(F.array(*(F.when(F.col(f"has{n}"), F.lit(n)) for n in lens))).cast("array<int>") if lens else F.array().cast("array<int>")
    rows = scratch.write(rows.select("row", "k", "n_words", "times", ns.alias("ns")), "rows")

    # the exact comparison, for candidate documents alone; equal rows (same key and text) are compared once, and each
    # for the window lengths it is a candidate for
    candidates = rows.where(F.size("ns") > 0).select("row", "ns")
    few = (candidates.agg(F.sum(F.octet_length("row") + 8 * F.size("ns") + 24)).first()[0] or 0) <= broadcast_bytes
    # few candidates are sent to the texts; many would not fit, and texts are dealt with them by row
    candidates = F.broadcast(candidates) if few else candidates
    closer = docs.select("row", "t").join(candidates, "row").dropDuplicates(["row"]).select("row", "ns", words(F.col("t")).alias("ws"))
    tried = closer.select("row", "ws", F.explode_outer("ns").alias("n")).select("row", "n", F.explode_outer(windows("ws", F.col("n"))).alias("x")).select("row", "n", "x.at", "x.w")
    hits = tried.join(side(bench), (F.col("w") == F.col("bw")) & (F.col("n") == F.col("len"))).select("row", "n", "at", "item")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("at", "n"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["n"]).alias("end"), (s["sum"] + F.greatest(x["at"] + x["n"] - F.greatest(x["at"], s["end"]), F.lit(0))).alias("sum")),
        lambda s: s["sum"],
    )
    by_row = hits.groupBy("row").agg(covered.alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("ids"))
    by_row = by_row.select(F.col("row").alias("hit_row"), "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    out = rows.join(by_row, F.col("row") == F.col("hit_row"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    once = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    result = once.select(F.col("k").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    return scratch.keep(result)


def clean_documents(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with all their columns, whatever their names. Options as for contamination().

    Rows are told apart by the SHA-256 of their text: equal texts share their fate.
    """
    text = options.pop("text", "text")
    options.pop("key", None)
    whole = documents.select(F.struct(*documents.columns).alias("document"), F.col(text).alias("t")).withColumn("h", F.sha2("t", 256))
    narrow = whole.select(F.col("h").alias("doc"), F.col("t").alias("text"))
    bad = contamination(spark, narrow, benchmark, key="doc", text="text", **options).where("contaminated").select(F.col("doc").alias("bad")).distinct()
    return whole.join(bad, F.col("h") == F.col("bad"), "left_anti").select("document.*")
