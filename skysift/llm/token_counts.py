"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-tokens and their numbers of tokens, broadcast to the workers; its size is
bounded by a parameter. Tier two is a cache in each Python worker: pre-tokens that the table lacks are encoded once by
the tokenizer library and remembered, again up to a bound. No pre-token is ever shuffled: the scan is the only stage.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm._common import prepare

#: Entries of the broadcast table, rows sampled to fill it, entries of a worker's cache, longest cached pre-token.
TABLE_SIZE, SAMPLE_ROWS, CACHE_SIZE, LONGEST = 60_000, 400, 400_000, 64


class PreTokenCounter:
    """Counts tokens of texts exactly as the tokenizer file does (no added begin or end tokens).

    Needs a byte-level BPE tokenizer without normaliser whose pre-tokens come from the file's own regular expression;
    strings of added tokens inside a text are found first, leftmost and longest, as the library does by default.
    """

    def __init__(self, path: str, pattern: str, frequent: dict[str, int] | None = None):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind["pre_tokenizer"] or {}
        if kind["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level tokenizers without a normaliser are supported")
        added = kind["added_tokens"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("added tokens that strip or ask for whole words are not supported")
        self.added = regex.compile("|".join(regex.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"])))) if added else None
        self.findall = regex.compile(pattern).findall
        self.frequent = frequent or {}
        self.cache: dict[str, int] = {}

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and the number of added tokens among them."""
        if self.added is None or not self.added.search(text):
            return self.findall(text), 0
        parts = self.added.split(text)
        return [w for part in parts for w in self.findall(part)], len(parts) - 1

    def lengths(self, words: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch(words, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """Misses of the whole batch are encoded together, each distinct one once."""
        found = [self.split(t) for t in texts]
        known, cache = self.frequent, self.cache
        missing = {w for words, _ in found for w in words if w not in known and w not in cache}
        if missing and len(cache) + len(missing) > CACHE_SIZE:
            # what this batch needs stays; the rest makes room
            needed = {w: cache[w] for words, _ in found for w in words if w in cache}
            cache.clear()
            cache.update(needed)
        missed = list(missing)
        for k in range(0, len(missed), 20_000):
            cache.update(zip(missed[k : k + 20_000], self.lengths(missed[k : k + 20_000]), strict=True))
        get = known.get
        out = [sum([get(w) or cache[w] for w in words]) + extra for words, extra in found]
        for w in missed:
            if len(w) > LONGEST:
                del cache[w]
        return out


def frequent_lengths(documents: DataFrame, path: str, pattern: str, text: str = "text", size: int = TABLE_SIZE, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """The broadcast table: pre-tokens most frequent in a bounded sample of rows, with their exact lengths.

    The sample decides only what is looked up and what is encoded, never a count; at most `size` entries of at most
    LONGEST characters each, whatever the corpus.
    """
    counter = PreTokenCounter(path, pattern)
    seen: Counter[str] = Counter()
    for row in documents.where(F.length(text) < 200_000).select(text).limit(sample_rows).toLocalIterator():
        seen.update(w for w in counter.split(row[0])[0] if len(w) <= LONGEST)
    words = [w for w, _ in seen.most_common(size)]
    return dict(zip(words, counter.lengths(words), strict=True))


def count_tokens(spark: SparkSession, documents: DataFrame, path: str, pattern: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit), one for each input row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated keys give one row each. Other columns are ignored.
    The tokenizer file must be readable by its path on every machine, as an installed package is.
    """
    prepare(spark)
    docs = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, pattern, "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PreTokenCounter(path, pattern, table.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counter.count(b.column(1).to_pylist()), pa.int64()), b.column(2)], names=["k", "n", "b"])

    kind = docs.schema["k"].dataType.simpleString()
    out = docs.select("k", "t", F.octet_length("t").cast("long").alias("b")).mapInArrow(run, f"k {kind}, n long, b long")
    return out.select(F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
