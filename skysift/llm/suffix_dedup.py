"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every pair of positions i, j has a shift below v that takes both into a difference-cover sample (positions whose
remainder modulo v lies in D). So if the `length`-byte strings at i and j are equal, two sample strings of
length - v + 1 bytes inside them are equal too.

1. Documents are laid out in key order as blocks: text packed into bounded binary rows, in a table bucketed by block.
2. Ranks of the cover sample are found: whether each sample string may occur again anywhere. Blocks send their sorted
   distinct sample fingerprints to rank buckets, which answer with one bit each. Unequal fingerprints prove unequal
   strings, so a bit can only be set too often, which costs time and no result.
3. A suffix none of whose sample positions is repeated ties with no other over `length` bytes and needs no sorting.
   The rest go into suffix buckets with their real bytes, sorted one group of buckets at a time. The bucket of a suffix
   is set by its anchor: the string of GRAM bytes in its first `length` bytes that comes first in a fixed order. Equal
   suffixes have equal anchors, and neighbours mostly share one, so a run of neighbours is shipped once as one stretch of
   text. A bucket is ordered by fingerprint; ties are compared byte by byte, and where a tie proves false its group is
   ordered by bytes. So no decision rests on a fingerprint. A bucket that outgrows its bound (a common anchor) is dealt
   again by the whole string. Each suffix is answered with one bit: whether an equal one starts earlier.
4. Blocks turn the answers into removed spans.

A block sends a stretch once however often it holds it, so a passage that fills the corpus costs one stretch a block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skysift.llm._bytes import U, joined, mix, powers, prefix_sums
from skysift.llm._common import Scratch, free_shuffles, prepare

#: Perfect difference sets: modulus -> residues.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Bytes of text in a block and of keys in a rank bucket, groups of suffix buckets sorted in turn, bytes hashed at once.
BLOCK, BUCKET, GROUPS, CHUNK = 8 << 20, 16 << 20, 2, 1 << 19
#: Bytes of an anchor, of text in a suffix bucket as aimed at and as dealt again beyond, of shuffled data for one task.
GRAM, STRETCHES, HOT, TASK = 24, 4 << 20, 24 << 20, 64 << 20
#: Spark's own limit on the buckets of a table; a larger corpus needs spark.sql.sources.bucketing.maxBuckets raised.
MOST_BUCKETS = 100_000


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The largest cover whose sample strings keep two fifths of the length."""
    v = max((m for m in COVERS if m <= 0.6 * length), default=0)
    if not v:
        raise ValueError("strings of under 12 bytes are too short")
    residue = np.zeros(v, bool)
    residue[list(COVERS[v])] = True
    return v, residue


def hashes_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit fingerprints of the strings of `length` bytes that start at the sorted positions `at`."""
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + CHUNK, CHUNK))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        base = k * CHUNK
        sums = prefix_sums(data[base : base + CHUNK + length])
        p = at[a:b] - base
        out[a:b] = mix((sums[p + length] - sums[p]) * powers(CHUNK, inverse=True)[p])
    return out


def locals_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of a block its offset in its document, and how many bytes of the document begin there."""
    total = int(sizes.sum())
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    at = (np.arange(total, dtype=np.int64) - np.repeat(starts, sizes)).astype(np.int32)
    return at, np.repeat(sizes, sizes).astype(np.int32) - at


def sample_positions(sizes: np.ndarray, length: int) -> np.ndarray:
    """Positions of the cover sample whose strings fit into their documents."""
    v, residue = cover_for(length)
    at, left = locals_of(sizes)
    return np.flatnonzero(residue[at % v] & (left >= length - v + 1))


def candidate_starts(sizes: np.ndarray, repeated: np.ndarray, length: int) -> np.ndarray:
    """Mask of the strings that hold a repeated sample string within the cover's reach."""
    v, _ = cover_for(length)
    at, left = locals_of(sizes)
    total = len(at)
    change = np.zeros(total + 1, np.int32)
    lows = repeated - np.minimum(at[repeated], v - 1)
    np.add.at(change, lows, 1)
    np.add.at(change, repeated + 1, -1)
    return (np.cumsum(change[:-1]) > 0) & (left >= length)


def packed(values: np.ndarray, width: int) -> bytes:
    """The leading `width` bytes of each 64-bit value."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, 8 - width :]).tobytes()


def unpacked(raw: pa.Scalar | bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(raw.as_buffer() if isinstance(raw, pa.Scalar) else raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - width :] = raw
    return out.view(np.uint64).ravel()


def _split(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted values by their leading bits."""
    if not bits:
        yield 0, values
        return
    edges = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << U(64 - bits))
    for k, part in enumerate(np.split(values, edges)):
        if len(part):
            yield k, part


def _bits(answers: list, keys: np.ndarray, bits: int) -> np.ndarray:
    """The buckets' answers for sorted keys, in the keys' order."""
    by = {x["bucket"]: x["bits"] for x in answers or ()}
    out = [np.unpackbits(np.frombuffer(by[k], np.uint8), count=len(part)) for k, part in _split(keys, bits)]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def _blocks(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        serial, ids, sizes, raw, size = 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            blob = pa.compress(b"".join(raw), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | serial], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([blob], pa.binary())], names=["block", "ids", "sizes", "blob"])

        for b in batches:
            data, offsets = joined(b.column(1))
            keys = b.column(0).to_pylist()
            for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if size and size + y - x > BLOCK:
                    yield row()
                    serial, ids, sizes, raw, size = serial + 1, [], [], [], 0
                ids.append(keys[i])
                sizes.append(y - x)
                raw.append(data[x:y].tobytes())
                size += y - x
        if ids:
            yield row()

    return run


def _open(sizes: pa.Scalar, blob: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(sizes.values.to_numpy(zero_copy_only=False), np.int64)
    return sizes, np.frombuffer(pa.decompress(blob.as_py(), int(sizes.sum()), codec="zstd", asbytes=True), np.uint8)


def _keys_batch(block: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], names=["bucket", "block", "keys"])


def _samples(length: int, bits: int, width: int):
    v, _ = cover_for(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sizes, data = _open(b.column(1)[i], b.column(2)[i])
                keys = np.unique(hashes_at(data, sample_positions(sizes, length), length - v + 1))
                yield _keys_batch(b.column(0)[i].as_py(), [(k, packed(x, width)) for k, x in _split(keys, bits)])

    return run


def _answer(width: int):
    """For the keys of one rank bucket: whether another block has the key too."""

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["block"].to_numpy())
        keys = group["keys"].combine_chunks()
        parts = [unpacked(keys[int(i)], width) for i in order]
        values = np.concatenate(parts)
        by = np.argsort(values, kind="stable")
        same = np.concatenate(([False], values[by][1:] == values[by][:-1]))
        same[:-1] |= same[1:]
        flags = np.empty(len(values), bool)
        flags[by] = same
        out = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum([len(p) for p in parts])[:-1])]
        return pa.table({"block": group["block"].take(pa.array(order)), "bucket": group["bucket"].take(pa.array(order)), "bits": pa.array(out, pa.binary())})

    return run


def _candidates(length: int, bits: int):
    v, _ = cover_for(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sizes, data = _open(b.column(1)[i], b.column(2)[i])
                at = sample_positions(sizes, length)
                keys, inverse, counts = np.unique(hashes_at(data, at, length - v + 1), return_inverse=True, return_counts=True)
                again = _bits(b.column(3)[i].as_py(), keys, bits) | (counts > 1)
                mask = candidate_starts(sizes, at[again[inverse]], length)
                raw = pa.compress(np.packbits(mask).tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([raw], pa.binary()), pa.array([int(mask.sum())], pa.int64())], names=["mblock", "mask", "n"])

    return run


def _starts(sizes: np.ndarray, mask: pa.Scalar) -> np.ndarray:
    total = int(sizes.sum())
    raw = pa.decompress(mask.as_py(), (total + 7) // 8, codec="zstd", asbytes=True)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), count=total))


def anchors_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The least gram hash inside each string of `length` bytes that starts at the sorted positions `at`."""
    gram = min(GRAM, length)
    span = length - gram + 1
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + CHUNK, CHUNK))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if a == b:
            continue
        part = data[k * CHUNK : (k + 1) * CHUNK + length]
        sums = prefix_sums(part)
        least = mix((sums[gram:] - sums[:-gram]) * powers(CHUNK + length, inverse=True)[: len(part) - gram + 1])
        width = 1
        while width < span:
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        out[a:b] = least[at[a:b] - k * CHUNK]
    return out


@dataclass
class Stretches:
    """A block's candidate suffixes as stretches of neighbours with one anchor, equal stretches once.

    run: of each candidate, its stretch among all; of: of each of these, its place among the distinct ones; first:
    whether it is the first of its kind; bucket, texts, counts: of the distinct ones, in order of appearance.
    """

    run: np.ndarray
    of: np.ndarray
    first: np.ndarray
    bucket: np.ndarray
    texts: list[bytes]
    counts: np.ndarray

    @classmethod
    def find(cls, data: np.ndarray, at: np.ndarray, length: int, bits: int, group: int | None = None) -> Stretches:
        """With a group, only the stretches of that group's buckets (their number among all stays)."""
        anchor = anchors_at(data, at, length)
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
        heads = np.flatnonzero(cut)
        counts = np.diff(np.append(heads, len(at)))
        named = mix(anchor[heads] ^ U(0x5851F42D4C957F2D))
        bucket = (named >> U(64 - bits)).astype(np.int64)
        wanted = np.ones(len(heads), bool) if group is None else bucket % GROUPS == group
        raw, known = data.tobytes(), {}
        of, first, texts, buckets, sizes = np.full(len(heads), -1), np.zeros(len(heads), bool), [], [], []
        starts = at[heads].tolist()
        ends = (at[heads] + counts + length - 1).tolist()
        which = bucket.tolist()
        for k in np.flatnonzero(wanted).tolist():
            text = raw[starts[k] : ends[k]]
            place = known.setdefault(text, len(texts))
            of[k] = place
            if place == len(texts):
                first[k] = True
                texts.append(text)
                buckets.append(which[k])
                sizes.append(ends[k] - starts[k] - length + 1)
        return cls(np.cumsum(cut) - 1, of, first, np.array(buckets, np.int64), texts, np.array(sizes, np.int64))

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket's distinct stretches, in order of appearance."""
        order = np.argsort(self.bucket, kind="stable")
        edges = np.flatnonzero(np.diff(self.bucket[order])) + 1
        for part in np.split(order, edges):
            if len(part):
                yield int(self.bucket[part[0]]), part


SENT = "bucket long, block long, sub int, counts binary, at binary, size long, texts binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "block", "sub", "counts", "at", "size", "texts"])


def _suffixes(length: int, bits: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sizes, data = _open(b.column(1)[i], b.column(2)[i])
                found = Stretches.find(data, _starts(sizes, b.column(3)[i]), length, bits, group)
                block = b.column(0)[i].as_py()
                rows = []
                for bucket, part in found.by_bucket():
                    text = b"".join(found.texts[k] for k in part.tolist())
                    rows.append((bucket, block, 0, found.counts[part].tobytes(), None, len(text), pa.compress(text, codec="zstd", asbytes=True)))
                yield _sent(rows)

    return run


def _texts_of(size: pa.Scalar, texts: pa.Scalar) -> np.ndarray:
    return np.frombuffer(pa.decompress(texts.as_buffer(), size.as_py(), codec="zstd"), np.uint8)


def _places(counts: np.ndarray, length: int) -> np.ndarray:
    """Where the suffixes of stretches begin in the stretches' joined text."""
    bases = np.cumsum(counts + length - 1) - (counts + length - 1)
    return np.repeat(bases - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _again(length: int, parts: int):
    """The suffixes of a bucket's row one by one, dealt over `parts` sub-buckets by their whole strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = _texts_of(b.column(5)[i], b.column(6)[i])
                at = _places(np.frombuffer(b.column(3)[i].as_buffer(), np.int64), length)
                sub = (hashes_at(data, at, length) >> U(20)) % U(parts)
                rows = []
                for k in np.unique(sub).tolist():
                    own = np.flatnonzero(sub == k)
                    text = data[at[own][:, None] + np.arange(length)].tobytes()
                    rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), 1 + k, np.ones(len(own), np.int64).tobytes(), own.astype(np.int32).tobytes(), len(text), pa.compress(text, codec="zstd", asbytes=True)))
                yield _sent(rows)

    return run


def repeated(data: np.ndarray, at: np.ndarray, length: int, names: Callable[[np.ndarray, np.ndarray, int], np.ndarray] = hashes_at) -> np.ndarray:
    """For each string of `length` bytes at the sorted positions `at`: whether an equal one is earlier in `at`. Exact."""
    h = names(data, at, length)
    order = np.argsort(h, kind="stable")
    tied = np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1
    out = np.zeros(len(at), bool)
    out[order[tied]] = True
    a, b = at[order[tied - 1]], at[order[tied]]
    step = 8 if length >= 8 else 1
    words = np.lib.stride_tricks.as_strided(data[:step].view(np.uint64 if step == 8 else np.uint8), (max(len(data) - step + 1, 0),), (1,)) if len(data) >= step else data
    false = np.zeros(len(tied), bool)
    for k in sorted({*range(0, length - step + 1, step), length - step}):
        false |= words[a + k] != words[b + k]
    if false.any():
        # equal names of unequal strings: these groups are settled by their bytes
        groups = np.concatenate(([0], np.cumsum(h[order[1:]] != h[order[:-1]])))
        bad = np.isin(groups, groups[tied[false]])
        seen: set[bytes] = set()
        for k in np.sort(order[bad]).tolist():
            text = data[at[k] : at[k] + length].tobytes()
            out[k] = text in seen
            seen.add(text)
    return out


def _sorted_bucket(length: int):
    """One suffix bucket: a bit for each suffix, whether an equal one starts in an earlier block or earlier in its own."""

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group["block"].to_numpy(), kind="stable")))
        counts = [np.frombuffer(x.as_buffer(), np.int64) for x in group["counts"].combine_chunks()]
        data = np.concatenate([_texts_of(s, t) for s, t in zip(group["size"], group["texts"], strict=True)])
        flags = repeated(data, _places(np.concatenate(counts), length), length)
        out = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum([int(c.sum()) for c in counts])[:-1])]
        return pa.table({"block": group["block"], "bucket": group["bucket"], "at": group["at"], "bits": pa.array(out, pa.binary())})

    return run


def _flags(answers: list, found: Stretches) -> np.ndarray:
    """Of each candidate suffix of a block, whether an equal one starts earlier."""
    starts = np.cumsum(found.counts) - found.counts
    flags, by = np.zeros(int(found.counts.sum()), bool), {}
    for x in answers or ():
        by.setdefault(x["bucket"], []).append(x)
    for bucket, part in found.by_bucket():
        n = found.counts[part]
        place = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        for x in by[bucket]:
            own = place if x["at"] is None else place[np.frombuffer(x["at"], np.int32)]
            flags[own] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=len(own))
    # candidates lie in their stretch in order; a stretch seen before repeats as a whole
    heads = np.flatnonzero(np.diff(found.run, prepend=-1))
    within = np.arange(len(found.run)) - heads[found.run] if len(heads) else np.zeros(0, int)
    return ~found.first[found.run] | flags[starts[found.of[found.run]] + within] if len(heads) else np.zeros(0, bool)


def _results(length: int, bits: int, kind: pa.DataType, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sizes, data = _open(b.column(2)[i], b.column(3)[i])
                at = _starts(sizes, b.column(4)[i])
                starts = at[_flags(b.column(5)[i].as_py(), Stretches.find(data, at, length, bits))]
                change = np.zeros(len(data) + 1, np.int32)
                change[starts] += 1
                change[starts + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                begin = offsets[:-1][sizes > 0]
                edge[begin] = gone[begin]
                count = lambda m: np.add.reduceat(np.concatenate((m.astype(np.int64), [0])), offsets[:-1]) * (sizes > 0)
                kept, ends = data[~gone], np.concatenate(([0], np.cumsum(sizes - count(gone))))
                texts = [kept[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                cols = [b.column(1)[i].values, pa.array(sizes), pa.array(count(gone)), pa.array(count(edge)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_bytes:
                    cols, names = [*cols, pa.array(texts, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def remove_repeats(spark: SparkSession, documents: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one for each document row.

    A byte is removed if some `length`-byte string over it also starts earlier: in a document of smaller key, or in
    the same one at an earlier start. Strings are judged on the input and never cross documents. Null texts count as
    empty. Rows with equal keys count as separate documents in the order of their texts, null keys as smallest. Keys may
    be of any type that can be ordered. An empty table gives an empty one. with_bytes adds the remaining bytes (which may
    cut a character). Strings are equal if their bytes are.
    """
    prepare(spark)
    scratch = Scratch(spark, "suffix")
    docs = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    field = docs.schema["k"].dataType
    kind = to_arrow_type(field)
    # tasks of a bounded size whatever the input: the session's number of partitions is only the least
    total = int(docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK))
    ordered = docs.repartitionByRange(n_parts, "k", F.left("t", F.lit(32))).sortWithinPartitions("k", "t")
    layout = f"block long, ids array<{field.simpleString()}>, sizes array<long>, blob binary"
    blocks = scratch.write_bucketed(ordered.mapInArrow(_blocks(kind), layout), "blocks", "block", min(max(8, n_parts), MOST_BUCKETS))
    free_shuffles(spark)

    bits = max(6, math.ceil(math.log2(max(total, 1) / BUCKET + 1)))
    width = min(8, math.ceil((math.log2(total + 2) + 10) / 8))
    n_tasks = max(n_parts, math.ceil(1.5 * total / TASK))
    keyed = "bucket int, block long, keys binary"
    answered = "block long, bucket int, bits binary"

    sampled = blocks.select("block", "sizes", "blob").mapInArrow(_samples(length, bits, width), keyed)
    ranks = sampled.repartition(n_tasks, "bucket").groupBy("bucket").applyInArrow(_answer(width), answered)
    per_block = lambda df, *more: df.groupBy(F.col("block").alias("ablock")).agg(F.collect_list(F.struct(*more, "bucket", "bits")).alias("answers"))
    ranks = scratch.write(per_block(ranks), "ranks")
    free_shuffles(spark)
    masks = blocks.join(ranks, F.col("block") == F.col("ablock"), "left").select("block", "sizes", "blob", "answers").mapInArrow(_candidates(length, bits), "mblock long, mask binary, n long")
    masks = scratch.write(masks, "masks")
    scratch.remove("ranks")

    candidates = int(masks.agg(F.sum("n")).first()[0] or 0)
    sbits = max(6, math.ceil(math.log2(3.5 * candidates / STRETCHES + 1)))
    answers = None
    for group in range(GROUPS):
        masked = blocks.join(masks, F.col("block") == F.col("mblock")).select("block", "sizes", "blob", "mask")
        sent = scratch.write(masked.mapInArrow(_suffixes(length, sbits, group), SENT), "sent")
        sizes = sent.groupBy("bucket").agg(F.sum("size").alias("z")).where(F.col("z") > HOT)
        hot = int(sizes.agg(F.max("z")).first()[0] or 0)
        if hot:
            again = sent.join(sizes.select("bucket"), "bucket", "left_semi").select(*sent.columns).mapInArrow(_again(length, math.ceil(hot / HOT) * 32), SENT)
            sent = sent.join(sizes.select("bucket"), "bucket", "left_anti").select(*sent.columns).union(again)
        dealt = sent.repartition(n_tasks, "bucket", "sub").groupBy("bucket", "sub")
        got = scratch.write(dealt.applyInArrow(_sorted_bucket(length), "block long, bucket long, at binary, bits binary"), f"group{group}")
        answers = got if answers is None else answers.union(got)
        scratch.remove("sent")
        free_shuffles(spark)
    answers = per_block(answers, "at")
    whole = blocks.join(masks, F.col("block") == F.col("mblock")).join(answers, F.col("block") == F.col("ablock"), "left").select("block", "ids", "sizes", "blob", "mask", "answers")
    schema = f"k {field.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return scratch.keep(whole.mapInArrow(_results(length, sbits, kind, with_bytes), schema).withColumnRenamed("k", key))
