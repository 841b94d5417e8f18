"""Near-duplicate documents by one-permutation MinHash.

One hash of each shingle fills all bins of a signature (the hash's high bits choose the bin, the least value in a bin
is kept); an empty bin takes the value of the first filled bin on a probe sequence of its own, which is optimal
densification. Bands of the signature are the bucket keys. A bucket yields star-shaped candidate edges, from its
centre to each other member, never all pairs; edges are confirmed on full shingle sets.

Stars alone could miss a link between two members that are both unlike the centre. Buckets whose members are still in
different components afterwards are therefore settled exactly: members outside the largest component of their family
are compared with all others, in blocks, inside tasks that emit only links joining components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm._bytes import LOWER, U, joined, mix, space_words, span_hashes
from skysift.llm._common import Scratch, checkpointed, components, free_shuffles, prepare

#: Bins of a signature, rows of a band, probes before the direct search, shingles of a block, members of a block.
BINS, ROWS, PROBES, BLOCK_ITEMS, BLOCK_MEMBERS = 512, 8, 12, 400_000, 512
BANDS = BINS // ROWS
_SHIFT = U(64 - BINS.bit_length() + 1)
_K1, _K2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


@cache
def _probes() -> tuple[np.ndarray, np.ndarray]:
    """For each bin a random order of all bins: the t-th bin to look at, and each bin's place in the order."""
    rng = np.random.default_rng(7)
    order = np.stack([rng.permutation(BINS) for _ in range(BINS)])
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(BINS)[None, :].repeat(BINS, 0), 1)
    return np.ascontiguousarray(order.T), place.astype(np.int16)


def shingle_sets(column: pa.Array, size: int = 2) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of `size` words; fewer words are one run, none give none."""
    data, offsets = joined(column)
    low = LOWER[data]
    starts, ends, first = space_words(low, offsets)
    h = span_hashes(low, starts, ends)
    runs = h
    for k in range(1, size):
        runs = mix(runs[:-1] * _K1 + h[k:]) if len(runs) > 1 else runs[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            x = mix(np.uint64([b - a]) * _K2)
            for v in h[a:b]:
                x = mix(x * _K1 + v)
            out.append(x)
        else:
            out.append(h[:0])
    return out


def signature(items: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty sorted set."""
    bins = (items >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]] = items[first]
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order, place = _probes()
        source = np.full(len(empty), -1)
        left = np.arange(len(empty))
        for t in range(PROBES):
            at = order[t][empty[left]]
            ok = filled[at]
            source[left[ok]] = at[ok]
            left = left[~ok]
            if not len(left):
                break
        if len(left):
            have = bins[first]
            source[left] = have[place[empty[left]][:, have].argmin(1)]
        out[empty] = out[source]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, BANDS) bucket keys of (rows, BINS) signatures."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _K2, parts.shape[:2])
    for k in range(ROWS):
        key = mix(key * _K1 + parts[:, :, k])
    return key


def set_id(items: np.ndarray) -> int:
    """Identity of a set: equal sets have equal ids."""
    total = mix(items ^ _K2).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total * _K1 + U(len(items))).view(np.int64)[0])


def similar(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * common >= percent * (a + b - common)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1), size)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(np.stack([signature(sets[i]) for i in full])).view(np.int64) if full else np.zeros((0, BANDS), np.int64)
            offsets, n = np.zeros(len(sets) + 1, np.int32), np.array([len(s) for s in sets], np.int64)
            np.cumsum((n > 0) * BANDS, out=offsets[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array([set_id(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], names=["k", "n", "sid", "bands"])

    return run


def _full(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for s in shingle_sets(b.column(0), size) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "n", "items"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (a, b) if len(a) < len(b) else (b, a)
                if 100 * len(small) < percent * len(large):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if similar(int((large[at] == small).sum()), len(a), len(b), percent):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def joining_links(ids: list[int], labels: list[int], rows: list[np.ndarray], mine: list[int], others: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between rows of `mine` and `others` that join different labels, as many as join what they can, no more."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    sizes = np.array([len(rows[i]) for i in others])
    items = np.concatenate([rows[i] for i in others])
    owner = np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    out = []
    for i in mine:
        a = rows[i]
        lo, hi = np.searchsorted(items, a, "left"), np.searchsorted(items, a, "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        common = np.bincount(owner[at], minlength=len(others))
        for j in np.flatnonzero(similar(common, len(a), sizes, percent)).tolist():
            x, y = top(labels[i]), top(labels[others[j]])
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((ids[i], ids[others[j]]))
    return out


def _settle(percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids, labels = group["sid"].to_pylist(), group["label"].to_pylist()
        rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["items"].combine_chunks()]
        block, i, j = group["block"].to_pylist(), group["i"][0].as_py(), group["j"][0].as_py()
        mine, others = [k for k, b in enumerate(block) if b == i], [k for k, b in enumerate(block) if b == j]
        links = joining_links(ids, labels, rows, mine, others, percent) if mine and others else []
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def near_copies(spark: SparkSession, documents: DataFrame, percent: int = 80, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_shingles, component_id, kept), one for each document row.

    Two documents are linked if their sets of distinct `shingle`-word runs have a Jaccard similarity of `percent`
    hundredths or more; component_id is the smallest key reachable by links. Documents with equal sets are one class
    and stand in one component. A null or wordless text has no set and no link. Of rows with equal keys each is judged
    on its own text; a null key counts for no component's smallest key, and a component of null keys alone has a null
    id and is kept. An empty table gives an empty one. Other columns are ignored.

    Sets are compared as 64-bit hashes. A pair of exactly the least similarity shares a bucket with probability
    1 - (1 - 0.8**8)**64, over 0.99999; links are confirmed on whole sets, so there is no false one.
    """
    prepare(spark)
    scratch = Scratch(spark, "near")
    docs = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = docs.schema["k"].dataType.simpleString()
    rows = scratch.write(docs.mapInArrow(_sketch(shingle), f"k {kind}, n long, sid long, bands array<long>"), "rows")

    # equal sets are one class; a class has one row from here on
    classes = rows.where("n > 0").groupBy("sid").agg(F.min("k").alias("d0"), F.any_value("bands").alias("bands"))
    banded = classes.select("sid", F.explode_outer("bands").alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("sid").alias("centre"), F.count("*").alias("members")).where("members > 1")
    members = scratch.write(banded.join(centres, "bucket").select("bucket", "sid", "centre", "members"), "members")
    free_shuffles(spark)
    stars = scratch.write(members.where("sid <> centre").select(F.col("sid").alias("a"), F.col("centre").alias("b")).distinct(), "stars")

    # whole sets, of the documents that stand for a class with a candidate edge
    involved = stars.select(F.col("a").alias("sid")).union(stars.select(F.col("b").alias("sid"))).distinct()
    stand = rows.where("n > 0").groupBy("sid").agg(F.min("k").alias("k"), F.max(F.col("k").isNull()).alias("odd")).join(involved, "sid", "left_semi")
    stand = checkpointed(stand)
    picked = docs.join(stand.select("k").distinct(), "k", "left_semi").select("t")
    # a class whose keys are all null is found by text alone
    picked = picked.union(docs.where("k IS NULL").select("t"))
    sets = picked.mapInArrow(_full(shingle), "sid long, n long, items binary").join(involved, "sid", "left_semi").dropDuplicates(["sid"])
    sets = scratch.write(sets, "sets")
    free_shuffles(spark)

    by_a = stars.join(sets.select(F.col("sid").alias("a"), F.col("items").alias("x")), "a")
    both = by_a.join(sets.select(F.col("sid").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    links = scratch.write(both.mapInArrow(_confirm(percent), "a long, b long"), "links")
    free_shuffles(spark)
    label = checkpointed(components(links).select(F.col("node").alias("sid"), F.col("component").alias("label")))

    # buckets of three or more that still hold several components
    named = members.where("members > 2").join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    open_ = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    rest = checkpointed(named.join(open_, "bucket", "left_semi").select("sid", "centre", "label").distinct())
    final = label
    if rest.limit(1).count():
        family = components(rest.select(F.col("sid").alias("a"), F.col("centre").alias("b")))
        people = rest.select("sid").union(rest.select(F.col("centre").alias("sid"))).distinct()
        people = people.join(family, F.col("sid") == F.col("node")).select("sid", F.col("component").alias("family"))
        people = people.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid")).join(sets, "sid")
        people = scratch.write(people.select("sid", "family", "label", "n", "items"), "people")
        sizes = people.groupBy("family", "label").agg(F.count("*").alias("c"), F.sum("n").alias("z"))
        largest = sizes.groupBy("family").agg(F.max_by("label", F.struct("c", "label")).alias("major"))
        parts = lambda mine: F.greatest(F.ceil(F.sum(F.when(mine, F.col("z"))) / BLOCK_ITEMS), F.ceil(F.sum(F.when(mine, F.col("c"))) / BLOCK_MEMBERS), F.lit(0)).cast("int")
        is_major = F.col("label") == F.col("major")
        count = sizes.join(largest, "family").groupBy("family").agg(parts(is_major).alias("nm"), parts(~is_major).alias("nq"))
        count = count.join(largest, "family").where("nq > 0")
        placed = people.join(F.broadcast(count) if count.count() < 50_000 else count, "family")
        # blocks 0 .. nq-1 hold the members outside the largest component, nq .. nq+nm-1 those in it
        placed = placed.withColumn("block", F.when(F.col("label") == F.col("major"), F.col("nq") + F.pmod("sid", "nm")).otherwise(F.pmod("sid", "nq")).cast("int"))
        partners = F.sequence(F.lit(0), F.when(F.col("block") < F.col("nq"), F.col("nq") + F.col("nm")).otherwise(F.col("nq")) - 1)
        spread = placed.withColumn("p", F.explode_outer(partners)).select("family", F.least("block", "p").cast("int").alias("i"), F.greatest("block", "p").cast("int").alias("j"), "block", "sid", "label", "items")
        more = spread.groupBy("family", "i", "j").applyInArrow(_settle(percent), "a long, b long")
        by = label.select("sid", "label")
        more = more.join(by.select(F.col("sid").alias("a"), F.col("label").alias("la")), "a", "left").join(by.select(F.col("sid").alias("b"), F.col("label").alias("lb")), "b", "left")
        more = checkpointed(more.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct())
        if more.limit(1).count():
            over = components(more).select(F.col("node").alias("label"), F.col("component").alias("higher"))
            # a component of one node has no label row yet
            known = label.union(more.select(F.col("a").alias("sid"), F.col("a").alias("label"))).union(more.select(F.col("b").alias("sid"), F.col("b").alias("label"))).groupBy("sid").agg(F.min("label").alias("label"))
            final = checkpointed(known.join(over, "label", "left").select("sid", F.coalesce("higher", "label").alias("label")))
    named = rows.where("n > 0").groupBy("sid").agg(F.min("k").alias("d0")).join(final, "sid", "left")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("d0").alias("least"))
    of_class = named.join(least, "label", "left").select(F.col("sid").alias("csid"), F.coalesce("least", "d0").alias("component"))
    out = rows.select("k", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(of_class, F.col("sid") == F.col("csid"), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("k"))
    return scratch.keep(out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept")))


def keep_one(spark: SparkSession, documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with one of each group of near copies, that of the smallest key; all columns stay as they were.

    Rows are told apart by key and text (its SHA-256), so a repeated key keeps no copy alive. Null keys come after all
    others. Of rows with equal key and text one stays; of one group's rows with equal keys, that of the least digest.
    """
    row = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.coalesce(F.sha2(F.col(text), 256), F.lit("")).alias("h"))
    whole = documents.select(F.struct(*documents.columns).alias("document"), row.alias("row"), F.col(text).alias("t"))
    kept = near_copies(spark, whole.select("row", "t"), key="row", text="t", **options).where("kept").select(F.col("row.k").alias("kk"), F.col("row.h").alias("kh")).distinct()
    same = F.col("row.k").eqNullSafe(F.col("kk")) & (F.col("row.h") == F.col("kh"))
    return whole.join(kept, same, "left_semi").dropDuplicates(["row"]).select("document.*")
