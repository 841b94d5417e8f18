"""Embedding near-duplicates by NN-descent.

Neighbour lists start from vectors that are close in the order of random-hyperplane codes, and are refined by joining
the neighbours (and some reverse neighbours) of each vector with one another, until few lists change. Edges at or above
the threshold are links. A list that is full of links is saturated; its true neighbours may be more. So the saturated
vectors are searched again with lists for neighbours outside their component, until no list is full of links: a link
can be cut from both its ends only if both are saturated. Inside components every pair is then counted exactly, in
blocks: tasks emit one count a vector. An audit against brute force, for a query set over all rows, measures the share
of true links that lie inside the components; it grows until it has seen enough links. The number of orders grows with
the rows, so that two vectors at the threshold share a window in one of them; while the audit fails, more orders follow.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.llm._common import Scratch, checkpointed, components, free_shuffles, prepare

#: Neighbours of a list, orders laid out at once, vectors compared at once, reverse neighbours joined, rounds at most.
NEIGHBOURS, ORDERS, WINDOW, REVERSE, ROUNDS = 8, 3, 512, 8, 16
#: Share of list entries whose change means another round; wanted recall; members of a block.
SETTLED, RECALL, BLOCK = 0.02, 0.98, 512
#: Queries of the audit at first, at most (and their bytes), links it should see; expected share of links at the
#: threshold that miss each other in all orders; searches of the whole table before giving up.
AUDIT, AUDIT_MOST, AUDIT_BYTES, SEEN, MISSED, SEARCHES = 256, 16384, 32 << 20, 200, 0.005, 5


def _matrix(raw: list, double: bool) -> list[np.ndarray]:
    """Rows as unit vectors in double precision."""
    kind = np.float64 if double else np.float32
    out = []
    for x in raw:
        v = np.frombuffer(x.as_buffer() if isinstance(x, pa.Scalar) else x, kind).astype(np.float64)
        out.append(v / np.sqrt((v * v).sum()))
    return out


def cosines(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Pairwise cosines of unit vectors; -2 where dimensions differ."""
    if {len(x) for x in a} | {len(x) for x in b} == {len(a[0])}:
        return np.stack(a) @ np.stack(b).T
    out = np.full((len(a), len(b)), -2.0)
    for d in {len(x) for x in a} & {len(x) for x in b}:
        i, j = [k for k, x in enumerate(a) if len(x) == d], [k for k, x in enumerate(b) if len(x) == d]
        out[np.ix_(i, j)] = np.stack([a[k] for k in i]) @ np.stack([b[k] for k in j]).T
    return out


EDGE = "a long, b long, own boolean, s double"


def _edges(rows: list[tuple[int, int, bool, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.float64()))], names=["a", "b", "own", "s"])


def _codes(double: bool, orders: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            rows = _matrix(list(b.column(1)), double)
            ids, labels, code, order, keep = b.column(0).to_pylist(), b.column(2), [], [], []
            for i, v in enumerate(rows):
                if len(v) not in planes:
                    planes[len(v)] = np.stack([np.random.default_rng([11, t]).standard_normal((24, len(v))) for t in orders])
                bits = planes[len(v)] @ v > 0
                for t, o in enumerate(orders):
                    order.append(o)
                    code.append(int(np.packbits(bits[t]).view(np.uint8) @ np.array([65536, 256, 1])))
                    keep.append(i)
            taken = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int32()), pa.array(code, pa.int64()), pa.array([ids[i] for i in keep], pa.int64()), b.column(1).take(taken), labels.take(taken)], names=["o", "code", "id", "raw", "label"])

    return run


def _windows(double: bool, k: int):
    """The best neighbours of each vector, of its component and of others, among those near it in one order; windows
    follow each other in a partition."""

    def top(ids: list[int], rows: list[np.ndarray], labels: list[int]) -> pa.RecordBatch:
        s = cosines(rows, rows)
        np.fill_diagonal(s, -3)
        same = np.equal.outer(labels, labels)
        names, n, out = np.array(ids), min(k, len(ids) - 1), []
        for own in (False, True) if n and same.sum() > len(ids) else (False,):
            part = np.where(same == own, s, -3)
            best = np.argpartition(-part, n - 1, axis=1)[:, :n] if n else np.zeros((len(ids), 0), int)
            i, at = np.nonzero(np.take_along_axis(part, best, 1) > -2)
            j = best[i, at]
            out.append((names[i], names[j], np.full(len(i), own), s[i, j]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "own", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, ids, raw, labels = -1, [], [], []
        for b in batches:
            for o, i, r, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if o != order or len(ids) >= WINDOW:
                    if ids:
                        yield top(ids, _matrix(raw, double), labels)
                    order, ids, raw, labels = o, [], [], []
                ids.append(i)
                raw.append(r)
                labels.append(c)
        if ids:
            yield top(ids, _matrix(raw, double), labels)

    return run


def _local_join(double: bool, k: int):
    """Rows (centre, id, floor, own floor, raw, label) sorted by centre: for each member the others that beat the last
    entry of its list for their kind, component or others."""

    def join(ids: list[int], floors: list[tuple[float, float]], rows: list[np.ndarray], labels: list[int], out: list) -> None:
        if len(ids) < 2:
            return
        s = cosines(rows, rows)
        np.fill_diagonal(s, -3)
        same, floor = np.equal.outer(labels, labels), np.array(floors)
        better = s > np.where(same, floor[:, 1:], floor[:, :1])
        for i in np.flatnonzero(better.any(1)).tolist():
            for own in (False, True):
                js = np.flatnonzero(better[i] & (same[i] == own))
                for j in js[np.argsort(-s[i, js])[:k]].tolist():
                    out.append((ids[i], ids[j], own, float(s[i, j])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, ids, floors, raw, labels, out = None, [], [], [], [], []
        for b in batches:
            for c, i, f, g, r, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != centre:
                    join(ids, floors, _matrix(raw, double), labels, out)
                    centre, ids, floors, raw, labels = c, [], [], [], []
                ids.append(i)
                floors.append((f, g))
                raw.append(r)
                labels.append(n)
            if out:
                yield _edges(out)
                out = []
        join(ids, floors, _matrix(raw, double), labels, out)
        yield _edges(out)

    return run


def _audit(double: bool, queries, least: float):
    """Pairs (query, other) that are linked; `queries` is a broadcast list of (id, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = [i for i, _ in queries.value], _matrix([x for _, x in queries.value], double)
        for b in batches:
            ids, rows, out = b.column(0).to_pylist(), _matrix(list(b.column(1)), double), []
            for at in range(0, len(q) if rows else 0, 2048):
                s = cosines(q[at : at + 2048], rows)
                out += [(names[at + i], ids[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(s >= least)), strict=True) if names[at + i] != ids[j]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _counts(double: bool, least: float):
    """One pair of blocks of a component: how many vectors of the other block each vector links to, by weight."""

    def run(group: pa.Table) -> pa.Table:
        block, i, j = group["block"].to_pylist(), group["i"][0].as_py(), group["j"][0].as_py()
        ids, weight = group["id"].to_pylist(), np.array(group["weight"].to_pylist())
        rows = _matrix(list(group["raw"].combine_chunks()), double)
        x, y = [k for k, b in enumerate(block) if b == i], [k for k, b in enumerate(block) if b == j]
        if not x or not y:
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        linked = cosines([rows[k] for k in x], [rows[k] for k in y]) >= least
        if i == j:
            np.fill_diagonal(linked, False)
            found = dict(zip((ids[k] for k in x), (linked @ weight[y]).tolist(), strict=True))
        else:
            found = dict(zip((ids[k] for k in x), (linked @ weight[y]).tolist(), strict=True)) | dict(zip((ids[k] for k in y), (linked.T @ weight[x]).tolist(), strict=True))
        return pa.table({"id": pa.array(list(found), pa.int64()), "n": pa.array([int(v) for v in found.values()], pa.int64())})

    return run


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """Rows (a, own, list): the k best neighbours in the component of a (own) and the k best outside it, each with whether
    it is new (no edge of the same pair is marked old)."""
    old = F.col("old") if "old" in edges.columns else F.lit(False)
    best = edges.repartition("a").groupBy("a", "own", "b").agg(F.max("s").alias("s"), F.max(old).alias("old"))
    return best.groupBy("a", "own").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), "b", "old"))), 1, k).alias("list"))


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select("a", "own", F.explode("list").alias("x")).select("a", F.col("x.b").alias("b"), "own", (-F.col("x.d")).alias("s"), "x.old")


def neighbour_lists(spark: SparkSession, vectors: DataFrame, double: bool, scratch: Scratch, orders: range, told: Callable[[dict], None] | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """Rows (a, own, list<struct<d, b>>): for each of vectors(id, raw, label) the k nearest found of its label (own) and
    the k nearest of others, d = -cosine."""
    name = f"lists{orders.start}"
    lists = None
    for at in orders[::ORDERS]:
        coded = vectors.mapInArrow(_codes(double, range(at, min(at + ORDERS, orders.stop))), "o int, code long, id long, raw binary, label long")
        near = coded.repartitionByRange("o", "code").sortWithinPartitions("o", "code", "id").select("o", "id", "raw", "label")
        edges = near.mapInArrow(_windows(double, k), EDGE).withColumn("old", F.lit(False))
        lists = scratch.write(_lists(edges if lists is None else edges.union(_flat(lists)), k), f"{name}_o{at}")
        if at > orders.start:
            scratch.remove(f"{name}_o{at - ORDERS}")
        free_shuffles(spark)
    last = f"{name}_o{at}"
    for step in range(1, ROUNDS + 1):
        flat = _flat(lists)
        back = flat.groupBy(F.col("b").alias("centre"), F.pmod(F.xxhash64("a", F.lit(step)), F.lit(REVERSE)).alias("slot")).agg(F.min("a").alias("id")).select("centre", "id")
        forward = flat.select(F.col("a").alias("centre"), F.col("b").alias("id"))
        members = forward.union(back).union(lists.select(F.col("a").alias("centre"), F.col("a").alias("id"))).distinct()
        end = lambda own: F.max(F.when((F.col("own") == own) & (F.size("list") >= k), -F.element_at("list", -1)["d"]))
        floors = vectors.join(lists.groupBy(F.col("a").alias("id")).agg(end(False).alias("f"), end(True).alias("g")), "id", "left")
        floors = floors.select("id", F.coalesce("f", F.lit(-2.0)).alias("floor"), F.coalesce("g", F.lit(-2.0)).alias("own_floor"), "raw", "label")
        joined = members.join(floors, "id").select("centre", "id", "floor", "own_floor", "raw", "label")
        better = joined.repartition("centre").sortWithinPartitions("centre", "id").mapInArrow(_local_join(double, k), EDGE)
        known = flat.withColumn("old", F.lit(True)).union(better.withColumn("old", F.lit(False)))
        new = scratch.write(_lists(known, k), f"{name}_r{step}")
        changed, total = new.agg(F.sum(F.size(F.filter("list", lambda x: ~x["old"]))), F.sum(F.size("list"))).first()
        changed, total = changed or 0, total or 1
        scratch.remove(last)
        free_shuffles(spark)
        lists, last = new, f"{name}_r{step}"
        if told:
            told({"round": step, "changed": changed / total})
        if changed / total < SETTLED:
            break
    return lists


def _labelled(vectors: DataFrame, label: DataFrame | None) -> DataFrame:
    """vectors(id, raw) with the label of their component, or their id."""
    if label is None:
        return vectors.select("id", "raw", F.col("id").alias("label"))
    return vectors.select("id", "raw").join(label, "id", "left").select("id", "raw", F.coalesce("label", "id").alias("label"))


def orders_for(rows: int, least: float) -> int:
    """Orders in which two vectors at the threshold share a window at least once, but for a share MISSED of them.

    A window holds vectors whose codes agree in about log2(rows / WINDOW) leading bits; one more is for its borders.
    """
    if rows <= WINDOW:
        return 1
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    together = agree ** (math.log2(rows / WINDOW) + 1)
    return max(ORDERS, math.ceil(math.log(MISSED) / math.log1p(-together))) if together < 1 else ORDERS


def audited(spark: SparkSession, vectors: DataFrame, rows: int, double: bool, least: float) -> tuple[DataFrame, int, int]:
    """True links (a, b) of a query set a over all rows, their number, and that of the queries.

    Queries are dealt by a hash of the id; the set grows until it has seen SEEN links, has every row, or is as large as
    AUDIT_MOST and AUDIT_BYTES allow.
    """
    slots = 1 << 40
    width = vectors.agg(F.max(F.length("raw"))).first()[0] or 1
    most = max(AUDIT, min(AUDIT_MOST, AUDIT_BYTES // width))
    slot, true, seen, asked, low, wanted = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(slots)), None, 0, 0, 0, AUDIT
    while True:
        high = slots if wanted >= rows else int(slots * (wanted / rows))
        queries = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in vectors.where((slot >= low) & (slot < high)).collect()])
        more = checkpointed(vectors.mapInArrow(_audit(double, queries, least), "a long, b long"))
        true, seen, asked, low = more if true is None else true.union(more), seen + more.count(), asked + len(queries.value), high
        if seen >= SEEN or high == slots or wanted >= most:
            return true, seen, asked
        wanted = min(most, wanted * 8)


def linked(spark: SparkSession, vectors: DataFrame, double: bool, least: float, scratch: Scratch, told: Callable[[dict], None] | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """Rows (id, label): the component of each of vectors(id, raw) that has a link."""
    rows = vectors.count()
    true, n, asked = audited(spark, vectors, rows, double, least)
    wide = orders_for(rows, least)
    links, label, searched, orders, searches = None, None, _labelled(vectors, None), range(0, wide), 0
    while True:
        lists = neighbour_lists(spark, checkpointed(searched), double, scratch, orders, told, k)
        found = checkpointed(_flat(lists).where(~F.col("own") & (F.col("s") >= least)).select("a", "b"))
        links = found if links is None else links.union(found)
        label = checkpointed(components(links).select(F.col("node").alias("id"), F.col("component").alias("label")))
        full = lists.where(~F.col("own") & (F.size("list") >= k) & (-F.element_at("list", -1)["d"] >= least)).select(F.col("a").alias("id"))
        orders = range(orders.stop, orders.stop + wide)
        searched = checkpointed(_labelled(searched.join(full, "id", "left_semi"), label))
        if searched.select("label").distinct().limit(2).count() == 2:
            continue
        searches += 1
        x, y = label.select(F.col("id").alias("a"), F.col("label").alias("x")), label.select(F.col("id").alias("b"), F.col("label").alias("y"))
        inside = true.join(x, "a", "left").join(y, "b", "left").where("x = y").count()
        if told:
            told({"search": searches, "asked": asked, "audited": n, "recall": inside / n if n else None})
        if inside >= RECALL * n:
            return label
        if searches == SEARCHES:
            raise RuntimeError(f"only {inside} of {n} audited links found after {searches} searches of {wide} orders")
        searched = _labelled(vectors, label)


def near_vectors(spark: SparkSession, embeddings: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding", told: Callable[[dict], None] | None = None) -> DataFrame:
    """Rows (key, n_links, component_id, kept), one for each row.

    Two vectors of equal length are linked if their cosine, in double precision, is at least `least`. A vector that is
    null, empty, zero, or holds a null or non-finite component links with nothing; its component is its own key. Equal
    vectors are searched once and counted as often as they occur. Keys must be integers; rows with a null key take part
    with a null id, and repeated keys are rows of their own. An empty table gives an empty one. Search is approximate:
    an audit that finds less than RECALL of the true links raises; links are always exact, and so are counts inside a
    found component.
    """
    prepare(spark)
    scratch = Scratch(spark, "nn")
    double = isinstance(embeddings.schema[vector].dataType.elementType, T.DoubleType)
    v = F.col(vector)
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col(key).alias("k"), F.when(finite, v).alias("v"))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("weight"), F.min("k").alias("least"))
    classes = classes.select(F.xxhash64("v").alias("id"), "v", "weight", "least")
    kind = np.float64 if double else np.float32

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(x, kind).tobytes() for x in b.column(1).to_pylist()], pa.binary()), b.column(2), b.column(3)], names=["id", "raw", "weight", "least"])

    classes = scratch.write(classes.mapInArrow(raw, f"id long, raw binary, weight long, least {rows.schema['k'].dataType.simpleString()}"), "classes")
    label = linked(spark, classes.select("id", "raw"), double, least, scratch, told)
    people = classes.join(label, "id")
    size = label.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = people.join(size, "label").withColumn("block", F.pmod("id", "parts").cast("int"))
    spread = placed.withColumn("p", F.explode_outer(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("label", F.least("block", "p").alias("i"), F.greatest("block", "p").alias("j"), "block", "id", "weight", "raw")
    counted = spread.groupBy("label", "i", "j").applyInArrow(_counts(double, least), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    lowest = classes.join(label, "id").groupBy("label").agg(F.min("least").alias("lowest"))
    info = classes.select("id", "weight", "least").join(label, "id", "left").join(counted, "id", "left").join(lowest, "label", "left")
    info = info.select(F.col("id").alias("cid"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("lowest", "least").alias("c"))
    out = rows.select("k", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("id")).join(info, F.col("id") == F.col("cid"), "left")
    component = F.when(F.col("id").isNull(), F.col("k")).otherwise(F.col("c"))
    return scratch.keep(out.select(F.col("k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("k").eqNullSafe(component).alias("kept")))
