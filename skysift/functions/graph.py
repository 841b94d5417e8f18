"""Connected components of edge tables of any size."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A node of more edges than this (what one task takes with ease), and more than two in HUBS of all edges, is a hub; so
#: there are at most HUBS hubs.
HUB, HUBS = 50_000, 5000
#: Edges that one task takes whole (some 300 MB).
LOCAL = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    One of our own only in local mode, where driver and executors are one process; on a cluster that names none, refuse.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="skysift-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _looked_up(rows: DataFrame, key: str, table: DataFrame, value: str, total: int, n: str | None = None) -> DataFrame:
    """rows with the value that table(key, value) has for their key, if any. Rows of a hub stay where they are: its one
    answer is sent to them. `n`: a column of table, at least the number of rows of the key, where it has all keys; without
    it they are counted."""
    bar, known = max(HUB, 2 * total // HUBS), table.select(key, value)
    if total <= bar:
        return rows.join(known, key, "left")
    hubs = table.where(F.col(n) > bar).select(key, value) if n else rows.groupBy(key).count().where(F.col("count") > bar).select(key).join(known, key, "left")
    hubs = F.broadcast(hubs)  # HUBS rows at most
    return rows.join(hubs.select(key), key, "left_anti").join(known, key, "left").unionByName(rows.join(hubs, key))


def _in_one_task():
    """Edges (u, v) -> (node, root), the root the least node. A closure, so that workers needn't find this module."""

    def run(parts):
        parts = [(p["u"].to_numpy(), p["v"].to_numpy()) for p in parts if len(p)]
        if not parts:
            return
        nodes, at = np.unique(np.concatenate([u for u, _ in parts] + [v for _, v in parts]), return_inverse=True)
        up = np.arange(len(nodes))
        a, b = np.split(at, 2)
        while len(a):  # roots hook to their least neighbour until no edge is left
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(up, high, low)
            while (up[up] != up).any():
                up = up[up]
            a, b = up[low], up[high]
            a, b = a[a != b], b[a != b]
        yield pd.DataFrame({"node": nodes, "root": nodes[up]})

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), component = smallest node.

    Randomised contraction: each round a node is merged into that of its neighbours and itself which a hash of the round
    puts first, so that nodes fall to three quarters at most on average, for chains of any length and order; what one task
    takes (LOCAL edges) is finished there, and the rounds are then undone. Raises if that isn't reached. Each round is
    written to the shared folder, which cuts the lineage and survives lost executors. Firsts are combined before the
    shuffle, hubs are joined where their edges lie, and the driver sees one count a round.
    Nodes without an edge do not appear. Self-edges and repeated edges are harmless. An empty table gives an empty one.
    """
    spark, merged = edges.sparkSession, []
    folder = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def linked(df: DataFrame, name: str) -> DataFrame:
        return written(df.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), name)

    e = linked(edges, "0")
    total = e.count()
    while total > LOCAL:
        if len(merged) == rounds:
            raise RuntimeError("components did not settle")
        rank = lambda c: F.xxhash64(c, F.lit(len(merged)))  # noqa: B023, E731
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("v"), F.count("*").alias("n"))
        into = written(first.select("u", F.when(rank("v") < rank("u"), F.col("v")).otherwise(F.col("u")).alias("r"), "n"), f"{len(merged)}-into")
        half = _looked_up(e, "u", into, "r", total, "n").select(F.col("r").alias("a"), "v")
        whole = _looked_up(half, "v", into.select(F.col("u").alias("v"), F.col("r").alias("b"), "n"), "b", total, "n")
        merged.append((into, total))
        e = linked(whole, str(len(merged)))
        delete(spark, f"{folder}/{len(merged) - 1}")
        total = e.count()
    kind = e.schema["u"].dataType.simpleString()
    label = written(e.coalesce(1).mapInPandas(_in_one_task(), f"node {kind}, root {kind}"), "label")
    for n, (into, size) in reversed(list(enumerate(merged))):
        # nodes merged into one that has no edge left are done
        roots = label.select(F.col("node").alias("r"), "root")
        label = written(_looked_up(into.select("u", "r"), "r", roots, "root", 2 * size).select(F.col("u").alias("node"), F.coalesce("root", "r").alias("root")), f"{n}-label")
        delete(spark, f"{folder}/{n}-into")
        delete(spark, f"{folder}/{n + 1}-label" if n + 1 < len(merged) else f"{folder}/label")
    delete(spark, f"{folder}/{len(merged)}")
    if not merged:
        return label.withColumnRenamed("root", "component")
    least = label.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    return _looked_up(label, "root", least, "component", 2 * merged[0][1], "n").select("node", "component")
