"""Shared plumbing: tables, scratch storage that every executor can read, connected components (the engine's)."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from skysift.functions.graph import components, delete, shared_dir

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "Scratch", "checkpointed", "close_all", "components", "free_shuffles", "prepare", "shared_dir", "table"]

#: Rows and bytes of one Arrow batch that Python code sees; they bound a worker's memory when rows are long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on where the caller set none: small Arrow batches, and a checkpoint folder."""
    for name, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if have <= 0 or have > value:
            spark.conf.set(name, str(value))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


class Scratch:
    """Intermediate tables in the shared folder. They outlive lost executors; keep(), close() and close_all() remove them."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.tables, self.names = spark, [], []
        Scratch.made.append(self)
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """A table laid out by key, so that later joins on the key move only their other side."""
        known = f"scratch_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{self.root}/{name}").saveAsTable(known)
        self.tables.append(known)
        self.names.append(name)
        return self.spark.table(known)

    def remove(self, name: str) -> None:
        """Remove one table; a name that is gone already is no error."""
        delete(self.spark, f"{self.root}/{name}")
        if name in self.names:
            self.names.remove(name)

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write df as the result and remove all that it was made from; the result stays until close()."""
        old = list(self.names)
        out = self.write(df, name)
        self._drop_tables()
        for x in old:
            self.remove(x)
        return out

    def close(self) -> None:
        """Remove everything, results included."""
        self._drop_tables()
        delete(self.spark, self.root)
        self.names = []
        if self in Scratch.made:
            Scratch.made.remove(self)

    def _drop_tables(self) -> None:
        for known in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        self.tables = []


def close_all(but: tuple[Scratch, ...] = ()) -> None:
    """Close every open Scratch of this process but some: for callers that have written the results they want."""
    for x in [x for x in Scratch.made if x not in but]:
        x.close()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished passes before the next pass writes its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage; Spark's cleaner removes it when nothing refers to it any more."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)
