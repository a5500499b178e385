"""Keyed results of a stream as a snapshot plus the changes since, compacted every so many batches.

A folder holds ``changes/epoch=E/batch=B``, ``snapshots/epoch=E`` and ``versions``.
An epoch is ``every`` batches. Its last batch writes the next snapshot, an empty
first change of the next epoch, and at the end one row of ``versions``, which makes
the snapshot count; what was written before that row is written again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

EVERY = 20


def _version(spark: SparkSession, path: str) -> int:
    """The last epoch with a snapshot; -1 if there is none."""
    return spark.read.schema("epoch int").parquet(f"{path}/versions").agg(F.max("epoch").alias("e")).first().e


def _mark(spark: SparkSession, path: str, epoch: int) -> None:
    spark.range(1).select(F.lit(epoch).cast("int").alias("epoch")).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def _merged(spark: SparkSession, path: str, keys: list[str], epoch: int, upto: int | None = None) -> DataFrame:
    """The snapshot before ``epoch`` with the changes of that epoch: per key the row of the latest batch."""
    changes = spark.read.option("basePath", f"{path}/changes/epoch={epoch}").parquet(f"{path}/changes/epoch={epoch}")
    if upto is not None:
        changes = changes.filter(F.col("batch") <= upto)
    rows = changes.withColumn("batch", F.col("batch").cast("long"))
    if epoch:
        rows = rows.unionByName(spark.read.parquet(f"{path}/snapshots/epoch={epoch - 1}").withColumn("batch", F.lit(-2).cast("long")))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), "batch").alias("_r"))
    return last.select("_r.*").drop("batch")


def versioned_sink(keys: list[str], path: str, every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` in update mode: a batch replaces its own changes, and the epoch's last one compacts.

    A batch that comes again after its epoch was compacted changes nothing. A
    batch has at most one row per key, as update mode gives it.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark, epoch = df.sparkSession, batch // every
        if batch == 0:
            _mark(spark, path, -1)
        if epoch <= _version(spark, path):
            return
        df.write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}/batch={batch}")
        if batch % every == every - 1:
            _merged(spark, path, keys, epoch, batch).write.mode("overwrite").parquet(f"{path}/snapshots/epoch={epoch}")
            df.limit(0).write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch + 1}/batch=-1")
            _mark(spark, path, epoch)

    return write


def read_versioned(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of every key, from one snapshot and the changes of at most ``every`` batches."""
    return _merged(spark, path, keys, _version(spark, path) + 1)
