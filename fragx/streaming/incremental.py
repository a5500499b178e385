"""The incremental counters and the call writer as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fragx.operators.bins import bin_counts
from fragx.session import ensure_checkpoint_dir
from fragx.streaming.state import versioned_sink


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_bin_counts(
    stream: DataFrame, keys: list[str], window: int, output: str, checkpoint: str, pos: str = "pos", drain: bool = True
):
    """Running counts per bin: the batch operator in update mode, written per batch by ``foreachBatch``.

    State is one row per bin. A batch overwrites its own folder, so a batch that
    runs again after a failure changes nothing; ``latest_counts`` reads the result.
    """
    counts = bin_counts(stream, keys, window, pos)
    return _start(counts.writeStream.outputMode("update"), _by_batch(output), checkpoint, drain)


def stream_versioned_counts(
    stream: DataFrame, keys: list[str], window: int, output: str, checkpoint: str, pos: str = "pos", every: int = 20, drain: bool = True
):
    """``stream_bin_counts`` into a snapshot with changes that is compacted every so many batches; ``state.read_versioned`` reads it."""
    counts = bin_counts(stream, keys, window, pos)
    return _start(counts.writeStream.outputMode("update"), versioned_sink([*keys, "start"], output, every), checkpoint, drain)


def stream_confusion(stream: DataFrame, truth: str, predicted: str, output: str, checkpoint: str, drain: bool = True):
    """Running confusion counts; the whole small matrix is written with every batch."""
    counts = stream.groupBy(F.col(truth).cast("int").alias("y"), F.col(predicted).cast("int").alias("yhat")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _start(counts.writeStream.outputMode("complete"), _by_batch(output), checkpoint, drain)


def stream_call_sink(
    stream: DataFrame, call: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, drain: bool = True
):
    """Calls of every batch appended to a table keyed by batch; the source waits, nothing is dropped."""
    write = _by_batch(output)
    return _start(stream.writeStream.outputMode("append"), lambda df, batch: write(call(df), batch), checkpoint, drain)


def _by_batch(output: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{output}/batch={batch}")

    return write


def _start(writer, write, checkpoint, drain):
    writer = writer.foreachBatch(write).option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    query = writer.start()
    if drain:
        query.awaitTermination()
    return query


def latest_counts(spark: SparkSession, output: str, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    rows = spark.read.parquet(output)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), "batch").alias("_r"))
    return last.select("_r.*").drop("batch")


def last_batch(spark: SparkSession, output: str) -> DataFrame:
    """The rows of the last batch, for complete output."""
    rows = spark.read.parquet(output)
    return rows.filter(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, for state and output of one run."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
