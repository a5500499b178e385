"""A genome table clustered by place, with a small table of what each file holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fragx.operators.intervals import fetch_region


def write_clustered(df: DataFrame, path: str, columns: tuple[str, str, str] = ("contig", "st", "en"), files: int | None = None) -> None:
    """``df`` in ranges of (contig, start), sorted within each file, and beside it the spans per file and contig.

    A tie column takes part in the ranges, so a place that holds many rows
    spreads over files too. The spans are one row per file and contig.
    """
    contig, first, last = columns
    keys = [F.col(contig), F.col(first), F.xxhash64(*[F.col(c) for c in df.columns if not c.startswith("_")])]
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(contig, first, last).write.mode("overwrite").parquet(f"{path}/rows")
    spark = df.sparkSession
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows").select(contig, first, last, F.col("_metadata.file_path").alias("file"))
    spans = rows.groupBy("file", contig).agg(F.min(first).alias("low"), F.max(last).alias("high"), F.count(F.lit(1)).alias("rows"))
    spans.withColumnRenamed(contig, "contig").coalesce(1).write.mode("overwrite").parquet(f"{path}/spans")


def region_files(spark: SparkSession, path: str, contig: str, start: int | None = None, end: int | None = None) -> list[str]:
    """The files that can hold rows of the region, from the spans alone."""
    spans = fetch_region(spark.read.parquet(f"{path}/spans"), contig, start, end, ("contig", "low", "high"))
    return sorted(r.file for r in spans.select("file").distinct().collect())  # names of the files to open


def fetch_clustered(
    spark: SparkSession, path: str, contig: str, start: int | None = None, end: int | None = None,
    columns: tuple[str, str, str] = ("contig", "st", "en"),
) -> DataFrame:
    """Rows that overlap ``[start, end)``; files whose span misses the region are never opened."""
    files = region_files(spark, path, contig, start, end)
    rows = spark.read.parquet(f"{path}/rows")
    if not files:
        return rows.limit(0)
    return fetch_region(spark.read.schema(rows.schema).parquet(*files), contig, start, end, columns)
