"""Regions as BED text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fragx.functions.region import normalize_contig


def read_bed(
    spark: SparkSession, path: str | list[str], contigs: list[str] | None = None, add_chr: bool = True,
    columns: list[str] | None = None, strict: bool = False,
) -> DataFrame:
    """Regions (contig, st, en) and the further fields: named ``columns``, else an array ``other``.

    Comment, track, browser and blank lines drop out; contigs get the ``chr``
    prefix; negative or inverted rows are an error; an empty region is widened
    by one, or with ``strict`` an error too.
    """
    lines = spark.read.text(path).filter(
        ~F.col("value").rlike(r"^(#|track|browser)") & (F.trim("value") != "")
    )
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.select(
        f[0].alias("_c"), f[1].cast("long").alias("st"), f[2].cast("long").alias("en"),
        F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0))).alias("other"), "value",
    )
    rows = rows.withColumn("contig", normalize_contig("_c") if add_chr else F.col("_c")).drop("_c")
    if contigs is not None:
        rows = rows.filter(F.col("contig").isin(*contigs))
    bad = (F.col("en") < F.col("st")) | (F.col("st") < 0)
    if strict:
        bad = bad | (F.col("st") == F.col("en"))
    message = F.concat(F.lit("invalid region: "), F.col("value"))
    checked = rows.withColumn("en", F.when(bad, F.raise_error(message).cast("long")).otherwise(
        F.when(F.col("st") == F.col("en"), F.col("en") + 1).otherwise(F.col("en"))
    ))
    if columns:
        extra = [F.get("other", F.lit(i)).alias(c) for i, c in enumerate(columns)]
        return checked.select("contig", "st", "en", *extra)
    return checked.select("contig", "st", "en", "other")


def write_bed(regions: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """BED text: contig, start, end and the named further columns."""
    fields = ["contig", "st", "en", *(columns or [])]
    regions.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in fields]).alias("value")).write.mode("overwrite").text(path)


def header_fields(spark: SparkSession, path: str) -> list[str] | None:
    """Payload names from the last ``#`` header line; null when there is none or the count differs from the rows."""
    heads = spark.read.text(path).filter(F.col("value").startswith("#")).withColumn("i", F.monotonically_increasing_id())
    line = heads.agg(F.max_by("value", "i")).first()[0]
    row = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track|browser)") & (F.trim("value") != "")).first()
    if line is None or row is None:
        return None
    names = line[1:].split()
    return names[3:] if len(names) == len(row[0].split()) else None
