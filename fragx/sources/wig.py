"""Tracks as WIG text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_wig(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, start, end, value), 0-based, from fixedStep and variableStep blocks.

    A track file is one value per bin, so a file fits a task; many files run in
    parallel. The span defaults to 1. Data without a header and unreadable
    numbers are errors.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("_t"))
    blocks = text.select(F.posexplode(F.split("_t", r"(?m)^(?=fixedStep|variableStep)")).alias("_i", "_b"))
    lines = F.filter(
        F.transform(F.split("_b", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(track|#)")
    )
    cut = blocks.select("_i", lines.alias("_l")).filter(F.size("_l") > 0)
    head = F.get("_l", F.lit(0))
    is_head = head.rlike("^(fixedStep|variableStep)")
    no_header = F.raise_error(F.lit("data without header"))

    def field(name):
        return F.nullif(F.regexp_extract(head, rf"\b{name}=(\S+)", 1), F.lit(""))

    chrom = F.when(head.isNotNull(), F.coalesce(field("chrom"), F.raise_error(F.lit("missing chrom in header"))))
    described = cut.withColumn("_l", F.when(head.isNull() | is_head, F.col("_l")).otherwise(no_header.cast("array<string>"))).select(
        chrom.alias("chrom"), head.startswith("fixed").alias("_fixed"), (field("start").cast("long") - 1).alias("_start"),
        field("step").cast("long").alias("_step"), F.coalesce(field("span").cast("long"), F.lit(1)).alias("_span"),
        F.posexplode(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))).alias("_k", "_v"),
    )
    pair = F.split("_v", r"\s+")
    start = F.when(F.col("_fixed"), F.col("_start") + F.col("_k") * F.col("_step")).otherwise(pair[0].cast("long") - 1)
    value = F.when(F.col("_fixed"), F.col("_v")).otherwise(
        F.coalesce(F.get(pair, F.lit(1)), F.raise_error(F.concat(F.lit("invalid data: "), "_v")))
    )
    return described.select(
        "chrom", start.alias("start"), (start + F.col("_span")).alias("end"), value.cast("double").alias("value")
    )


def wig_lines(bins: DataFrame, window: int, chrom: str = "contig", value: str = "reads") -> DataFrame:
    """One fixedStep block per contig (1-based header, missing bins 0) as (chrom, text).

    A block holds one number per bin of a contig: its length over the window.
    """
    index = F.floor(F.col("start") / window).cast("int")
    packed = bins.groupBy(F.col(chrom).alias("chrom")).agg(
        F.map_from_entries(F.collect_list(F.struct(index.alias("i"), F.col(value).cast("long").alias("v")))).alias("_m"),
        F.max(index).alias("_last"),
    )
    numbers = F.transform(
        F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)).cast("string")
    )
    head = F.concat(F.lit("fixedStep chrom="), "chrom", F.lit(f" start=1 step={window} span={window}"))
    return packed.select("chrom", F.concat_ws("\n", head, F.array_join(numbers, "\n")).alias("value"))


def variable_lines(counts: DataFrame, span: int, chrom: str = "contig", value: str = "n") -> DataFrame:
    """One variableStep block per contig as (chrom, text)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col(value).cast("long").alias("v"))))
    packed = counts.groupBy(F.col(chrom).alias("chrom")).agg(rows.alias("_r"))
    body = F.transform("_r", lambda r: F.concat((r["s"] + 1).cast("string"), F.lit(" "), r["v"].cast("string")))
    head = F.concat(F.lit("variableStep chrom="), "chrom", F.lit(f" span={span}"))
    return packed.select("chrom", F.concat_ws("\n", head, F.array_join(body, "\n")).alias("value"))


def write_wig(blocks: DataFrame, path: str) -> None:
    """A track line, then the blocks in contig-name order, as part files whose names keep the order."""
    spark = blocks.sparkSession
    track = spark.createDataFrame([("", "track type=wiggle_0")], "chrom string, value string")
    track.unionByName(blocks).repartitionByRange("chrom").sortWithinPartitions("chrom").select("value").write.mode(
        "overwrite"
    ).text(path)
