"""Chain files: aligned blocks of two assemblies as text, the block table that lifting works on.

A chain is a header line and lines of ``size``, gap in the source and gap in the
target; a block's place is the sum of the lines before it in its chain. The sums
run over slices of all lines at once, so neither a file nor a chain has to fit
into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fragx.operators.ordering import running_totals

HEADER = (
    "chain_score string, src_contig string, src_size bigint, src_strand string, src_first bigint, src_last bigint, "
    "tgt_contig string, tgt_size bigint, strand string, tgt_first bigint, tgt_last bigint, chain string"
)


def read_chain(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per aligned block: source and target span, strand, ``block`` (its order in the files) and ``chain``.

    Starts are 0-based. On the minus strand ``tgt_start`` is turned to the
    forward strand, as ``lift_points`` and ``lift_ranges`` expect it. Comment and
    blank lines drop out; a source on the minus strand and a line that is no
    header, no block and no comment are errors. No lines give no rows.
    """
    text = F.trim("value")
    lines = spark.read.text(path).select(
        text.alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("at"),
    ).filter((text != "") & ~text.startswith("#"))
    f = F.split("line", r"\s+")
    head = F.col("line").startswith("chain")
    number = lambda i: F.when(~head, F.coalesce(F.get(f, F.lit(i)).cast("long"), F.lit(0))).otherwise(F.lit(0))
    valid = head | F.col("line").rlike(r"^\d+(\s+\d+\s+\d+)?$")
    line = F.when(valid, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("invalid chain line: "), F.col("line"))))
    parts = lines.withColumn("line", line).withColumns(
        {"head": head, "size": number(0), "src_step": number(0) + number(1), "tgt_step": number(0) + number(2)}
    )
    sums = {
        "nth": F.when(F.col("head"), 1).otherwise(0).cast("long"), "block": F.when(F.col("head"), 0).otherwise(1).cast("long"),
        "src_sum": "src_step", "tgt_sum": "tgt_step",
    }
    placed = running_totals(parts, sums, [F.col("file"), F.col("part"), F.col("at")])
    fields = F.from_csv(F.regexp_replace("line", r"^chain\s+|\s+", F.lit(",")), HEADER.replace("chain_score", "_lead string, chain_score"), {"mode": "FAILFAST"})
    heads = placed.filter("head").select("nth", fields.alias("h"), F.col("src_sum").alias("src_zero"), F.col("tgt_sum").alias("tgt_zero")).select("nth", "src_zero", "tgt_zero", "h.*")
    rows = placed.filter("NOT head").select("nth", "size", "src_step", "tgt_step", "src_sum", "tgt_sum", "block").join(heads, "nth")
    src = F.col("src_first") + F.col("src_sum") - F.col("src_zero") - F.col("src_step")
    tgt = F.col("tgt_first") + F.col("tgt_sum") - F.col("tgt_zero") - F.col("tgt_step")
    src = F.when(F.col("src_strand") == "+", src).otherwise(F.raise_error(F.lit("source of a chain on the minus strand")).cast("long"))
    rows = rows.withColumns({"src_start": src, "_tgt": tgt})
    forward = F.when(F.col("strand") == "+", F.col("_tgt")).otherwise(F.col("tgt_size") - F.col("_tgt") - F.col("size"))
    return rows.select(
        "src_contig", "src_start", (F.col("src_start") + F.col("size")).alias("src_end"), "tgt_contig", forward.alias("tgt_start"),
        "strand", "block", "chain",
    )


def chain_lines(blocks: DataFrame, src_sizes: DataFrame, tgt_sizes: DataFrame) -> DataFrame:
    """Chain text of a block table with a ``chain`` column, with the columns (chain, at, value) in file order.

    ``src_sizes`` and ``tgt_sizes`` give (contig, size). The blocks of a chain lie on one
    contig pair and strand, in order on both sides and without overlap; others
    are an error. A window per chain gives each block its gaps.
    """
    size = F.col("src_end") - F.col("src_start")
    rows = blocks.join(src_sizes.select(F.col("contig").alias("src_contig"), F.col("size").alias("src_size")), "src_contig")
    rows = rows.join(tgt_sizes.select(F.col("contig").alias("tgt_contig"), F.col("size").alias("tgt_size")), "tgt_contig")
    start = F.when(F.col("strand") == "+", F.col("tgt_start")).otherwise(F.col("tgt_size") - F.col("tgt_start") - size)
    rows = rows.withColumns({"_size": size, "_tgt": start})
    order = Window.partitionBy("chain").orderBy("src_start")
    after = lambda c: F.lead(c).over(order)
    rows = rows.withColumns({"_dt": after("src_start") - F.col("src_end"), "_dq": after("_tgt") - F.col("_tgt") - F.col("_size")})
    crossed = (F.col("_dt") < 0) | (F.col("_dq") < 0)
    message = F.concat(F.lit("blocks of a chain overlap or turn back: "), F.col("chain"))
    rows = rows.withColumn("_dt", F.when(crossed, F.raise_error(message).cast("long")).otherwise(F.col("_dt")))
    lines = rows.select("chain", F.col("src_start").alias("at"), F.concat_ws("\t", "_size", "_dt", "_dq").alias("value"))
    first = lambda c: F.min_by(c, "src_start")
    heads = rows.groupBy("chain").agg(
        F.concat_ws(
            " ", F.lit("chain"), F.sum("_size"), first("src_contig"), first("src_size"), F.lit("+"), F.min("src_start"), F.max("src_end"),
            first("tgt_contig"), first("tgt_size"), first("strand"), F.min("_tgt"), F.max(F.col("_tgt") + F.col("_size")), F.col("chain"),
        ).alias("value")
    )
    return lines.unionByName(heads.select("chain", F.lit(-1).cast("long").alias("at"), "value"))


def write_chain(blocks: DataFrame, src_sizes: DataFrame, tgt_sizes: DataFrame, path: str) -> None:
    """``chain_lines`` as text; lines are dealt in ranges, so part files follow each other by name."""
    lines = chain_lines(blocks, src_sizes, tgt_sizes)
    ranged = lines.repartitionByRange("chain", "at").sortWithinPartitions("chain", "at")
    ranged.select("value").write.mode("overwrite").text(path)
