"""Sequences as FASTA text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fragx.operators.ordering import row_numbers, running_totals


def read_fasta(spark: SparkSession, path: str | list[str], rename: bool = True) -> DataFrame:
    """(ord, id, description, seq); blank and ``#`` lines drop out.

    Records split at a line that starts with ``>``. With ``rename`` a repeated
    id gets the running number of repeats behind it, as text. JSON in the
    description is found by ``json_description``.
    """
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("ord", F.monotonically_increasing_id())
    body = F.regexp_replace(F.concat(F.lit(">"), F.regexp_replace("value", r"^>", "")), r"\r", "")
    records = records.select("ord", body.alias("_b")).filter(F.length("_b") > 1)
    # Whatever stands before the first record has no header of its own.
    head = F.regexp_extract("_b", r"^>([^\n]*)", 1)
    lines = F.filter(
        F.transform(F.slice(F.split("_b", "\n"), F.lit(2), F.greatest(F.size(F.split("_b", "\n")) - 1, F.lit(0))), lambda x: F.trim(x)),
        lambda x: (x != "") & ~x.startswith("#"),
    )
    rows = records.select(
        "ord", F.regexp_extract(head, r"^(\S+)", 1).alias("id"),
        F.regexp_extract(head, r"^\S+\s+(.*?)\s*$", 1).alias("description"), F.array_join(lines, "").alias("seq"),
    ).filter(F.col("id") != "")
    return _rename_repeats(rows) if rename else rows


def read_fasta_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(contig, offset, bases): the sequence lines of all records with their place in the record.

    No row is longer than a line, so a chromosome is spread over many tasks:
    records are numbered by a running count of header lines, and offsets are
    running totals of line lengths, both by slices of the file. Blank and ``#``
    lines drop out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    header = F.col("line").startswith(">")
    numbered = running_totals(lines, {"record": F.when(header, 1).otherwise(0).cast("long")}, [F.col("ord")], ["file"])
    names = numbered.filter(header).select("file", "record", F.regexp_extract("line", r"^>(\S+)", 1).alias("contig"))
    bases = numbered.filter(~header & (F.col("record") > 0))
    placed = running_totals(bases, {"end": F.length("line").cast("long")}, [F.col("ord")], ["file", "record"])
    return placed.join(names, ["file", "record"]).select("contig", (F.col("end") - F.length("line")).alias("offset"), F.col("line").alias("bases"))


def _rename_repeats(rows: DataFrame) -> DataFrame:
    """Only repeated ids are numbered, over all repeats of the file in order."""
    first = rows.groupBy("id").agg(F.min("ord").alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeats = rows.select("id", "ord").join(first.filter("_n > 1").select("id", "_first"), "id").filter("ord > _first")
    numbered = row_numbers(repeats.select("ord"), [F.col("ord")]).select("ord", (F.col("rn") - 1).alias("_k"))
    return rows.join(numbered, "ord", "left").select(
        "ord", F.when(F.col("_k").isNull(), F.col("id")).otherwise(F.concat("id", F.col("_k").cast("string"))).alias("id"),
        "description", "seq",
    )


def json_description(description: str = "description"):
    """The first ``{...}`` of a description as text, for ``get_json_object`` or ``from_json``; null without one."""
    return F.nullif(F.regexp_extract(F.col(description), r"(\{.+?\})", 1), F.lit(""))


def fasta_lines(df: DataFrame, id: str = "id", seq: str = "seq", description: str | None = None, width: int = 60) -> DataFrame:
    """FASTA text per row, sequence lines of ``width`` bases."""
    head = F.col(id) if description is None else F.trim(F.concat_ws(" ", F.col(id), F.col(description)))
    wrapped = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), head, F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, **columns) -> None:
    fasta_lines(df, **columns).write.mode("overwrite").text(path)
