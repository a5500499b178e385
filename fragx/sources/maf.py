"""Somatic mutation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fragx import constants as K
from fragx.functions.region import normalize_contig

# The columns used of the format.
COLUMNS = [
    "Tumor_Sample_Barcode", "Chromosome", "NCBI_Build", "Start_Position", "End_Position", "Reference_Allele",
    "Tumor_Seq_Allele2", "Variant_Type", "Variant_Classification", "Hugo_Symbol", "Entrez_Gene_Id",
]


def read_maf(
    spark: SparkSession, path: str | list[str], contigs: list[str] | None = None, max_len: int | None = None,
    sample_ids: list[str] | None = None,
) -> DataFrame:
    """Normalised mutation rows, 0-based half-open; an insertion spans one base.

    ``max_len`` clips long events with their sequences. Builds other than
    GRCh37 and GRCh38 are an error.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path).select(*COLUMNS)
    if sample_ids is not None:
        raw = raw.filter(F.col("Tumor_Sample_Barcode").isin(*sample_ids))
    rows = raw.withColumn("chr", normalize_contig("Chromosome")).filter(F.col("chr").isin(*(contigs or K.GENOME_ORDER)))
    build = F.when(F.col("NCBI_Build").isin("GRCh38", "GRCh37"), F.col("NCBI_Build")).otherwise(
        F.raise_error(F.concat(F.lit("unknown build "), F.coalesce("NCBI_Build", F.lit("null")))).cast("string")
    )
    start = F.col("Start_Position").cast("long") - 1
    end = F.when(F.col("Variant_Type") == "INS", start + 1).otherwise(F.col("End_Position").cast("long"))
    rows = rows.withColumn("ref_start", start).withColumn("_end", end)
    ref, var, stop = F.col("Reference_Allele"), F.col("Tumor_Seq_Allele2"), F.col("_end")
    if max_len is not None:
        long = F.col("_end") - F.col("ref_start") > max_len
        stop = F.least(F.col("_end"), F.when(long, F.col("ref_start") + max_len).otherwise(F.col("_end")))
        ref = F.when(long, F.substring(ref, 1, max_len)).otherwise(ref)
        var = F.when(long, F.substring(var, 1, max_len)).otherwise(var)
    return rows.select(
        F.concat_ws("-", "Tumor_Sample_Barcode", "chr", F.col("ref_start").cast("string")).alias("id"),
        F.col("Tumor_Sample_Barcode").alias("sample_id"), ref.alias("ref_seq"), var.alias("var_seq"), "ref_start",
        stop.alias("ref_end"), "chr", F.col("Variant_Type").alias("variant_type"),
        F.col("Variant_Classification").alias("variant_classification"), F.col("Hugo_Symbol").alias("hugo_symbol"),
        F.col("Entrez_Gene_Id").alias("entrez_gene_id"), build.alias("ncbi_build"),
    )
