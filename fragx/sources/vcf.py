"""Variant records as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fragx.operators.ordering import contig_rank, genome_order

# The sample fields of a written record.
FORMATS = [
    ("GT", "1", "String", "Genotype"),
    ("GQ", "1", "Integer", "Genotype Quality"),
    ("DP", "1", "Integer", "Read Depth"),
    ("AD", "R", "Integer", "Read depth for each allele"),
    ("AF", "A", "Float", "Estimated allele frequency in the range of [0,1]"),
    ("PL", "G", "Integer", "Phred-scaled genotype likelihoods rounded to the closest integer"),
    ("GP", "4", "Float", "genotype probabilities"),
    ("AP", "1", "Float", "allele type probability"),
]


def _missing(value: Column) -> Column:
    return F.when(~value.isin(".", ""), value)


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records with 0-based ``pos``, ``alleles`` array, first filter, INFO map and sample structs.

    ``samples`` holds one map of FORMAT fields per sample column; ``gt_a`` and
    ``gt_b`` are the alleles of the last sample in ascending order.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    fields = F.split(F.get(f, F.lit(8)), ":")
    samples = F.transform(
        F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))),
        lambda s: F.map_from_arrays(
            F.slice(fields, F.lit(1), F.least(F.size(fields), F.size(F.split(s, ":")))),
            F.slice(F.split(s, ":"), F.lit(1), F.least(F.size(fields), F.size(F.split(s, ":")))),
        ),
    )
    alts = F.filter(F.split(f[4], ","), lambda a: a != ".")
    info = F.when(f[7] != ".", F.str_to_map(f[7], F.lit(";"), F.lit("=")))
    rows = lines.select(
        f[0].alias("contig"), (f[1].cast("long") - 1).alias("pos"), _missing(f[2]).alias("id"), f[3].alias("ref"),
        F.concat(F.array(f[3]), alts).alias("alleles"), alts.alias("alts"),
        F.expr("try_cast(split(value, '\t')[5] AS DOUBLE)").alias("qual"),
        _missing(F.split(f[6], ";")[0]).alias("filt"), info.alias("info"), samples.alias("samples"),
    )
    genotype = F.try_element_at(F.try_element_at("samples", F.lit(-1)), F.lit("GT"))
    parts = F.split(genotype, r"[/|]")
    rows = rows.withColumn("_g", parts)
    a = F.expr("try_cast(get(_g, 0) AS INT)")
    b = F.expr("try_cast(get(_g, 1) AS INT)")
    known = a.isNotNull() & b.isNotNull()
    return rows.select(
        "*", F.when(known, F.least(a, b)).otherwise(a).alias("gt_a"), F.when(known, F.greatest(a, b)).otherwise(b).alias("gt_b")
    ).drop("_g")


def info_value(key: str, info: str = "info") -> Column:
    return F.try_element_at(F.col(info), F.lit(key))


def vcf_header(
    contigs: dict[str, int], samples: list[str], filters: dict[str, str] | None = None,
    infos: list[tuple[str, str, str, str]] | None = None, formats=None,
) -> list[str]:
    """Header lines for contigs, filters, INFO and FORMAT fields, and the column line."""
    lines = ["##fileformat=VCFv4.2"]
    lines += [f"##contig=<ID={name},length={length}>" for name, length in contigs.items()]
    lines += [f'##FILTER=<ID={name},Description="{text}">' for name, text in (filters or {}).items()]
    for tag, entries in (("INFO", infos or []), ("FORMAT", formats or FORMATS)):
        lines += [f'##{tag}=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in entries]
    lines.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]))
    return lines


def vcf_lines(
    records: DataFrame, fields: list[str], contig="contig", pos="pos", alleles="alleles", qual="qual", filt="filt",
    info: str | None = None,
) -> DataFrame:
    """Record text from typed columns; ``fields`` name the columns of the sample, arrays join by comma."""
    types = dict(records.dtypes)

    def text(name):
        value = F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), ",") if types[name].startswith(
            "array"
        ) else F.col(name).cast("string")
        return F.coalesce(value, F.lit("."))

    alts = F.array_join(F.slice(F.col(alleles), F.lit(2), F.greatest(F.size(alleles) - 1, F.lit(0))), ",")
    columns = [
        F.col(contig), (F.col(pos) + 1).cast("string"), F.lit("."), F.col(alleles)[0],
        F.when(alts == "", ".").otherwise(alts), F.coalesce(F.col(qual).cast("string"), F.lit(".")),
        F.coalesce(F.col(filt), F.lit(".")), text(info) if info else F.lit("."), F.lit(":".join(fields)),
        F.concat_ws(":", *[text(n) for n in fields]),
    ]
    return records.select(F.concat_ws("\t", *columns).alias("value"))


def write_vcf(records: DataFrame, path: str, header: list[str], fields: list[str], partitions: int | None = None, **columns) -> None:
    """Header file plus range-partitioned, sorted record files in one folder.

    File names sort in genome order, the header first, so that concatenating
    the folder gives one valid file.
    """
    spark = records.sparkSession
    contig, pos = columns.get("contig", "contig"), columns.get("pos", "pos")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [contig_rank(contig), F.col(contig), F.col(pos)]
    ordered = records.repartitionByRange(n, *order).sortWithinPartitions(*order)
    vcf_lines(ordered, fields, **columns).write.mode("overwrite").text(f"{path}/records")
    head = spark.createDataFrame([(i, line) for i, line in enumerate(header)], "i int, value string")
    head.repartition(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{path}/header")


def merge_sorted(parts: list[DataFrame], contig: str = "contig", pos: str = "pos") -> DataFrame:
    """Per-shard tables as one table in genome order."""
    return genome_order(reduce(DataFrame.unionByName, parts), contig, pos)
