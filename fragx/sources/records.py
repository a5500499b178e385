"""Record tables: JSON lines, sample tables by extension, output per sample or contig."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FORMATS = {".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """One JSON object per line; the schema is stated, so the file is read once."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def concat(parts: list[DataFrame]) -> DataFrame:
    """Record sources one after the other; columns match by name."""
    return reduce(DataFrame.unionByName, parts)


def _format(path: str) -> str:
    for ending, kind in FORMATS.items():
        if path.rstrip("/").endswith(ending):
            return kind
    raise ValueError(f"unsupported file type: {path}")


def read_samples(
    spark: SparkSession, path: str, columns: list[str] | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """A table by its file extension; of the named columns those it has."""
    kind = _format(path)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",")
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def write_by_sample(df: DataFrame, path: str, key: str = "sample_id", kind: str = "json") -> None:
    """One folder per sample. Rows of a sample meet first, so that a sample gives few files."""
    df.repartition(F.col(key)).write.mode("overwrite").partitionBy(key).format(kind).save(path)


def write_by_contig(reads: DataFrame, path: str, contig: str = "contig", pos: str = "pos", tile: int = 5_000_000) -> None:
    """Reads partitioned by contig, sorted by position inside the files.

    The shuffle key is (contig, tile): a long or deep contig spreads over many
    tasks and files, each holding a narrow position range for pruning.
    """
    place = F.floor(F.col(pos) / tile)
    reads.repartition(F.col(contig), place).sortWithinPartitions(contig, pos).write.mode("overwrite").partitionBy(
        contig
    ).parquet(path)


def load_site_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A named site resource, one table per name, as parquet or tab-separated text.

    Known names: all_sites, methylation_sites, end_motif, end_motif_all_cg.
    """
    # Column types of the resources.
    schemas = {
        "all_sites": "contig string, position bigint",
        "methylation_sites": "chr string, position bigint, reference double, group string",
        "end_motif": "contig string, st bigint, en bigint, ncg string, cgn string, typ string, cancer string",
        "end_motif_all_cg": "contig string, st bigint, en bigint, ncg string, cgn string, typ string, cancer string",
    }
    if name not in schemas:
        raise ValueError(f"unknown resource {name}")
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    header = name == "methylation_sites"
    return spark.read.schema(schemas[name]).option("sep", "\t").option("header", header).option("comment", "#").csv(
        f"{folder}/{name}.tsv"
    )
