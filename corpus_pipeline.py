"""The corpus pipeline: documents through five stages, each written as Parquet and read by the next.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each near-duplicate class the document with the smallest id stays.
3. passages: a passage of 50 words or more that an earlier document holds is cut out; the first one stays.
4. secrets: found secrets are replaced by their kind.
5. packing: what is left is tokenised and packed into sequences.

All stages but the last return the columns of their input; ``n_chars``, where
there is such a column, follows the text. Each stage judges all rows it is given.
"""

from __future__ import annotations

import uuid

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fragx.llm import neardup, packing, quality, repeats, secrets
from fragx.llm.common import fresh, table
from fragx.session import ensure_checkpoint_dir, ship_package


def _decided(docs: DataFrame, found: DataFrame, column: str) -> tuple[DataFrame, str]:
    """``docs`` with one column of ``found`` (unique in doc_id) under a name that they do not have."""
    key, name = fresh(docs, "_doc_id_found"), fresh(docs, f"_{column}_found")
    named = found.select(F.col("doc_id").alias(key), F.col(column).alias(name))
    return docs.join(named, F.col("doc_id").cast("long") == F.col(key), "left").drop(key), name


def _with_text(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text and its length."""
    columns = docs.columns
    out = docs.withColumn("text", text)
    if "n_chars" in columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return out.select(columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. A row without an id is judged by its text like any other."""
    ship_package(spark)
    ratio = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, ratio)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per near-duplicate class. Equal rows of that document stay as they are; rows without an id stay."""
    ship_package(spark)
    classes = neardup.near_duplicates(docs)
    gone = classes.filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    key = fresh(docs, "_gone_id")
    return docs.join(gone.withColumnRenamed("doc_id", key), F.col("doc_id").cast("long") == F.col(key), "left_anti")


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id holds."""
    ship_package(spark)
    marked, later = _decided(docs, repeats.repeated_passages(docs).filter(F.size("later") > 0), "later")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([repeats.without(t, [{"start": a, "end": b} for a, b in zip(s, e)]) for t, s, e in zip(texts, starts, ends)])

    changed = F.when(F.col(later).isNull(), F.col("text")).otherwise(
        cut(F.coalesce("text", F.lit("")), F.coalesce(F.col(f"{later}.start"), F.array().cast("array<int>")), F.coalesce(F.col(f"{later}.end"), F.array().cast("array<int>")))
    )
    return _with_text(marked, changed).select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by their kind."""
    ship_package(spark)
    dictionary = secrets.identifier_dictionary(docs)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        novelty = secrets.Novelty(dictionary)
        return pd.Series([None if t is None else secrets.mask(t, novelty) for t in texts], dtype=object)

    return _with_text(docs, masked("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL has no ProbMinHash, compressor or tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
