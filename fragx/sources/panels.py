"""Panel and copy-number score files: nested JSON to long tables and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PANEL = "arm struct<mean:map<string,double>,std:map<string,double>>, bin struct<mean:map<string,double>,std:map<string,double>>"
SCORES = "arm map<string,double>, bin map<string,double>"


def panel_to_table(spark: SparkSession, path: str) -> DataFrame:
    """``{arm: {mean, std}, bin: {mean, std}}`` to (level, key, mean, std)."""
    doc = spark.read.schema(PANEL).option("multiLine", True).json(path)
    parts = []
    for level in ("arm", "bin"):
        one = doc.select(F.explode(f"{level}.mean").alias("key", "mean"), F.col(f"{level}.std").alias("_std"))
        parts.append(one.select(F.lit(level).alias("level"), "key", "mean", F.try_element_at("_std", F.col("key")).alias("std")))
    return parts[0].unionByName(parts[1])


def table_to_panel(panel: DataFrame) -> DataFrame:
    """(level, key, mean, std) to one JSON document; a panel holds one entry per bin and arm."""

    def side(level, stat):
        entry = F.when(F.col("level") == level, F.struct(F.col("key"), F.col(stat)))
        return F.map_from_entries(F.collect_list(entry)).alias(stat)

    packed = panel.agg(
        F.struct(side("arm", "mean"), side("arm", "std")).alias("arm"), F.struct(side("bin", "mean"), side("bin", "std")).alias("bin")
    )
    return packed.select(F.to_json(F.struct("arm", "bin")).alias("value"))


def scores_to_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``{arm: {key: z}, bin: {key: z}}`` files to (file, level, key, z)."""
    doc = spark.read.schema(SCORES).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    parts = [
        doc.select("file", F.lit(level).alias("level"), F.explode(level).alias("key", "z")) for level in ("arm", "bin")
    ]
    return parts[0].unionByName(parts[1])


def scores_to_json(scores: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Scores of a sample as one document: (sample, value)."""

    def side(level):
        return F.map_from_entries(
            F.collect_list(F.when(F.col("level") == level, F.struct(F.col("key"), F.col("z"))))
        ).alias(level)

    packed = scores.groupBy(sample).agg(side("arm"), side("bin"))
    return packed.select(sample, F.to_json(F.struct("arm", "bin")).alias("value"))


def cnv_features(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores as features: bin and arm keys in one list, the arm winning on equal names."""
    return scores.groupBy(*keys, F.col("key").alias("feature")).agg(
        F.max_by("z", F.when(F.col("level") == "arm", 1).otherwise(0)).alias("value")
    )
