"""Long feature tables: families, sample data, alignment to a model's feature list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fragx.functions.common import string_array


def namespace_features(families: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Families (prefix, long table) as one long table with ``prefix_feature`` names.

    On equal names the later family wins. The winner comes from one aggregate
    that combines on the map side.
    """
    merged = None
    for priority, (prefix, frame) in enumerate(families):
        part = frame.select(
            *keys, F.concat_ws("_", F.lit(prefix), "feature").alias("feature"), F.col("value").cast("double").alias("value"),
            F.lit(priority).alias("_priority"),
        )
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy(*keys, "feature").agg(F.max_by("value", "_priority").alias("value"))


def lookup_meta(
    samples: DataFrame, meta: DataFrame, key: str = "sample_id", defaults: dict[str, int] | None = None
) -> DataFrame:
    """Age and sex per sample; -1 and 1 where the sample is not listed. Of several rows of a sample the smallest counts."""
    defaults = defaults or {"age": -1, "sex": 1}
    given = F.struct(*[F.col(c) for c in defaults])
    rows = meta.groupBy(key).agg(F.min(given).alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in defaults])
    joined = samples.join(rows, key, "left")
    return joined.select(*samples.columns, *[F.coalesce(c, F.lit(v)).cast("int").alias(c) for c, v in defaults.items()])


def missing_features(features: DataFrame, required: list[str], key: str = "sample_id") -> DataFrame:
    """Required features a sample does not have, as (sample, feature)."""
    have = features.filter(F.col("feature").isin(*required)).groupBy(key).agg(F.collect_set("feature").alias("_have"))
    names = features.select(key).distinct().join(have, key, "left")
    gone = F.array_except(string_array(required), F.coalesce("_have", F.array().cast("array<string>")))
    return names.select(key, F.explode(gone).alias("feature"))


def align_features(
    features: DataFrame, required: list[str], key: str = "sample_id", wide: bool = False, integers=("age", "sex")
) -> DataFrame:
    """Every sample with exactly the model's features in its order; missing ones are 0.

    One shuffle by sample: other features are filtered out first, so a group
    holds at most the model's list. ``wide`` gives one column per feature,
    else rows (sample, position, feature, value).
    """
    used = features.filter(F.col("feature").isin(*required))
    packed = used.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("_m"))
    names = features.select(key).distinct().join(packed, key, "left")

    def value(name):
        v = F.coalesce(F.try_element_at("_m", name), F.lit(0.0))
        return v

    if wide:
        return names.select(
            key, *[value(F.lit(n)).cast("int" if n in integers else "double").alias(n) for n in required]
        )
    rows = names.select(key, "_m", F.posexplode(string_array(required)).alias("position", "feature"))
    v = value(F.col("feature"))
    return rows.select(
        key, "position", "feature", F.when(F.col("feature").isin(*integers), F.floor(v).cast("double")).otherwise(v).alias("value")
    )


def feature_vectors(features: DataFrame, required: list[str], key: str = "sample_id", name: str = "features") -> DataFrame:
    """``align_features`` as one array of doubles per sample."""
    wide = align_features(features, required, key, wide=True)
    return wide.select(key, F.array(*[F.col(n).cast("double") for n in required]).alias(name))


def feature_table(
    families: list[tuple[str, DataFrame]], meta: DataFrame, key: str = "sample_id", columns: list[str] | None = None
) -> DataFrame:
    """All families of all samples with age and sex: long, or wide for the named columns."""
    merged = namespace_features(families, [key])
    known = lookup_meta(merged.select(key).distinct(), meta, key)
    facts = known.select(
        key,
        F.explode(
            F.array(
                F.struct(F.lit("age").alias("feature"), F.col("age").cast("double").alias("value")),
                F.struct(F.lit("sex").alias("feature"), F.col("sex").cast("double").alias("value")),
            )
        ).alias("_f"),
    ).select(key, "_f.feature", "_f.value")
    long = facts.unionByName(merged)
    return long if columns is None else align_features(long, columns, key, wide=True)
