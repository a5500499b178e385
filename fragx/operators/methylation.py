"""Methylation sites, calls and bin features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fragx.functions.sequence import bin_label


def distinct_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row per key by ``order``; combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def left_join_sites(
    sites: DataFrame, calls: DataFrame, order: str, keys: tuple[str, str] = ("chr", "position"),
    samples: list[str] | None = None,
) -> DataFrame:
    """Every site with the sample's probability, null where the sample has none.

    With ``samples`` the site list stands once per sample seen in the calls.
    """
    by = list(samples or [])
    first = distinct_first(calls.select(*by, *keys, "probability", order), [*by, *keys], order).drop(order)
    if by:
        names = calls.select(*by).distinct()
        listed = names.agg(F.collect_list(F.struct(*by)).alias("s")).scalar()
        sites = sites.withColumn("_s", F.explode(listed)).select(*sites.columns, *[F.col(f"_s.{b}") for b in by])
    return sites.join(first, [*by, *keys], "left")


def split_groups(df: DataFrame, groups: str = "group") -> DataFrame:
    """Comma list of groups to one row per group."""
    return df.withColumn(groups, F.explode(F.split(F.col(groups), ",")))


def methylation_features(
    sites: DataFrame, calls: DataFrame, order: str, window: int = 1_000_000, calibrate: bool = True,
    fill: float = -1.0, samples: list[str] | None = None,
) -> DataFrame:
    """Mean (calibrated) probability per group and bin as (feature, value); a bin without any value gets ``fill``.

    ``sites`` has chr, position, reference, group; ``calls`` has chr, position, probability and ``order``.
    """
    by = list(samples or [])
    keys = ["chr", "position"]
    label = F.concat_ws("_", "group", bin_label("chr", "position", window))
    first = distinct_first(calls.select(*by, *keys, "probability", order), [*by, *keys], order)
    value = F.col("probability") - F.col("reference") if calibrate else F.col("probability")
    # Only called sites are averaged; bins without any come from the (group, bin) list, which is
    # far shorter than sites x samples.
    means = (
        split_groups(first.join(sites, keys).withColumn("_value", value))
        .groupBy(*by, label.alias("feature")).agg(F.avg("_value").alias("_mean"))
    )
    listed = split_groups(sites).select(label.alias("feature")).distinct()
    if by:
        names = listed.agg(F.collect_list("feature")).scalar()
        listed = calls.select(*by).distinct().select(*by, F.explode(names).alias("feature"))
    return listed.join(means, [*by, "feature"], "left").select(
        *by, "feature", F.coalesce("_mean", F.lit(fill)).alias("value")
    )


def select_candidates(coverage: DataFrame, min_c: int = 1, min_depth: int = 3) -> DataFrame:
    """Sites with enough depth and at least one C (columns a, c, g, t of a base count)."""
    depth = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    return coverage.filter((F.col("c") >= min_c) & (depth >= min_depth))


def methylation_calls(scored: DataFrame, probs: str = "probs", depth: str = "depth", keys=("chr", "position")) -> DataFrame:
    """Call rows: site, probability of the methylated class, depth."""
    return scored.select(*keys, F.col(probs)[1].alias("probability"), F.col(depth).alias("depth"))
