"""Methylation sites, calls and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragx.catalog.registry import register
from fragx.fixtures import table
from fragx.functions.common import round6
from fragx.operators import methylation as M

FIRST = {
    "first": """SELECT chr, position, probability, call_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chr, position ORDER BY call_id) AS rk FROM calls) c WHERE rk = 1""",
    "sites_m": "SELECT cpg_id, contig AS chr, st AS position, reference, cancer AS grp FROM cpg",
    "joined": "SELECT s.*, f.probability FROM sites_m s LEFT JOIN first f ON s.chr = f.chr AND s.position = f.position",
}


def _sites(spark, sf_dir):
    return table(spark, sf_dir, "cpg").select(
        "cpg_id", F.col("contig").alias("chr"), F.col("st").alias("position"), "reference", F.col("cancer").alias("group")
    )


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "calls").select("chr", "position", "probability", "call_id")


@register("distinct_first", "SELECT chr, position, probability, call_id FROM first", FIRST)
def distinct_first(spark, sf_dir):
    return M.distinct_first(_calls(spark, sf_dir), ["chr", "position"], "call_id")


@register("left_join_sites", "SELECT cpg_id, chr, position, reference, grp, probability FROM joined", FIRST)
def left_join_sites(spark, sf_dir):
    out = M.left_join_sites(_sites(spark, sf_dir), _calls(spark, sf_dir), "call_id")
    return out.select("cpg_id", "chr", "position", "reference", F.col("group").alias("grp"), "probability")


@register("split_groups", "SELECT cpg_id, unnest(string_split(cancer, ',')) AS grp FROM cpg")
def split_groups(spark, sf_dir):
    return M.split_groups(table(spark, sf_dir, "cpg").select("cpg_id", F.col("cancer").alias("grp")), "grp")


@register(
    "methylation_features",
    """SELECT CONCAT(g, '_', chr, ':', CAST((position // 1000000) * 1000000 AS VARCHAR), '-', CAST((position // 1000000) * 1000000 + 1000000 AS VARCHAR)) AS feature,
      ROUND(COALESCE(AVG(probability - reference), -1) + 1e-9, 6) + 0.0 AS value
    FROM (SELECT *, unnest(string_split(grp, ',')) AS g FROM joined) j GROUP BY g, chr, position // 1000000""",
    FIRST,
)
def methylation_features(spark, sf_dir):
    out = M.methylation_features(_sites(spark, sf_dir), _calls(spark, sf_dir), "call_id")
    # Means of three-digit numbers often end in an exact half at the seventh digit; the order of the
    # sum decides there, so both sides are moved off the half by the same tiny amount.
    return out.select("feature", round6(F.col("value") + F.lit(1e-9)).alias("value"))
