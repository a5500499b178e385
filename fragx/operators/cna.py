"""Copy number: tracks, GC correction, shares of the total, scores against a panel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fragx import constants as K

FLOOR_SHARE = 1e-10


def arm_table(spark: SparkSession) -> DataFrame:
    """Arm bounds of the autosomes (22 rows)."""
    return spark.createDataFrame(
        [(c, p, q) for c, p, q, _ in K.ARM_BOUNDS], "contig string, p_end bigint, q_start bigint"
    )


def assign_arm(bins: DataFrame, arms: DataFrame, contig="contig", start="start", end="end") -> DataFrame:
    """``arm`` = contig + p or q, null for the centromere; contigs without arms drop out.

    ``arms`` has one row per contig of the assembly; Spark broadcasts it by its measured size.
    """
    bounds = arms.select(F.col("contig").alias(contig), "p_end", "q_start")
    side = F.when(F.col(end) <= F.col("p_end"), "p").when(F.col(start) >= F.col("q_start"), "q")
    return bins.join(bounds, contig).withColumn("arm", F.concat(F.col(contig), side)).drop("p_end", "q_start")


def attach_tracks(bins: DataFrame, gc: DataFrame, mappability: DataFrame, keys: list[str]) -> DataFrame:
    """GC and mappability of a bin, matched by (contig, start); a negative GC counts as 0."""
    g = gc.select(*keys, F.greatest(F.col("gc"), F.lit(0.0)).alias("gc"))
    m = mappability.select(*keys, F.col("map"))
    return bins.join(g, keys, "left").join(m, keys, "left")


def bin_flags(bins: DataFrame, mappability: float = 0.75) -> DataFrame:
    valid = F.coalesce((F.col("reads") > 0) & (F.col("gc") >= 0), F.lit(False))
    ideal = valid & F.coalesce(F.col("map") >= mappability, F.lit(False))
    return bins.withColumn("valid", valid).withColumn("ideal", ideal)


def _lowess(y: np.ndarray, x: np.ndarray, frac: float, passes: int) -> np.ndarray:
    """Robust local regression (Cleveland 1979), fitted once per distinct x.

    Rows with equal x share one fit, so sums per distinct x replace the rows:
    the work grows with the number of distinct x, not with the rows.
    """
    n = len(x)
    k = max(int(frac * n + 1e-10), 1)
    ux, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    cumulative = np.concatenate([[0], np.cumsum(counts)])
    ordered = np.repeat(ux, counts)
    radius = np.empty(len(ux))
    for j, at in enumerate(ux):
        # Distance to the k-th nearest value, found in the sorted values around x.
        lo, hi = max(cumulative[j] - k, 0), min(cumulative[j + 1] + k, n)
        near = np.abs(ordered[lo:hi] - at)
        radius[j] = np.partition(near, k - 1)[k - 1]
    robust = np.ones(n)
    fit = np.zeros(n)
    for step in range(passes + 1):
        mass = np.bincount(inverse, weights=robust, minlength=len(ux))
        moment = np.bincount(inverse, weights=robust * y, minlength=len(ux))
        level = np.empty(len(ux))
        for j, at in enumerate(ux):
            if radius[j] > 0:
                scaled = np.abs(ux - at) / radius[j]
                tri = np.where(scaled < 1, (1 - scaled**3) ** 3, 0.0)
            else:
                tri = (ux == at).astype(float)
            w = tri * mass
            total = w.sum()
            if total <= 0:
                level[j] = moment[j] / mass[j] if mass[j] > 0 else y[inverse == j].mean()
                continue
            center = (w * ux).sum() / total
            spread = (w * (ux - center) ** 2).sum() / total
            mean_y = (tri * moment).sum() / total
            if spread < 1e-12:
                level[j] = mean_y
            else:
                slope = (tri * moment * (ux - center)).sum() / total / spread
                level[j] = mean_y + slope * (at - center)
        fit = level[inverse]
        if step < passes:
            residual = np.abs(y - fit)
            scale = 6.0 * np.median(residual)
            ratio = residual / scale if scale > 0 else (residual > 0).astype(float)
            robust = np.where(ratio < 1, (1 - ratio**2) ** 2, 0.0)
    return fit


def gc_correct(bins: DataFrame, sample: str = "sample_id", frac: float = 0.5, passes: int = 3) -> DataFrame:
    """Corrected reads of the ideal bins; other bins get null.

    One group is one sample's ideal bins: at most genome length / window rows
    (about 3 000 at 1 Mb), a bound that does not grow with the number of reads.
    Samples run in parallel.
    """
    carried = bins.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bins.schema) + ", corrected double"

    def correct(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["reads"].to_numpy(dtype=float)
        fit = _lowess(y, pdf["gc"].to_numpy(dtype=float), frac, passes)
        scale = fit / np.median(fit)
        with np.errstate(divide="ignore", invalid="ignore"):
            pdf["corrected"] = y / scale
        return pdf

    ideal = bins.filter("ideal").groupBy(sample).applyInPandas(correct, schema)
    rest = bins.filter(~F.col("ideal")).withColumn("corrected", F.lit(None).cast("double"))
    return ideal.unionByName(rest).select(*carried, "corrected")


def arm_totals(bins: DataFrame, keys: list[str], value: str = "corrected") -> DataFrame:
    """Sum of the positive values per arm; bins outside the arms are left out."""
    return (
        bins.filter(F.col("arm").isNotNull())
        .groupBy(*keys, "arm")
        .agg(F.coalesce(F.sum(F.when(F.col(value) > 0, F.col(value))), F.lit(0)).cast("double").alias("total"))
    )


def percent_of_total(df: DataFrame, keys: list[str], value: str, name: str = "share") -> DataFrame:
    """Value over the group total times 100 plus 1e-10; null counts as 0.

    A group is one sample's bins or arms (genome length / window rows at most),
    so a window gives the total in the same pass and the input is read once.
    """
    total = F.sum(value).over(Window.partitionBy(*keys))
    share = F.coalesce(F.try_divide(F.col(value), total), F.lit(0.0)) * 100 + FLOOR_SHARE
    return df.withColumn(name, share.cast("double"))


def build_panel(shares: DataFrame, sample: str, keys: list[str], value: str = "share") -> DataFrame:
    """Mean and sample standard deviation per key over all samples.

    A key a sample does not have counts as 1e-10. Instead of a sample x key
    grid, the moments of the present values are combined with the known moments
    of the missing ones: m copies of a constant.
    """
    samples = shares.agg(F.countDistinct(sample).alias("n")).scalar()
    present = shares.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), F.var_pop(value).alias("_var")
    )
    n, total = F.col("_n"), samples.cast("double")
    missing = total - n
    delta = F.col("_mean") - F.lit(FLOOR_SHARE)
    mean = (F.col("_mean") * n + missing * F.lit(FLOOR_SHARE)) / total
    squares = F.col("_var") * n + delta * delta * n * missing / total
    std = F.when(total > 1, F.sqrt(squares / (total - 1)))
    return present.select(*keys, mean.alias("mean"), std.alias("std"))


def zscore_vs_panel(
    shares: DataFrame, panel: DataFrame, sample: str, keys: list[str], value: str = "share"
) -> DataFrame:
    """(x - mean) / std per key; keys known to one side only give null.

    The panel has one row per bin and arm, so it is small next to the samples;
    it meets them on the key. Panel keys a sample lacks are found per sample
    from the sample list exploded over nothing but those keys.
    """
    z = F.try_divide(F.col(value) - F.col("mean"), F.col("std"))
    scored = shares.join(panel, keys, "left").select(sample, *keys, z.alias("z"))
    return scored.unionByName(_absent_panel_keys(shares, panel, sample, keys), allowMissingColumns=True)


def _absent_panel_keys(shares: DataFrame, panel: DataFrame, sample: str, keys: list[str]) -> DataFrame:
    """(sample, panel key) combinations without a share."""
    key = F.struct(*[F.col(k) for k in keys])
    wanted = panel.agg(F.collect_set(key).alias("_all")).scalar()
    have = shares.groupBy(sample).agg(F.collect_set(key).alias("_have"))
    gone = have.select(sample, F.explode(F.array_except(wanted, F.col("_have"))).alias("_k"))
    return gone.select(sample, *[F.col(f"_k.{k}").alias(k) for k in keys]).withColumn(
        "z", F.lit(None).cast("double")
    )


def cna_summary(scores: DataFrame, keys: list[str], z: str = "z", threshold: float = 2.0) -> DataFrame:
    """Mean score and gain / loss / neutral call per arm."""
    mean = F.avg(z)
    call = F.when(F.col("mean_z") > threshold, "gain").when(F.col("mean_z") < -threshold, "loss").otherwise("neutral")
    return scores.groupBy(*keys, "arm").agg(mean.alias("mean_z")).withColumn("call", call)


def median_normalize(df: DataFrame, keys: list[str], value: str, name: str = "ratio") -> DataFrame:
    """Value over the group's exact median."""
    medians = df.groupBy(*keys).agg(F.median(value).alias("_median"))
    return df.join(medians, keys).withColumn(name, F.try_divide(F.col(value).cast("double"), "_median")).drop("_median")
