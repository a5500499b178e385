"""Copy-number scores of all samples in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fragx.operators import cna as C
from fragx.session import materialize


def corrected_shares(
    bins: DataFrame, arms: DataFrame, gc: DataFrame, mappability: DataFrame, mappability_threshold: float = 0.75,
    sample: str = "sample_id",
) -> DataFrame:
    """Percent of the corrected total per (sample, level, key) for arms and ideal bins."""
    armed = C.assign_arm(bins, arms)
    flagged = C.bin_flags(C.attach_tracks(armed, gc, mappability, ["contig", "start"]), mappability_threshold)
    corrected = materialize(C.gc_correct(materialize(flagged), sample))
    totals = C.arm_totals(corrected, [sample])
    by_arm = C.percent_of_total(totals, [sample], "total").select(
        sample, F.lit("arm").alias("level"), F.col("arm").alias("key"), "share"
    )
    label = F.concat("contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    by_bin = C.percent_of_total(corrected.filter("ideal"), [sample], "corrected").select(
        sample, F.lit("bin").alias("level"), label.alias("key"), "share"
    )
    return by_arm.unionByName(by_bin)


def panel_of_normals(bins: DataFrame, arms: DataFrame, gc: DataFrame, mappability: DataFrame, **options) -> DataFrame:
    """Mean and standard deviation per (level, key) over normal samples."""
    sample = options.get("sample", "sample_id")
    return C.build_panel(materialize(corrected_shares(bins, arms, gc, mappability, **options)), sample, ["level", "key"])


def copy_number(
    bins: DataFrame, arms: DataFrame, gc: DataFrame, mappability: DataFrame, panel: DataFrame | None = None, **options
) -> DataFrame:
    """Scores per (sample, level, key); without a panel the samples themselves are the panel."""
    sample = options.get("sample", "sample_id")
    # Samples x bins rows, used for the samples, the panel and the keys: far smaller than the reads.
    shares = materialize(corrected_shares(bins, arms, gc, mappability, **options))
    if panel is None:
        panel = C.build_panel(shares, sample, ["level", "key"])
    return C.zscore_vs_panel(shares, panel, sample, ["level", "key"])
