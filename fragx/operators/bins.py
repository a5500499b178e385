"""Counting on fixed and variable bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fragx.functions.common import floor_div
from fragx.operators.intervals import point_in_interval_join


def bin_counts(
    df: DataFrame, keys: list[str], window: int, pos: str = "pos", origin: int = 0, weight: str | None = None
) -> DataFrame:
    """Rows (or summed weights) per group and window by position.

    The aggregate combines on the map side, so a hot bin costs one row per task.
    """
    start = floor_div(F.col(pos) - origin, window) * window + origin
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*keys, start.cast("long").alias("start")).agg(amount.cast("long").alias("reads"))


def dense_bins(
    counts: DataFrame, keys: list[str], window: int, lengths: DataFrame | None = None, length: str = "len"
) -> DataFrame:
    """Counts with zero rows for the empty bins between them.

    A group runs to its last counted bin, or over its whole length when
    ``lengths`` (``keys`` and ``length``) is given. The bin end is not truncated.

    The counts are read once: every counted bin brings along the empty bins
    that follow it, and the first one those before it. A window sees one
    group's counted bins, at most its length over ``window``.
    """
    step = F.lit(window).cast("long")
    along = Window.partitionBy(*keys).orderBy("start")
    if lengths is None:
        rows = counts.select(*keys, "start", "reads")
        following = F.coalesce(F.lead("start").over(along), F.col("start") + step)
    else:
        ends = lengths.select(*keys, (F.ceil(F.col(length) / window) * window).cast("long").alias("_stop"))
        rows = ends.join(counts.select(*keys, "start", "reads"), keys, "left")
        # Bins past the end of the group drop out; ``least`` skips the missing next start of the last bin.
        following = F.least(F.lead("start").over(along), F.col("_stop"))
    filled = rows.select("*", following.alias("_next"), F.lag("start").over(along).isNull().alias("_head"))
    zero = F.lit(0).cast("long")
    first = F.when(F.col("_head"), zero).otherwise(F.col("start"))
    spread = filled.filter(first < F.col("_next")).select(
        *keys, F.col("start").alias("_at"), "reads", F.explode(F.sequence(first, F.col("_next") - step, step)).alias("start")
    )
    return spread.select(
        *keys, "start", (F.col("start") + step).alias("end"),
        F.when(F.col("start") == F.col("_at"), F.col("reads")).otherwise(zero).cast("long").alias("reads"),
    )


def variable_bins(
    points: DataFrame, starts: DataFrame, span: int, keys: list[str], pos: str = "pos", start: str = "start"
) -> DataFrame:
    """Counts for listed spans only, zero rows included."""
    spans = starts.select(*keys, F.col(start).cast("long").alias("start")).distinct()
    listed = spans.withColumn("_end", F.col("start") + span)
    slim = points.select(*keys, F.col(pos).cast("long").alias("_pos"))
    hits = point_in_interval_join(slim, listed, keys, "_pos", "start", "_end")
    counted = hits.groupBy(*keys, "start").agg(F.count(F.lit(1)).alias("n"))
    return spans.join(counted, [*keys, "start"], "left").select(
        *keys, "start", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )
