"""Interval joins on fixed buckets, and interval set operations.

Coordinates are 0-based and half-open. A plain range predicate would become a
nested-loop join, or a hash join on a few dozen contigs; cutting the axis into
buckets turns it into an equi-join on (group, bucket) with a residual filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fragx.functions.common import floor_div
from fragx.operators.skew import DEFAULT_HOT_ROWS, salted_join
from fragx.session import materialize

#: Bucket widths below this gain nothing.
MIN_WIDTH = 128
#: Width for short reads and fragments, of a few hundred bases.
READ_WIDTH = 256


def _buckets(start: Column, end: Column, width: Column) -> Column:
    return F.explode(F.sequence(floor_div(start, width), floor_div(end - 1, width)))


def mean_length(*sides: tuple[DataFrame, str, str]) -> Column:
    """Bucket width from the data: the mean interval length of the side where it is larger.

    With it no side has more than about three bucket rows per interval, and an
    interval meets only what lies within a few lengths. One aggregate over each
    side, as a scalar subquery; give a width where the lengths are known.
    """
    found = [df.agg(F.ceil(F.avg(F.when(F.col(e) > F.col(s), F.col(e) - F.col(s)))).cast("long")).scalar() for df, s, e in sides]
    return F.greatest(F.lit(MIN_WIDTH).cast("long"), *found)


def _width(width: int | Column | None, *sides: tuple[DataFrame, str, str]) -> Column:
    if width is None:
        return mean_length(*sides)
    return width if isinstance(width, Column) else F.lit(int(width)).cast("long")


def point_in_interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    pos: str = "pos",
    start: str = "st",
    end: str = "en",
    width: int | Column | None = None,
    how: str = "inner",
    hot_rows: int | None = DEFAULT_HOT_ROWS,
    hot_side: str = "left",
) -> DataFrame:
    """Each point with every interval of its group that contains it.

    Apart from ``keys`` the two sides must not share column names. A point is
    in one bucket, so no pair is found twice and semi and anti joins hold too.
    ``width`` is the bucket width, by default the mean length of the intervals.
    """
    width = _width(width, (intervals, start, end))
    left = points.withColumn("_bucket", floor_div(pos, width))
    right = intervals.filter(F.col(end) > F.col(start)).withColumn(
        "_bucket", _buckets(F.col(start), F.col(end), width)
    )
    inside = (F.col(start) <= F.col(pos)) & (F.col(pos) < F.col(end))
    return salted_join(left, right, [*keys, "_bucket"], inside, how, hot_rows, hot_side).drop("_bucket")


def interval_overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    width: int | Column | None = None,
    hot_rows: int | None = DEFAULT_HOT_ROWS,
    clip: bool = False,
    hot_side: str = "right",
) -> DataFrame:
    """Every pair of overlapping intervals of one group, once.

    Both sides go into all buckets they touch; a pair is kept only in the
    bucket of the later start, which both always share. ``clip`` adds the
    common part as ``clip_start`` and ``clip_end``. By default the right side
    (reads, fragments) is the one whose buckets can be hot. ``width`` is the
    bucket width, by default the larger of the two mean lengths.
    """
    (ls, le), (rs, re) = left_range, right_range
    width = _width(width, (left, ls, le), (right, rs, re))
    a = left.filter(F.col(le) > F.col(ls)).withColumn("_bucket", _buckets(F.col(ls), F.col(le), width))
    b = right.filter(F.col(re) > F.col(rs)).withColumn("_bucket", _buckets(F.col(rs), F.col(re), width))
    later = F.greatest(F.col(ls), F.col(rs))
    hit = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.col("_bucket") == floor_div(later, width))
    pairs = salted_join(a, b, [*keys, "_bucket"], hit, "inner", hot_rows, hot_side).drop("_bucket")
    if clip:
        pairs = pairs.withColumn("clip_start", later).withColumn("clip_end", F.least(F.col(le), F.col(re)))
    return pairs


def running_max(
    df: DataFrame, keys: list[str], pos: str, value: str, name: str, width: int, inclusive: bool = True
) -> DataFrame:
    """Running maximum of ``value`` by ``pos`` per group; needs at most one row per group and position.

    Two levels: a window inside each (group, bucket), at most ``width`` rows,
    and one row per bucket that carries the maximum of the buckets before it.
    Both read ``df``, so it is computed once and stored.
    """
    df = materialize(df)
    last = 0 if inclusive else -1
    local = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, last)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bucketed = df.withColumn("_b", floor_div(pos, width))
    carry = (
        bucketed.groupBy(*keys, "_b")
        .agg(F.max(value).alias("_top"))
        .select(*keys, "_b", F.max("_top").over(earlier).alias("_carry"))
    )
    joined = bucketed.select("*", F.max(value).over(local).alias("_here")).join(carry, [*keys, "_b"])
    return joined.select(*df.columns, F.greatest("_here", "_carry").alias(name))


def merge_intervals(
    intervals: DataFrame,
    keys: list[str],
    start: str = "st",
    end: str = "en",
    padding: int = 0,
    width: int = 1_000_000,
) -> DataFrame:
    """Pad by ``padding`` on both sides and merge intervals that touch or overlap.

    Equal starts collapse first, so no window sees more than ``width`` rows
    however many intervals share a place.
    """
    padded = intervals.groupBy(*keys, (F.col(start) - padding).cast("long").alias("_s")).agg(
        (F.max(end) + padding).cast("long").alias("_e")
    )
    reached = running_max(padded, keys, "_s", "_e", "_reach", width, inclusive=False)
    opened = reached.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_reach") < F.col("_s")), F.col("_s")))
    islands = running_max(opened, keys, "_s", "_new", "_island", width)
    return islands.groupBy(*keys, F.col("_island").alias(start)).agg(F.max("_e").alias(end))


def in_regions(
    df: DataFrame,
    regions: DataFrame,
    keys: list[str],
    pos: str | None = None,
    span: tuple[str, str] | None = None,
    start: str = "st",
    end: str = "en",
    negate: bool = False,
    width: int | Column | None = None,
    hot_rows: int | None = DEFAULT_HOT_ROWS,
) -> DataFrame:
    """Rows whose point or interval hits any region; ``negate`` keeps the others.

    Regions are merged first. Each merged region remembers where the one before
    it ended, so an interval that hits several meets exactly one "first" region
    and the semi join needs no distinct. The negated interval form compares
    whole rows, so its columns must be comparable (no maps).
    """
    width = _width(width, (regions, start, end))
    merged = merge_intervals(regions, keys, start, end).select(
        *keys, F.col(start).alias("_ms"), F.col(end).alias("_me")
    )
    if pos is not None:
        how = "left_anti" if negate else "left_semi"
        return point_in_interval_join(df, merged, keys, pos, "_ms", "_me", width, how, hot_rows)
    first = running_max(merged, keys, "_ms", "_me", "_before", 1_000_000, inclusive=False)
    pairs = interval_overlap_join(df, first, keys, span, ("_ms", "_me"), width, hot_rows, hot_side="left")
    hits = pairs.filter(F.col("_before").isNull() | (F.col("_before") <= F.col(span[0]))).select(*df.columns)
    if not negate:
        return hits
    renamed = hits.distinct().select(*[F.col(c).alias(f"_h_{c}") for c in df.columns])
    same = F.lit(True)
    for c in df.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_h_{c}"))
    return df.join(renamed, same, "left_anti")


def tile_contigs(
    contigs: DataFrame, contig="contig", length="len", bin_size: int | None = None, num_bins: int | None = None
) -> DataFrame:
    """Contigs cut into tiles of ``bin_size``, or of ceil(total length / ``num_bins``)."""
    if bin_size is None and num_bins is None:
        raise ValueError("give bin_size or num_bins")
    size = F.lit(bin_size).cast("long")
    if bin_size is None:
        size = contigs.agg(F.ceil(F.sum(length) / num_bins).cast("long")).scalar()
    sized = contigs.select(contig, F.col(length).cast("long").alias("_len"), size.alias("_size"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_len") - 1, F.col("_size")))
    return sized.select(contig, "_len", "_size", starts.alias("start")).select(
        contig, "start", F.least(F.col("start") + F.col("_size"), F.col("_len")).alias("end")
    )


def restrict_to_contigs(df: DataFrame, names: list[str], contig: str = "contig") -> DataFrame:
    return df.filter(F.col(contig).isin(*names))


def fetch_region(
    df: DataFrame, contig: str, start: int | None = None, end: int | None = None,
    columns: tuple[str, str, str] = ("contig", "st", "en"),
) -> DataFrame:
    """Rows of one contig that overlap ``[start, end)``; the filters reach the scan."""
    name, first, last = columns
    out = df.filter(F.col(name) == contig)
    if end is not None:
        out = out.filter(F.col(first) < end)
    if start is not None:
        out = out.filter(F.col(last) > start)
    return out
