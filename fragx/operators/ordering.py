"""Global ranks and running totals without a single-task window.

A window over the whole table, or over one huge group, runs in one task. Here
the rows are range-partitioned once, the cut is frozen with a checkpoint, each
slice computes locally, and slice totals (one row per group and slice) carry
the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fragx.functions.common import col
from fragx.session import ensure_checkpoint_dir, materialize


def sliced(df: DataFrame, keys: list[str], order: list[Column], slices: int | None = None) -> DataFrame:
    """``df`` plus ``_slice`` (rank of its range partition) and ``_tie`` (order within equal keys).

    ``_tie`` takes part in the ranges, so rows with equal keys split as well.
    The checkpoint makes both columns plain data: a lost executor or a second
    use of the frame cannot cut the ranges differently. Range partitioning
    samples its input first, so give it a stored table or a narrow selection.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(
        n, *[F.col(k) for k in keys], *order, F.col("_tie")
    )
    return ranged.withColumn("_slice", F.spark_partition_id()).checkpoint(eager=True)


def running_totals(
    df: DataFrame,
    sums: dict[str, Column | str],
    order: list[Column],
    keys: list[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Inclusive running sums per group in the given order, named by ``sums``."""
    keys = list(keys or [])
    frame = sliced(df, keys, order, slices)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order, "_tie")
    local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = frame.groupBy(*keys, "_slice").agg(*[F.sum(col(c)).alias(f"_t_{n}") for n, c in sums.items()])
    offsets = totals.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    ranked = frame.select("*", *[F.sum(col(c)).over(local).alias(f"_l_{n}") for n, c in sums.items()])
    return ranked.join(offsets, [*keys, "_slice"]).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def row_numbers(
    df: DataFrame, order: list[Column], keys: list[str] | None = None, name: str = "rn", slices: int | None = None
) -> DataFrame:
    """1-based row number per group (or over the whole table) in the given order."""
    return running_totals(df, {name: F.lit(1).cast("long")}, order, keys, slices)


def contig_rank(contig: Column | str, order: list[str] | None = None) -> Column:
    """Position of a contig in genome order; unknown contigs come last."""
    from fragx.constants import GENOME_ORDER
    from fragx.functions.common import string_array

    names = order or GENOME_ORDER
    rank = F.array_position(string_array(names), col(contig))
    return F.when(rank == 0, F.lit(len(names) + 1)).otherwise(rank).cast("int")


def genome_order(df: DataFrame, contig="contig", pos="pos", order: list[str] | None = None, reverse: bool = False):
    """Sort by contig rank, then contig name for unknown contigs, then position. The sort samples its rows first, so they are stored."""
    df = materialize(df)
    keys = [contig_rank(contig, order), F.col(contig), F.col(pos)]
    return df.orderBy(*[k.desc() if reverse else k.asc() for k in keys])


def top_ratio(
    df: DataFrame, ratio: float, score: str, ties: list[str], keys: list[str] | None = None
) -> DataFrame:
    """The best floor(n * ratio) rows per group by score."""
    keys = list(keys or [])
    ranked = row_numbers(df, [F.col(score).desc(), *[F.col(t).asc() for t in ties]], keys)
    counts = df.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_keep"))
    if not keys:
        return ranked.filter(F.col("rn") <= counts.scalar()).drop("rn")
    return ranked.join(counts, keys).filter(F.col("rn") <= F.col("_keep")).drop("rn", "_keep")


def shuffle_key(key: str, seed: int = 42) -> Column:
    """A seeded hash of the key that any engine with MD5 repeats."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A repeatable permutation by a seeded hash of the key."""
    return df.orderBy(shuffle_key(key, seed), F.col(key))
