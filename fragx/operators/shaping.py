"""Sharding, batching, chunking and weighted mixing of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fragx.operators.intervals import point_in_interval_join
from fragx.operators.ordering import row_numbers, running_totals


def contiguous_chunks(df: DataFrame, order: list[Column], workers: int, name: str = "worker") -> DataFrame:
    """Consecutive chunks of ceil(n / workers) rows."""
    size = df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / workers), F.lit(1)).cast("long")).scalar()
    ranked = row_numbers(df, order)
    return ranked.withColumn(name, F.floor((F.col("rn") - 1) / size).cast("long")).drop("rn")


def shard_contiguous(df: DataFrame, order: list[Column], workers: int, name: str = "shard") -> DataFrame:
    """Contiguous shards; the first ``n % workers`` hold one row more. Shards count from 0."""
    total = df.agg(F.count(F.lit(1))).scalar()
    ranked = row_numbers(df, order)
    i = F.col("rn") - 1
    small = F.floor(total / workers)
    extra = total % workers
    edge = (small + 1) * extra
    shard = F.when(i < edge, F.floor(i / (small + 1))).otherwise(
        extra + F.floor(F.try_divide(i - edge, small))
    )
    return ranked.withColumn(name, shard.cast("long")).drop("rn")


def shard_strided(
    df: DataFrame, order: list[Column], workers: int, drop_last: bool = False, pad: bool = False, name: str = "shard"
) -> DataFrame:
    """Round-robin shards; ``drop_last`` drops the incomplete round, ``pad`` repeats rows from the start."""
    total = df.agg(F.count(F.lit(1))).scalar()
    ranked = row_numbers(df, order).withColumn("rn", F.col("rn") - 1)
    if drop_last:
        ranked = ranked.filter(F.col("rn") < total - total % workers)
    elif pad:
        missing = F.pmod(-total, F.lit(workers))
        # Row i stands again at every padding slot p with (p - total) % total == i.
        slots = F.when(
            missing > F.col("rn"),
            F.sequence(total + F.col("rn"), total + missing - 1, total),
        ).otherwise(F.array().cast("array<bigint>"))
        ranked = ranked.select(
            *df.columns, F.explode(F.concat(F.array(F.col("rn")), slots)).alias("rn")
        )
    return ranked.withColumn(name, (F.col("rn") % workers).cast("long")).drop("rn")


def batches(df: DataFrame, order: list[Column], size: int, drop_last: bool = False) -> DataFrame:
    """``batch`` id per row; ``drop_last`` drops an incomplete last batch."""
    ranked = row_numbers(df, order)
    if drop_last:
        total = df.agg(F.count(F.lit(1))).scalar()
        ranked = ranked.filter(F.col("rn") <= total - total % size)
    return ranked.withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("long")).drop("rn")


def chunk_documents(df: DataFrame, size: str, seq_len: int, min_length: int = 0) -> DataFrame:
    """Offsets of fixed-length chunks per item; the last chunk is moved back to end with the item.

    The usable length of an item is its size minus one.
    """
    usable = F.col(size) - 1
    count = F.ceil(usable / seq_len)
    last = F.greatest(usable - 1 - seq_len, F.lit(0))
    return (
        df.filter((usable > 0) & (F.col(size) >= min_length))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)))
        .withColumn("offset", F.least(F.col("chunk") * seq_len, last).cast("long"))
    )


def pack_sequences(df: DataFrame, key: str, size: str, seq_len: int, order: list[Column]) -> DataFrame:
    """Where every fixed-length sample of the concatenated items starts: (sample, key, offset).

    Sample i starts at token i * seq_len; only complete samples (one token more
    than ``seq_len`` for the shifted target) are listed. Each item derives the
    samples that start in it from its own running total.
    """
    ends = running_totals(df.select(key, F.col(size).cast("long").alias("_n")), {"_end": F.col("_n")}, order)
    total = df.agg(F.sum(F.col(size).cast("long"))).scalar()
    samples = F.floor((total - 1) / seq_len)
    begin = F.col("_end") - F.col("_n")
    first = F.ceil(begin / seq_len).cast("long")
    last = F.least(F.ceil(F.col("_end") / seq_len), samples).cast("long") - 1
    listed = ends.filter((last >= first) & (F.col("_n") > 0)).withColumn(
        "sample", F.explode(F.sequence(first, last))
    )
    return listed.select("sample", key, (F.col("sample") * seq_len - begin).alias("offset"))


def blend(
    spark: SparkSession,
    sources: list[DataFrame],
    weights: list[float],
    order: list[Column],
    num_samples: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Rows drawn with replacement from several sources; every row of a source has the source's weight.

    Draws are seeded hashes of their number, so a retried task draws the same.
    Only source totals reach the driver: a draw becomes (source, row number) by
    arithmetic and meets the numbered rows in an equi-join.
    """
    counts = [s.count() for s in sources]
    if num_samples is None:
        num_samples = sum(counts)
    mass = [c * w for c, w in zip(counts, weights)]
    total = sum(mass)
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.lit(str(seed)))), 1, 13), 16, 10)
    unit = drawn.cast("long").cast("double") / float(1 << 52) * total
    draws = spark.range(num_samples).select(F.col("id").alias("draw")).withColumn("_u", unit)
    source, rown, begin = F.lit(None).cast("int"), F.lit(None).cast("long"), 0.0
    for i, (count, weight, m) in enumerate(zip(counts, weights, mass)):
        if m > 0:
            inside = (F.col("_u") >= begin) & (F.col("_u") < begin + m)
            index = F.least(F.floor((F.col("_u") - begin) / weight), F.lit(count - 1)) + 1
            source, rown = F.when(inside, i).otherwise(source), F.when(inside, index).otherwise(rown)
            begin += m
    located = draws.select("draw", source.alias("source"), rown.alias("rn"))
    numbered = None
    for i, frame in enumerate(sources):
        part = row_numbers(frame, order).withColumn("source", F.lit(i))
        numbered = part if numbered is None else numbered.unionByName(part)
    return located.join(numbered, ["source", "rn"]).drop("rn")


def token_lengths(df: DataFrame, text: str, keys: list[str] | None = None) -> DataFrame:
    """Number of items, total, smallest and largest size."""
    size = F.length(text).cast("long")
    return df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("items"), F.sum(size).alias("total"), F.min(size).alias("shortest"),
        F.max(size).alias("longest"),
    )


def sub_span(value: str, offset: Column | int, length: Column | int) -> Column:
    """Part of a text by 0-based offset and length."""
    at = (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    size = length if isinstance(length, Column) else F.lit(length)
    return F.substring(F.col(value), at.cast("int"), size.cast("int"))


def pad_arrays(df: DataFrame, batch: str, value: str, pad: Column, name: str = "padded") -> DataFrame:
    """Arrays filled up to the longest of their batch."""
    longest = df.groupBy(batch).agg(F.max(F.size(value)).alias("_longest"))
    joined = df.join(longest, batch)
    return joined.withColumn(
        name, F.concat(F.col(value), F.array_repeat(pad, F.col("_longest") - F.size(value)))
    ).drop("_longest")
