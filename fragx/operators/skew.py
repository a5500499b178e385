"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: None leaves skew to adaptive execution, which splits a hot partition without another pass over the rows.
DEFAULT_HOT_ROWS: int | None = None


def hot_keys(df: DataFrame, keys: list[str], rows_per_salt: int) -> DataFrame:
    """Keys with more rows than one task should take, and the number of salts for each.

    The count combines on the map side, and at most ``rows / rows_per_salt``
    keys remain, so the result is small whatever the skew.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows_per_salt)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_salt).cast("int").alias("_salts"))
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    condition: Column | None = None,
    how: str = "inner",
    hot_rows: int | None = DEFAULT_HOT_ROWS,
    hot_side: str = "left",
) -> DataFrame:
    """Join on ``keys`` (present on both sides) with hot keys of one side spread over salts.

    Rows of a hot key are dealt over salts by a hash of the row and its input
    partition, so even exact copies spread; the other side's rows of that key
    are repeated once per salt. Other keys keep one salt and are not repeated.
    ``hot_side`` names the side that can hold the mass; semi, anti and left
    joins can only spread the left side. ``condition`` may name any column of
    either side. ``hot_rows=None`` leaves skew to AQE, which splits a skewed
    partition of either side at run time.
    """
    right_keys = {k: f"_r_{k}" for k in keys}
    on = list(keys)
    if hot_rows is not None:
        from_left = hot_side == "left" or how != "inner"
        hot = hot_keys(left if from_left else right, keys, hot_rows)
        left = _deal(left, hot, keys) if from_left else _repeat(left, hot, keys)
        right = _repeat(right, hot, keys) if from_left else _deal(right, hot, keys)
        on.append("_salt")
        right_keys["_salt"] = "_r__salt"
    for key, alias in right_keys.items():
        right = right.withColumnRenamed(key, alias)
    match = F.lit(True)
    for key in on:
        match = match & (F.col(key) == F.col(right_keys[key]))
    if condition is not None:
        match = match & condition
    joined = left.join(right, match, how)
    return joined.drop("_salt", *right_keys.values())


def _deal(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """One salt per row. The partition id is fixed for a planned stage, so a retried task deals the same."""
    hashed = [name for name, kind in df.dtypes if "map<" not in kind]  # maps have no hash
    spread = F.pmod(F.xxhash64(*hashed) + F.spark_partition_id(), F.coalesce("_salts", F.lit(1)))
    return df.join(hot, keys, "left").withColumn("_salt", spread.cast("int")).drop("_salts")


def _repeat(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Every salt of the row's key."""
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    return df.join(hot, keys, "left").withColumn("_salt", salts).drop("_salts")
