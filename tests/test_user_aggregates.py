"""User aggregates with a map-side part, against plain Python and the built-in functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragx.operators import metrics as M
from fragx.operators import modeling as L


def spread():
    """The class lies in a function so that it travels to the workers by value."""

    class Spread(L.Aggregate):
        """Largest less smallest value; counts the states that were merged."""

        def init(self):
            return (np.inf, -np.inf, 1)

        def update(self, state, frame):
            x = frame["x"].dropna()
            return (min(state[0], x.min()), max(state[1], x.max()), state[2]) if len(x) else state

        def merge(self, state, other):
            return (min(state[0], other[0]), max(state[1], other[1]), state[2] + other[2])

        def finish(self, state):
            return [float(state[1] - state[0]), float(state[2])]

    return Spread()


def test_hot_group_is_folded_in_many_tasks(spark):
    """One group holds nine tenths of the rows; every task sends one state of it."""
    rows = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(-1).alias("k"), (F.col("id") * 37 % 1009).cast("double").alias("x")
    )
    got = {r.k: r.value for r in L.user_aggregate(rows, ["k"], ["x"], spread(), "array<double>", fan=3).collect()}
    want = {r.k: r.w for r in rows.groupBy("k").agg((F.max("x") - F.min("x")).alias("w")).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert got[-1][1] == 8


def test_auc_of_one_group_equals_the_built_in(spark):
    scored = spark.range(0, 20_000, 1, 8).select(
        (F.floor(F.rand(5) * 1000) / 1000).alias("score"), F.lit("all").alias("g"), F.col("id")
    ).withColumn("y", (F.rand(6) < F.col("score")).cast("int")).withColumn("score", (F.col("score") * 1000 + 0.5) / 1000).cache()
    got = L.user_aggregate(scored, ["g"], ["y", "score"], L.BinnedAuc("y", "score"), "double").collect()[0].value
    rows = scored.select("y", "score").toPandas()
    ranks = rows.score.rank()
    p = rows.y.sum()
    want = (ranks[rows.y == 1].sum() - p * (p + 1) / 2) / (p * (len(rows) - p))
    assert got == pytest.approx(want, abs=1e-9)
    assert got == pytest.approx(M.auc(scored, "score", "y").collect()[0].auc, abs=1e-9)


def test_null_keys_few_open_groups_no_keys_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1.0), (None, 2.0), (1, 4.0), (None, 7.0), (2, None)], "k long, x double")
    out = L.user_aggregate(rows, ["k"], ["x"], spread(), "array<double>", open_groups=1)
    assert out.schema["k"].dataType.simpleString() == "bigint"
    assert {r.k: r.value[0] for r in out.collect()} == {1: 3.0, None: 5.0, 2: -np.inf}
    assert [r.value[0] for r in L.user_aggregate(rows, [], ["x"], spread(), "array<double>").collect()] == [6.0]
    assert L.user_aggregate(rows.limit(0), ["k"], ["x"], spread(), "array<double>").collect() == []


def test_search_weighs_classes_and_keeps_groups_together(spark):
    """One class in twenty: unweighted fits would score a lone majority vote with 0.95, weighted ones with 0.5."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 30, int(i % 20 == 0), [float(x) for x in rng.normal(size=2)]) for i in range(600)]  # features say nothing
    df = spark.createDataFrame(rows, "id long, subject long, label int, features array<double>")
    for group in (None, "subject"):
        search = L.grid_search(df, {"numTrees": [3], "maxDepth": [2]}, group=group)
        assert 0.2 < search.avgMetrics[0] < 0.8
    useful = df.withColumn("features", F.array(F.col("label").cast("double"), F.lit(0.0)))
    assert L.grid_search(useful, {"numTrees": [3], "maxDepth": [2]}, group="subject").avgMetrics[0] > 0.9
