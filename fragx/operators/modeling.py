"""User functions and models over groups and batches; tree models on Spark ML."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def group_apply(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A pandas function per group.

    A group is held in memory by one task: use it for groups with a known bound
    (a sample's bins, a site's fragments), never for all reads of a contig.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)


def map_batches(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A model function over Arrow batches; rows stay where they are, so nothing is shuffled.

    ``predict`` gets a pandas frame and returns one with the columns of
    ``schema``. The batch size is spark.sql.execution.arrow.maxRecordsPerBatch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield predict(batch)

    return df.mapInPandas(run, schema)


class Aggregate:
    """A user's aggregate: subclass it; states are pickled, so keep them small whatever the number of rows.

    ``merge`` has to be associative and commutative: rows meet in any order.
    """

    def init(self):
        raise NotImplementedError

    def update(self, state, frame: pd.DataFrame):
        """``state`` with the rows of ``frame`` added."""
        raise NotImplementedError

    def merge(self, state, other):
        raise NotImplementedError

    def finish(self, state):
        """The result, of the type that ``user_aggregate`` was told."""
        return state


def user_aggregate(
    df: DataFrame, keys: list[str], columns: list[str], aggregate: Aggregate, returns: str, name: str = "value",
    open_groups: int = 4096, fan: int = 64,
) -> DataFrame:
    """``aggregate`` per group, with a part on the map side: one row per group, key columns and ``name``.

    Every task folds its rows into one state per group and sends states only,
    at most ``open_groups`` held at a time; a hot group is so worked on by all
    tasks. States are merged in two steps, first over ``fan`` salts. Null keys
    make a group, rows without columns for it are not dropped; an empty table
    gives no row. ``keys`` may be empty only if one row for all is wanted.
    """
    from pyspark.sql.functions import pandas_udf

    state_name, salt = "_state", "_salt"
    used = [*keys, *[c for c in columns if c not in keys]]

    def fold(batches):
        states: dict[tuple, object] = {}
        types: list = []

        def out():
            held = [pa.array([k[i] for k in states], t) for i, t in enumerate(types)]
            held.append(pa.array([pickle.dumps(s) for s in states.values()], pa.binary()))
            states.clear()
            return pa.RecordBatch.from_arrays(held, names=[*keys, state_name])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(k).type for k in keys]
            places: dict[tuple, list[int]] = {}
            rows = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else [()] * batch.num_rows
            for at, key in enumerate(rows):
                places.setdefault(key, []).append(at)
            for key, found in places.items():
                part = batch if len(found) == batch.num_rows else batch.take(pa.array(np.array(found, np.int64)))
                state = states[key] if key in states else aggregate.init()
                states[key] = aggregate.update(state, part.select(columns).to_pandas())
                if len(states) >= open_groups:
                    yield out()
        if states:
            yield out()

    def merged(states: pd.Series):
        return reduce(aggregate.merge, map(pickle.loads, states))

    @pandas_udf("binary")
    def combine(states: pd.Series) -> bytes:
        return pickle.dumps(merged(states))

    @pandas_udf(returns)
    def finish(states: pd.Series) -> float:  # the type that counts is ``returns``
        return aggregate.finish(merged(states))

    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"{state_name} binary"])
    parts = df.select(*used).mapInArrow(fold, schema).withColumn(salt, F.spark_partition_id() % fan)
    once = parts.groupBy(*keys, salt).agg(combine(state_name).alias(state_name))
    return once.groupBy(*keys).agg(finish(state_name).alias(name)) if keys else once.groupBy(F.lit(1).alias(salt)).agg(finish(state_name).alias(name)).drop(salt)


class BinnedAuc(Aggregate):
    """Area under the ROC curve of scores from 0 to 1 in ``bins`` equal bins; ties within a bin count half."""

    def __init__(self, truth: str, score: str, bins: int = 1000):
        self.truth, self.score, self.bins = truth, score, bins

    def init(self):
        return np.zeros((2, self.bins + 1), np.int64)

    def update(self, state, frame):
        frame = frame.dropna()
        at = np.floor(frame[self.score].to_numpy(float) * self.bins).astype(int)
        np.add.at(state, (frame[self.truth].to_numpy(int), at), 1)
        return state

    def merge(self, state, other):
        return state + other

    def finish(self, state):
        negative, positive = state.astype(float)
        pairs = negative.sum() * positive.sum()
        below = np.cumsum(negative) - negative
        return float((positive * (below + negative / 2)).sum() / pairs) if pairs else None


def fit_classifier(
    rows: DataFrame, features: str = "features", label: str = "label", kind: str = "forest", **params
):
    """A tree ensemble with balanced class weights; ``features`` is an array of doubles.

    ``forest`` takes any number of classes, ``boosted`` two.
    """
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    from fragx.operators.metrics import balanced_weights

    weighted = balanced_weights(as_vectors(rows, features), label, "_weight")
    model = {"forest": RandomForestClassifier, "boosted": GBTClassifier}[kind]
    return model(featuresCol="_vector", labelCol=label, weightCol="_weight", **params).fit(weighted)


def as_vectors(rows: DataFrame, features: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("_vector", array_to_vector(F.col(features).cast("array<double>")))


def predict_classes(model, rows: DataFrame, features: str = "features", probs: str = "probs") -> DataFrame:
    """Class probabilities of a fitted model as an array column."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(as_vectors(rows, features))
    return scored.withColumn(probs, vector_to_array("probability")).drop(
        "_vector", "rawPrediction", "probability", "prediction"
    )


def grid_search(
    rows: DataFrame, params: dict[str, list], features: str = "features", label: str = "label", folds: int = 3,
    seed: int = 42, parallelism: int = 2, group: str | None = None,
):
    """Cross-validated search over forest parameters; gives the fitted search model.

    Classes weigh the same in the fits and in the accuracy. With ``group`` the
    rows of a group share a fold (``grouped_folds``).
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from fragx.operators.metrics import balanced_weights
    from fragx.session import materialize

    forest = RandomForestClassifier(featuresCol="_vector", labelCol=label, weightCol="_weight", seed=seed)
    grid = ParamGridBuilder()
    for name, values in params.items():
        grid = grid.addGrid(getattr(forest, name), values)
    search = CrossValidator(
        estimator=forest, estimatorParamMaps=grid.build(), numFolds=folds, seed=seed, parallelism=parallelism,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, weightCol="_weight", metricName="accuracy"),
    )
    weighted = balanced_weights(rows, label, "_weight")
    if group is not None:
        weighted = materialize(grouped_folds(weighted, group, label, folds, seed, "_fold"))
        search = search.setFoldCol("_fold")
    return search.fit(as_vectors(weighted, features))


def grouped_folds(rows: DataFrame, group: str, label: str, folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """``rows`` with a fold from 0 on: all rows of a group share it, and folds get alike numbers of rows of each class.

    A group counts as its commonest class (the smallest of equals). The groups of a class are
    ordered by falling size, ties by a seeded hash, and dealt to and fro over
    the folds. Only one row per group is ordered, in slices. Rows with a null group
    make one group.
    """
    from fragx.operators.ordering import row_numbers, shuffle_key

    counts = rows.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    first = F.max_by(label, F.struct("_n", (-F.col(label).cast("double")).alias("low"))).alias("_class")
    groups = counts.groupBy(group).agg(F.sum("_n").alias("_n"), first).withColumn("_hash", shuffle_key(group, seed))
    ranked = row_numbers(groups, [F.col("_n").desc(), F.col("_hash"), F.col(group)], ["_class"], "_rn")
    lap, place = F.floor((F.col("_rn") - 1) / folds), (F.col("_rn") - 1) % folds
    fold = F.when(lap % 2 == 0, place).otherwise(folds - 1 - place).cast("int")
    dealt = ranked.select(F.col(group).alias("_group"), fold.alias(name))
    return rows.join(dealt, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def cross_validate(
    rows: DataFrame, group: str, features: str = "features", label: str = "label", folds: int = 3, seed: int = 42, **params
) -> DataFrame:
    """Every row with the probabilities of the model that did not see its group, and its ``fold``.

    One model per fold, with class weights balanced within its training rows.
    ``class_metrics`` over ``confusion_matrix(..., keys=["fold"])`` gives metrics per split.
    """
    from functools import reduce

    from fragx.session import materialize

    split = materialize(grouped_folds(rows, group, label, folds, seed))
    held = []
    for fold in range(folds):
        model = fit_classifier(split.filter(F.col("fold") != fold), features, label, **params)
        held.append(predict_classes(model, split.filter(F.col("fold") == fold), features))
    return reduce(DataFrame.unionByName, held)
