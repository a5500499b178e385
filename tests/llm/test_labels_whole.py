"""Every labelled document counts, however many there are, and no list of ids goes through the driver."""

from __future__ import annotations

import inspect

import numpy as np
from pyspark.sql import DataFrame

from fragx.llm import quality


def test_all_labelled_ids_are_trusted(spark):
    n = 150_000  # a sample took at most 131 072 of them
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.labelled_ids(labels, True).count() == n
    assert "max" not in str(inspect.signature(quality.fit))


def test_model_keeps_ids_as_a_table(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(1, 40))) for i in range(1, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 20)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert isinstance(model.trusted, DataFrame) and model.shared().trusted is None
    assert model.trusts([1, 2, None, 19, 99]).tolist() == [True, False, False, True, False]


def test_cut_of_a_table_equals_the_local_one(spark):
    rng = np.random.default_rng(5)
    for n_good, n_bad in ((200, 50), (1, 0), (0, 3), (40, 40)):
        good, bad = np.round(rng.normal(1, 1, n_good), 1), np.round(rng.normal(0, 1, n_bad), 1)
        at = np.unique(np.concatenate([good, bad]))
        counts = spark.createDataFrame([(float(x), int((good == x).sum()), int((bad == x).sum())) for x in at], "score double, good long, bad long")
        assert quality.best_cut_of(counts) == quality.best_cut(good, bad)
