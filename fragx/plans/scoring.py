"""Features to sample scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fragx.functions import probability as P
from fragx.operators.features import feature_vectors
from fragx.operators.modeling import map_batches


def score_samples(features: DataFrame, required: list[str], predict: Callable, key: str = "sample_id") -> DataFrame:
    """Class probabilities per sample from a caller-supplied model over aligned feature vectors."""
    vectors = feature_vectors(features, required, key)
    return map_batches(vectors, predict, f"{key} string, probs array<double>")


def reports(scored: DataFrame, key: str = "sample_id", probs: str = "probs") -> tuple[DataFrame, DataFrame]:
    """(healthy and cancer probability, origin probabilities) per sample, with the report column names."""
    health = P.collapse_health(probs, 11)
    short = scored.select(
        key, health["healthy"].alias("probability_healthy"), health["cancer"].alias("probability_cancer")
    )
    from fragx.constants import ORIGIN_CLASSES

    sites = [F.col(probs)[i].alias(f"probability_{name}") for i, name in ORIGIN_CLASSES.items()]
    return short, scored.select(key, health["healthy"].alias("probability_healthy"), *sites)
