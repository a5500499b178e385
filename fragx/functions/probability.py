"""Class-probability vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fragx import constants as K
from fragx.functions.common import col


def softmax(logits: Column | str) -> Column:
    logits = col(logits)
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def normalize(weights: Column | str) -> Column:
    weights = col(weights)
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.transform(weights, lambda x: F.try_divide(x.cast("double"), total))


def healthy_classes(width: int) -> int:
    """How many leading classes count as healthy for a vector of this width."""
    # Healthy classes by vector width.
    table = {4: 3, 12: 3, 3: 2, 11: 2, 10: 1}
    if width not in table:
        raise ValueError(f"no healthy classes known for {width} classes")
    return table[width]


def collapse_health(probs: Column | str, width: int = 11) -> Column:
    """struct(healthy, cancer); two classes are read as (healthy, cancer)."""
    probs = col(probs)
    if width == 2:
        return F.struct((F.lit(1.0) - probs[1]).alias("healthy"), probs[1].cast("double").alias("cancer"))
    healthy = F.lit(0.0)
    for i in range(healthy_classes(width)):
        healthy = healthy + probs[i]
    return F.struct(healthy.alias("healthy"), (F.lit(1.0) - healthy).alias("cancer"))


def origin_probs(probs: Column | str) -> Column:
    """Named site probabilities as an array of (site, probability)."""
    probs = col(probs)
    return F.array(
        *[F.struct(F.lit(name).alias("site"), probs[i].alias("probability")) for i, name in K.ORIGIN_CLASSES.items()]
    )


def ranked_classes(probs: Column | str) -> Column:
    """Class indexes by descending probability; equal probabilities keep class order."""
    ranked = F.array_sort(F.transform(col(probs), lambda p, i: F.struct((-p).alias("neg"), i.alias("i"))))
    return F.transform(ranked, lambda s: s["i"])
