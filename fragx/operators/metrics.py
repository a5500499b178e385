"""Evaluation metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from fragx.functions import probability as P
from fragx.operators.ordering import running_totals

_ALL = "_all"


def _grouped(df: DataFrame, keys: list[str] | None) -> tuple[DataFrame, list[str]]:
    """A constant group when there are no keys, so that one code path serves both."""
    return (df, list(keys)) if keys else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def _beside(df: DataFrame, one: DataFrame, keys: list[str] | None) -> DataFrame:
    """``df`` with the columns of ``one`` of its group; without keys ``one`` is a single row, read as a scalar subquery."""
    if keys:
        return df.join(one, keys)
    names = [c for c in one.columns if c != _ALL]
    row = one.select(F.struct(*names)).scalar()
    return df.withColumns({c: row[c] for c in names})


def score_counts(
    df: DataFrame, score: str, label: str, keys: list[str], weight: str | None = None, positive: int = 1
) -> DataFrame:
    """Positive and negative rows (or weight) per distinct score: the only part that touches all rows."""
    amount = F.col(weight) if weight else F.lit(1)
    hit = F.col(label) == positive
    kind = "double" if weight else "long"
    return df.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.when(hit, amount).otherwise(0)).cast(kind).alias("_tp"),
        F.sum(F.when(hit, 0).otherwise(amount)).cast(kind).alias("_fp"),
    )


def roc_curve(
    df: DataFrame, score: str, label: str, keys: list[str] | None = None, weight: str | None = None, positive: int = 1
) -> DataFrame:
    """True and false positives at every distinct score, from the highest score down."""
    grouped, by = _grouped(df, keys)
    counts = score_counts(grouped, score, label, by, weight, positive)
    curve = running_totals(counts, {"tps": "_tp", "fps": "_fp"}, [F.col("threshold").desc()], by)
    return curve.select(*(keys or []), "threshold", "tps", "fps", F.col("_tp").alias("tp_step"), F.col("_fp").alias("fp_step"))


def auc(
    df: DataFrame, score: str, label: str, keys: list[str] | None = None, weight: str | None = None, positive: int = 1
) -> DataFrame:
    """Area under the curve; 0 when a class is empty. Each step adds a trapezoid of its own counts."""
    curve, by = _grouped(roc_curve(df, score, label, keys, weight, positive), keys)
    area = F.sum(F.col("fp_step") * (F.col("tps") * 2 - F.col("tp_step")) / 2)
    mass = F.sum("tp_step") * F.sum("fp_step")
    out = curve.groupBy(*by).agg(F.coalesce(F.try_divide(area, mass), F.lit(0.0)).cast("double").alias("auc"))
    return out.select(*(keys or []), "auc")


def sensitivity_at_specificity(
    df: DataFrame, score: str, label: str, specificity: float, keys: list[str] | None = None
) -> DataFrame:
    """Sensitivity, specificity and threshold at the last point whose false positive rate fits.

    The curve starts at the point with nothing called (threshold infinity).
    """
    curve, by = _grouped(roc_curve(df, score, label, keys), keys)
    totals = curve.groupBy(*by).agg(F.sum("tp_step").alias("_pos"), F.sum("fp_step").alias("_neg"))
    rates = _beside(curve, totals, keys).withColumn("_fpr", F.coalesce(F.try_divide("fps", "_neg"), F.lit(0.0)))
    fits = F.col("_fpr") <= F.lit(1.0 - specificity)
    point = F.struct(
        F.coalesce(F.try_divide("tps", "_pos"), F.lit(0.0)).alias("sensitivity"), (1 - F.col("_fpr")).alias("specificity"),
        F.col("threshold").alias("threshold"),
    )
    last = rates.groupBy(*by).agg(F.max_by(F.when(fits, point), F.when(fits, -F.col("threshold"))).alias("_p"))
    return last.select(
        *(keys or []), F.coalesce("_p.sensitivity", F.lit(0.0)).alias("sensitivity"),
        F.coalesce("_p.specificity", F.lit(1.0)).alias("specificity"),
        F.coalesce("_p.threshold", F.lit(float("inf"))).alias("threshold"),
    )


def confusion_matrix(
    df: DataFrame, truth: str, predicted: str, num_classes: int, keys: list[str] | None = None,
    mask: Column | None = None, ignore: int | None = None,
) -> DataFrame:
    """Counts by (true, predicted) class with the missing cells as 0."""
    if mask is not None:
        df = df.filter(mask)
    if ignore is not None:
        df = df.filter(F.col(truth) != ignore)
    by = list(keys or [])
    counts = df.groupBy(*by, F.col(truth).cast("int").alias("y"), F.col(predicted).cast("int").alias("yhat")).agg(
        F.count(F.lit(1)).alias("n")
    )
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    cells = groups.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(num_classes**2 - 1))))
    grid = cells.select(
        *by, F.floor(F.col("_c") / num_classes).cast("int").alias("y"), (F.col("_c") % num_classes).cast("int").alias("yhat")
    )
    return grid.join(counts, [*by, "y", "yhat"], "left").select(
        *by, "y", "yhat", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def argmax(probs: Column | str) -> Column:
    """Index of the first largest probability."""
    probs = F.col(probs) if isinstance(probs, str) else probs
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def multilabel_confusion(
    df: DataFrame, truth: str, probs: str, threshold: float = 0.5, keys: list[str] | None = None, ignore: int | None = None
) -> DataFrame:
    """2x2 counts per label from arrays of 0/1 truths and probabilities."""
    by = list(keys or [])
    pairs = F.posexplode(F.zip_with(truth, probs, lambda t, p: F.struct(t.cast("int").alias("t"), (p > threshold).alias("p"))))
    rows = df.select(*by, pairs.alias("label", "_x"))
    if ignore is not None:
        rows = rows.filter(F.col("_x.t") != ignore)
    t, p = F.col("_x.t") == 1, F.col("_x.p")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy(*by, "label").agg(
        count(~t & ~p).alias("tn"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"), count(t & p).alias("tp")
    )


def class_metrics(matrix: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per class accuracy, precision, recall, f1, and the global accuracy, from a confusion matrix."""
    grouped, by = _grouped(matrix, keys)
    n, hit = F.col("n"), F.col("y") == F.col("yhat")
    sides = F.explode(
        F.array(
            F.struct(F.col("y").alias("c"), n.alias("actual"), F.lit(0).cast("long").alias("called"), F.when(hit, n).otherwise(0).alias("tp")),
            F.struct(F.col("yhat").alias("c"), F.lit(0).cast("long").alias("actual"), n.alias("called"), F.lit(0).cast("long").alias("tp")),
        )
    )
    per = grouped.select(*by, sides.alias("_s")).groupBy(*by, F.col("_s.c").alias("class")).agg(
        F.sum("_s.actual").alias("_a"), F.sum("_s.called").alias("_c"), F.sum("_s.tp").alias("_tp")
    )
    totals = grouped.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum(F.when(hit, n).otherwise(0)).alias("_hits"))
    both = _beside(per, totals, keys)
    precision, recall = F.try_divide("_tp", "_c"), F.try_divide("_tp", "_a")
    return both.select(
        *(keys or []), "class", F.try_divide("_hits", "_n").alias("acc_global"),
        F.try_divide(F.col("_n") - F.col("_a") - F.col("_c") + F.col("_tp") * 2, F.col("_n")).alias("acc"),
        precision.alias("precision"), recall.alias("recall"),
        F.try_divide(precision * recall * 2, precision + recall).alias("f1"),
    )


def accuracy(df: DataFrame, truth: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """Share of rows whose predicted class is the true one (the trace of the matrix over its total)."""
    hit = F.when(F.col(truth) == F.col(predicted), 1).otherwise(0)
    return df.groupBy(*(keys or [])).agg(F.avg(hit).alias("metric"))


def methylation_metrics(df: DataFrame, truth: str, probs: str, keys: list[str] | None = None) -> DataFrame:
    """Two-class metrics with the AUC of the second class."""
    scored = df.withColumn("_yhat", argmax(probs)).withColumn("_p1", F.col(probs)[1])
    per = class_metrics(confusion_matrix(scored, truth, "_yhat", 2, keys), keys)
    return _beside(per, auc(scored, "_p1", truth, keys), keys)


def mced_metrics(
    df: DataFrame, truth: str, probs: str, width: int, keys: list[str] | None = None, specificity: float = 0.98
) -> DataFrame:
    """Cancer-or-not metrics from class probabilities of any supported width; called above 0.5."""
    cancer = P.collapse_health(probs, width)["cancer"]
    label = F.col(truth) if width == 2 else (F.col(truth) > P.healthy_classes(width) - 1)
    grouped, by = _grouped(df.withColumn("_p", cancer).withColumn("_y", label.cast("int")), keys)
    called = F.col("_p") > 0.5
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    basic = grouped.groupBy(*by).agg(
        F.avg(F.when(called == (F.col("_y") == 1), 1.0).otherwise(0.0)).alias("acc"),
        F.coalesce(
            F.try_divide(
                count(called & (F.col("_y") == 1)) * 2,
                count(called & (F.col("_y") == 1)) * 2 + count(called & (F.col("_y") == 0)) + count(~called & (F.col("_y") == 1)),
            ),
            F.lit(0.0),
        ).alias("f1"),
    )
    area = auc(grouped, "_p", "_y", keys)
    sens = sensitivity_at_specificity(grouped, "_p", "_y", specificity, keys)
    joined = _beside(_beside(basic, area, keys), sens, keys)
    return joined.select(
        *(keys or []), "acc", "f1", "auc", F.col("sensitivity").alias("sens_98"), F.col("specificity").alias("spec_98")
    )


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weights n / (k * rows of the class). One small row per class joins back."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = classes.agg(F.sum("_nc") / F.count(F.lit(1))).scalar()
    weights = classes.select(label, (total / F.col("_nc")).cast("double").alias(name))
    return df.join(weights, label)


def summary_stats(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.max(value).alias("max"), F.min(value).alias("min")
    )


def mean_of_metrics(df: DataFrame, metric: str = "metric", value: str = "value", steps: str | None = None) -> DataFrame:
    """Mean per metric name; ``steps`` weighs partial sums by their number of steps."""
    mean = F.sum(value) / F.sum(steps) if steps else F.avg(value)
    return df.groupBy(metric).agg(mean.alias("mean"))


def ensemble_mean(members: DataFrame, keys: list[str], probs: str = "probs") -> DataFrame:
    """Element-wise mean of the members' probability vectors per sample."""
    per = members.select(*keys, F.posexplode(probs).alias("i", "_p")).groupBy(*keys, "i").agg(F.avg("_p").alias("_p"))
    packed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "_p"))).alias("_v"))
    return packed.select(*keys, F.transform("_v", lambda s: s["_p"]).alias(probs))


def accuracy_metric(truth: str, predicted: str) -> Column:
    return F.avg(F.when(F.col(truth) == F.col(predicted), 1.0).otherwise(0.0))


def brier_metric(truth: str, score: str) -> Column:
    return F.avg((F.col(score) - F.col(truth)) * (F.col(score) - F.col(truth)))


def evaluate_by(df: DataFrame, keys: list[str], metrics: dict[str, Callable[[], Column] | Column]) -> DataFrame:
    """Named metrics per group in one aggregate; a metric is an aggregate column or a function that builds one."""
    columns = [(m() if callable(m) and not isinstance(m, Column) else m).alias(n) for n, m in metrics.items()]
    return df.groupBy(*keys).agg(*columns)
