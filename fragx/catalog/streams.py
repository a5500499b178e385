"""Streaming forms and models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fragx.catalog.features import WANTED, families, meta
from fragx.catalog.registry import register
from fragx.catalog.scoring import OBSERVED, observed
from fragx.fixtures import table
from fragx.functions import probability as P
from fragx.functions.common import round6
from fragx.operators import calling as C, features as X, modeling as L
from fragx.plans.scoring import reports, score_samples as score_plan
from fragx.streaming import incremental as S
from fragx.streaming.state import read_versioned


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    return S.read_stream(spark, f"{sf_dir}/{name}*.parquet", spark.read.parquet(path).schema)


@register(
    "stream_bin_counts",
    """SELECT contig, (pos // 100000) * 100000 AS start, COUNT(*) AS reads FROM (SELECT CONCAT('chr', 1 + user_id % 22) AS contig, (event_id * 104729) % 20000000 AS pos FROM events) e
      GROUP BY contig, (pos // 100000) * 100000""",
)
def stream_bin_counts(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("chr"), (1 + F.col("user_id") % 22).cast("string")).alias("contig"),
        (F.col("event_id") * 104729 % 20000000).alias("pos"),
    )
    out = S.work_folder(spark, "bins")
    S.stream_bin_counts(e, ["contig"], 100_000, f"{out}/rows", f"{out}/state")
    return S.latest_counts(spark, f"{out}/rows", ["contig", "start"])


@register(
    "stream_versioned_counts",
    """SELECT contig, (pos // 50000) * 50000 AS start, COUNT(*) AS reads FROM (SELECT CONCAT('chr', 1 + user_id % 22) AS contig, (event_id * 104729) % 20000000 AS pos FROM events) e
      GROUP BY contig, (pos // 50000) * 50000""",
)
def stream_versioned_counts(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select(
        F.concat(F.lit("chr"), (1 + F.col("user_id") % 22).cast("string")).alias("contig"),
        (F.col("event_id") * 104729 % 20000000).alias("pos"),
    )
    out = S.work_folder(spark, "versioned")
    S.stream_versioned_counts(e, ["contig"], 50_000, f"{out}/rows", f"{out}/state")
    return read_versioned(spark, f"{out}/rows", ["contig", "start"])


@register(
    "stream_confusion",
    "SELECT CAST(quality AS INT) AS y, CAST(toxic AS INT) AS yhat, COUNT(*) AS n FROM labels GROUP BY quality, toxic",
)
def stream_confusion(spark, sf_dir):
    out = S.work_folder(spark, "confusion")
    S.stream_confusion(_stream(spark, sf_dir, "labels"), "quality", "toxic", f"{out}/rows", f"{out}/state")
    return S.last_batch(spark, f"{out}/rows")


@register(
    "stream_call_sink",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS best, ROUND(CAST(list_max(embedding) AS DOUBLE), 6) + 0.0 AS top FROM embeddings""",
)
def stream_call_sink(spark, sf_dir):
    def call(df):
        best = F.array_position("embedding", F.array_max("embedding")) - 1
        return df.select("vec_id", best.cast("int").alias("best"), round6(F.array_max("embedding").cast("double")).alias("top"))

    out = S.work_folder(spark, "calls")
    S.stream_call_sink(_stream(spark, sf_dir, "embeddings"), call, f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").drop("batch")


def _linear(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a trained model, for the plan around it only: a fixed linear map with softmax."""
    x = np.log1p(np.abs(np.stack(batch["features"].to_numpy())))
    logits = x @ np.sin(np.arange(1, x.shape[1] * 11 + 1)).reshape(x.shape[1], 11)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return pd.DataFrame({"sample_id": batch["sample_id"], "probs": list(e / e.sum(axis=1, keepdims=True))})


@register("score_samples")
def score_samples(spark, sf_dir):
    t = X.feature_table(families(spark, sf_dir), meta(spark, sf_dir))
    _, origin = reports(score_plan(t, WANTED, _linear))
    return origin.select("sample_id", *[round6(c).alias(c) for c in origin.columns if c != "sample_id"])


def _mean_logits(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a trained model: two means of the vector."""
    x = np.stack(batch["embedding"].to_numpy()).astype(float)
    logits = np.stack([x[:, ::2].mean(axis=1), x[:, 1::2].mean(axis=1)], axis=1)
    return pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "logits": list(logits)})


HALVES = """SELECT vec_id, label, AVG(CASE WHEN i % 2 = 0 THEN x END) AS a, AVG(CASE WHEN i % 2 = 1 THEN x END) AS b FROM
 (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e GROUP BY vec_id, label"""


@register("map_batches", f"SELECT vec_id, ROUND(a, 6) + 0.0 AS a, ROUND(b, 6) + 0.0 AS b FROM ({HALVES}) h")
def map_batches(spark, sf_dir):
    m = L.map_batches(table(spark, sf_dir, "embeddings"), _mean_logits, "vec_id bigint, label int, logits array<double>")
    return m.select("vec_id", round6(F.col("logits")[0]).alias("a"), round6(F.col("logits")[1]).alias("b"))


@register(
    "methylation_calls",
    f"SELECT CAST(label AS VARCHAR) AS chr, vec_id AS position, ROUND(exp(b) / (exp(a) + exp(b)), 6) + 0.0 AS probability, CAST(3 + vec_id % 40 AS BIGINT) AS depth FROM ({HALVES}) h",
)
def methylation_calls(spark, sf_dir):
    from fragx.operators.methylation import methylation_calls as calls

    m = L.map_batches(table(spark, sf_dir, "embeddings"), _mean_logits, "vec_id bigint, label int, logits array<double>")
    scored = m.select(
        F.col("label").cast("string").alias("chr"), F.col("vec_id").alias("position"), P.softmax("logits").alias("probs"),
        (3 + F.col("vec_id") % 40).alias("depth"),
    )
    return calls(scored).withColumn("probability", round6("probability"))


def _spread(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["embedding"].to_numpy()).astype(float)
    return pd.DataFrame({"vec_id": pdf["vec_id"], "spread": x.max(axis=1) - x.min(axis=1)})


@register(
    "group_apply",
    "SELECT vec_id, ROUND(CAST(list_max(embedding) AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE), 6) + 0.0 AS spread FROM embeddings",
)
def group_apply(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("_g", F.floor(F.col("vec_id") / 256))
    g = L.group_apply(e, ["_g"], _spread, "vec_id bigint, spread double")
    return g.select("vec_id", round6("spread").alias("spread"))


@register("fit_classifier")
def fit_classifier(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))
    model = L.fit_classifier(e, numTrees=8, maxDepth=4, seed=7)
    scored = L.predict_classes(model, e)
    return scored.select("vec_id", "label", F.posexplode("probs").alias("idx", "p")).withColumn("p", round6("p"))


@register("grid_search")
def grid_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))
    search = L.grid_search(e, {"numTrees": [4, 8], "maxDepth": [3]})
    scored = L.predict_classes(search.bestModel, e)
    return scored.select("vec_id", "label", F.posexplode("probs").alias("idx", "p")).withColumn("p", round6("p"))


FOLDS = {
    "buyers": "SELECT o_custkey, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS label, COUNT(*) AS n FROM orders GROUP BY ALL",
    "mains": "SELECT o_custkey, label, SUM(n) OVER (PARTITION BY o_custkey) AS n, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY n DESC, label) AS place FROM buyers",
    "dealt": """SELECT o_custkey, ROW_NUMBER() OVER (PARTITION BY label ORDER BY n DESC, md5(CONCAT(o_custkey, ':42')), o_custkey) - 1 AS rn FROM mains WHERE place = 1""",
}


@register(
    "grouped_folds",
    "SELECT o_orderkey, o_custkey, CAST(CASE WHEN (rn // 5) % 2 = 0 THEN rn % 5 ELSE 4 - rn % 5 END AS INT) AS fold FROM orders JOIN dealt USING (o_custkey)",
    FOLDS,
)
def grouped_folds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("label", F.when(F.col("o_totalprice") > 150000, 1).otherwise(0))
    return L.grouped_folds(o.select("o_orderkey", "o_custkey", "label"), "o_custkey", "label", 5).select("o_orderkey", "o_custkey", "fold")


@register("cross_validate")
def cross_validate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 101).alias("subject"), "label", F.col("embedding").alias("features"))
    held = L.cross_validate(e, "subject", folds=3, numTrees=4, maxDepth=3, seed=7)
    return held.select("vec_id", "label", "fold", F.posexplode("probs").alias("idx", "p")).withColumn("p", round6("p"))


HAPLOID = {**OBSERVED, "chosen": OBSERVED["chosen"].replace("WHERE alleles IS NOT NULL", "WHERE alleles IS NOT NULL AND gt NOT IN ('0/1', '1/2')")}


@register(
    "call_variants_haploid",
    """SELECT c.vec_id, array_to_string(alleles, ',') AS alleles, ROUND(p * 100, 2) AS qual, CASE WHEN gt = '0/0' THEN 'RefCall' WHEN ROUND(p * 100, 2) > 55.0 THEN 'PASS' ELSE 'LowQual' END AS filt,
      gt AS "GT", CAST(trunc(LEAST(GREATEST(list_sort(l.n)[2], 0), 99)) AS INT) AS "GQ", dp AS "DP" FROM chosen c JOIN pl l ON l.vec_id = c.vec_id JOIN depths d ON d.vec_id = c.vec_id""",
    HAPLOID,
)
def call_variants_haploid(spark, sf_dir):
    # Outside the regions that X and Y share, whatever the id: inside them a call is diploid.
    sites = observed(spark, sf_dir).withColumn("contig", F.lit("chrX")).withColumn("pos", 10_000_000 + F.col("vec_id") % 100_000_000)
    c = C.call_variants(sites, haploid=["chrX", "chrY"], keys=["vec_id"])
    return c.select("vec_id", F.array_join("alleles", ",").alias("alleles"), "qual", "filt", "GT", "GQ", "DP")
