"""Feature tables and sample data."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragx.catalog.registry import register
from fragx.fixtures import table
from fragx.functions.common import round6
from fragx.operators import features as X

# Families keyed by sample: read shares per contig, mean mapping quality per contig, and a second
# version of the first one, which wins on equal names.
FAMILIES = {
    "fam_a": "SELECT sample_id, CONCAT('n_', contig) AS feature, CAST(COUNT(*) AS DOUBLE) AS value FROM reads GROUP BY sample_id, contig",
    "fam_b": "SELECT sample_id, CONCAT('mq_', contig) AS feature, AVG(mapq) AS value FROM reads GROUP BY sample_id, contig",
    "fam_c": "SELECT sample_id, CONCAT('n_', contig) AS feature, CAST(COUNT(*) AS DOUBLE) AS value FROM reads WHERE mapq >= 55 GROUP BY sample_id, contig",
    "merged": """SELECT sample_id, feature, arg_max(value, pr) AS value FROM (SELECT sample_id, CONCAT('end_', feature) AS feature, value, 0 AS pr FROM fam_a
      UNION ALL SELECT sample_id, CONCAT('cna_', feature), value, 1 FROM fam_b UNION ALL SELECT sample_id, CONCAT('end_', feature), value, 2 FROM fam_c) f GROUP BY sample_id, feature""",
    "known": "SELECT s.sample_id, CAST(COALESCE(m.age, -1) AS INT) AS age, CAST(COALESCE(m.sex, 1) AS INT) AS sex FROM (SELECT DISTINCT sample_id FROM reads) s LEFT JOIN samples m ON m.sample_id = s.sample_id",
    "long": "SELECT * FROM merged UNION ALL SELECT sample_id, 'age', CAST(age AS DOUBLE) FROM known UNION ALL SELECT sample_id, 'sex', CAST(sex AS DOUBLE) FROM known",
    "wanted": "SELECT unnest(['age', 'sex', 'end_n_chr1', 'cna_mq_chr2', 'end_n_chrX', 'met_none']) AS feature, unnest([0, 1, 2, 3, 4, 5]) AS position",
}
WANTED = ["age", "sex", "end_n_chr1", "cna_mq_chr2", "end_n_chrX", "met_none"]


def families(spark, sf_dir):
    r = table(spark, sf_dir, "reads")
    count = lambda d: d.groupBy("sample_id", F.concat(F.lit("n_"), "contig").alias("feature")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    quality = r.groupBy("sample_id", F.concat(F.lit("mq_"), "contig").alias("feature")).agg(F.avg("mapq").alias("value"))
    return [("end", count(r)), ("cna", quality), ("end", count(r.filter("mapq >= 55")))]


def meta(spark, sf_dir):
    # The customer table numbers samples from 0 or 1; samples without a row get the defaults.
    return table(spark, sf_dir, "samples")


@register("namespace_features", "SELECT sample_id, feature, ROUND(value, 6) + 0.0 AS value FROM merged", FAMILIES)
def namespace_features(spark, sf_dir):
    m = X.namespace_features(families(spark, sf_dir), ["sample_id"])
    return m.select("sample_id", "feature", round6("value").alias("value"))


@register(
    "lookup_meta",
    "SELECT e.event_id, e.sample_id, CAST(COALESCE(m.age, -1) AS INT) AS age, CAST(COALESCE(m.sex, 1) AS INT) AS sex FROM (SELECT event_id, CONCAT('s', user_id * 3) AS sample_id FROM events) e LEFT JOIN samples m ON m.sample_id = e.sample_id",
)
def lookup_meta(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("s"), (F.col("user_id") * 3).cast("string")).alias("sample_id"))
    return X.lookup_meta(e, meta(spark, sf_dir))


@register("feature_table", "SELECT sample_id, feature, ROUND(value, 6) + 0.0 AS value FROM long", FAMILIES)
def feature_table(spark, sf_dir):
    t = X.feature_table(families(spark, sf_dir), meta(spark, sf_dir))
    return t.select("sample_id", "feature", round6("value").alias("value"))


@register(
    "align_features",
    "SELECT s.sample_id, CAST(w.position AS INT) AS position, w.feature, ROUND(COALESCE(l.value, 0), 6) + 0.0 AS value FROM known s CROSS JOIN wanted w LEFT JOIN long l ON l.sample_id = s.sample_id AND l.feature = w.feature",
    FAMILIES,
)
def align_features(spark, sf_dir):
    t = X.feature_table(families(spark, sf_dir), meta(spark, sf_dir))
    a = X.align_features(t, WANTED)
    return a.select("sample_id", "position", "feature", round6("value").alias("value"))


@register(
    "wide_features",
    """SELECT s.sample_id, s.age, s.sex, ROUND(COALESCE(a.value, 0), 6) + 0.0 AS end_n_chr1, ROUND(COALESCE(b.value, 0), 6) + 0.0 AS cna_mq_chr2 FROM known s
      LEFT JOIN merged a ON a.sample_id = s.sample_id AND a.feature = 'end_n_chr1' LEFT JOIN merged b ON b.sample_id = s.sample_id AND b.feature = 'cna_mq_chr2'""",
    FAMILIES,
)
def wide_features(spark, sf_dir):
    w = X.feature_table(families(spark, sf_dir), meta(spark, sf_dir), columns=["age", "sex", "end_n_chr1", "cna_mq_chr2"])
    return w.select("sample_id", "age", "sex", round6("end_n_chr1").alias("end_n_chr1"), round6("cna_mq_chr2").alias("cna_mq_chr2"))


@register(
    "missing_features",
    "SELECT s.sample_id, w.feature FROM known s CROSS JOIN wanted w LEFT JOIN long l ON l.sample_id = s.sample_id AND l.feature = w.feature WHERE l.feature IS NULL",
    FAMILIES,
)
def missing_features(spark, sf_dir):
    return X.missing_features(X.feature_table(families(spark, sf_dir), meta(spark, sf_dir)), WANTED)


@register("union_keys", "SELECT DISTINCT feature FROM long", FAMILIES)
def union_keys(spark, sf_dir):
    return X.feature_table(families(spark, sf_dir), meta(spark, sf_dir)).select("feature").distinct()


@register("union_all", "SELECT CAST(o_custkey AS BIGINT) AS key, 'order' AS source FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def union_all(spark, sf_dir):
    from fragx.sources.records import concat

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit("order").alias("source"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("source"))
    return concat([o, c])


@register("concat_files", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def concat_files(spark, sf_dir):
    from fragx.sources.records import concat

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return concat([d, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")])


@register("read_samples", "SELECT c_custkey, c_nationkey FROM customer")
def read_samples(spark, sf_dir):
    from fragx.sources.records import read_samples as read

    return read(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_nationkey", "not_there"])
