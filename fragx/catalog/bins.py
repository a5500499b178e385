"""Bin counts and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragx.catalog.reads import QC
from fragx.catalog.registry import register
from fragx.fixtures import table
from fragx.functions.common import round6
from fragx.operators import bins as B, cna as C
from fragx.operators.ordering import genome_order
from fragx.operators.reads import qc_reads

COUNTS = {
    "counted": f"""SELECT sample_id, contig, (pos // 1000000) * 1000000 AS start, COUNT(*) AS reads FROM reads WHERE {QC}
      GROUP BY sample_id, contig, (pos // 1000000) * 1000000""",
    "dense": """SELECT g.sample_id, g.contig, g.start, g.start + 1000000 AS "end", CAST(COALESCE(c.reads, 0) AS BIGINT) AS reads FROM
      (SELECT sample_id, contig, unnest(range(0, MAX(start) + 1, 1000000)) AS start FROM counted GROUP BY sample_id, contig) g
      LEFT JOIN counted c ON g.sample_id = c.sample_id AND g.contig = c.contig AND g.start = c.start""",
}


def dense(spark, sf_dir):
    counts = B.bin_counts(qc_reads(table(spark, sf_dir, "reads")), ["sample_id", "contig"], 1_000_000)
    return B.dense_bins(counts, ["sample_id", "contig"], 1_000_000)


@register("bin_counts", "SELECT sample_id, contig, start, reads FROM counted", COUNTS)
def bin_counts(spark, sf_dir):
    return B.bin_counts(qc_reads(table(spark, sf_dir, "reads")), ["sample_id", "contig"], 1_000_000)


@register("dense_bins", 'SELECT sample_id, contig, start, "end", reads FROM dense', COUNTS)
def dense_bins(spark, sf_dir):
    return dense(spark, sf_dir)


@register(
    "dense_bins_whole_contig",
    """SELECT g.contig, g.start, g.start + 1000000 AS "end", CAST(COALESCE(c.reads, 0) AS BIGINT) AS reads FROM
      (SELECT contig, unnest(range(0, len, 1000000)) AS start FROM contigs) g LEFT JOIN
      (SELECT contig, start, SUM(reads) AS reads FROM counted GROUP BY contig, start) c ON g.contig = c.contig AND g.start = c.start""",
    COUNTS,
)
def dense_bins_whole_contig(spark, sf_dir):
    counts = B.bin_counts(qc_reads(table(spark, sf_dir, "reads")), ["contig"], 1_000_000)
    return B.dense_bins(counts, ["contig"], 1_000_000, table(spark, sf_dir, "contigs"))


@register(
    "dense_bin_share",
    """SELECT sample_id, contig, start, reads, ROUND(COALESCE(reads / NULLIF(SUM(reads) OVER (PARTITION BY sample_id), 0), 0) * 100 + 1e-10, 6) + 0.0 AS share
    FROM dense""",
    COUNTS,
)
def dense_bin_share(spark, sf_dir):
    shares = C.percent_of_total(dense(spark, sf_dir), ["sample_id"], "reads")
    out = shares.select("sample_id", "contig", "start", "reads", round6("share").alias("share"))
    return genome_order(out, "contig", "start")


@register(
    "variable_bins",
    """SELECT s.contig, s.start, COUNT(r.rid) AS n FROM (SELECT DISTINCT contig, st AS start FROM sites) s
    LEFT JOIN reads r ON r.contig = s.contig AND r.pos >= s.start AND r.pos < s.start + 5000 GROUP BY s.contig, s.start""",
)
def variable_bins(spark, sf_dir):
    return B.variable_bins(
        table(spark, sf_dir, "reads"), table(spark, sf_dir, "sites").withColumnRenamed("st", "start"), 5000, ["contig"]
    )
