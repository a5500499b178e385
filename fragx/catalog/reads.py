"""Read filters, flags, pairing and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragx.catalog.registry import register
from fragx.fixtures import table
from fragx.functions import reads as R, sequence as S
from fragx.operators import reads as ops
from fragx.operators.ordering import row_numbers
from fragx.session import materialize

QC = "(CAST(flag AS INT) & 3844) = 0 AND mapq >= 30"

NM = """COALESCE(CAST(nm AS BIGINT), CASE WHEN cigar IS NULL OR cigar IN ('', '*') THEN 10000000000 ELSE
 CAST(COALESCE(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[XID]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) END)"""

REASON = f"""CASE WHEN (flag & 12) <> 0 OR (flag & 1) = 0 THEN 'unmapped_or_unpaired'
 WHEN (flag & 3840) <> 0 THEN 'qc_secondary_duplicate_supplementary'
 WHEN mapq < 30 THEN 'low_mapq' WHEN {NM} > 2 THEN 'mismatches'
 WHEN NOT regexp_matches(contig, '^chr[0-9]+$') THEN 'non_autosome'
 WHEN regexp_matches(cigar, '^\\d+[SH]|[SH]$') THEN 'read_clip' END"""


def reads(spark, sf_dir):
    return table(spark, sf_dir, "reads")


@register("qc_reads", f"SELECT rid, sample_id, contig, pos FROM reads WHERE {QC}")
def qc_reads(spark, sf_dir):
    return ops.qc_reads(reads(spark, sf_dir)).select("rid", "sample_id", "contig", "pos")


@register("reject_reason", f"SELECT rid, {REASON} AS reason FROM reads")
def reject_reason(spark, sf_dir):
    return reads(spark, sf_dir).select("rid", R.reject_reason().alias("reason"))


@register("mismatch_count", f"SELECT rid, {NM} AS n FROM reads")
def mismatch_count(spark, sf_dir):
    return reads(spark, sf_dir).select("rid", R.mismatch_count("nm", "cigar").alias("n"))


@register("is_clipped", "SELECT rid, regexp_matches(cigar, '^\\d+[SH]|[SH]$') AS clipped FROM reads")
def is_clipped(spark, sf_dir):
    return reads(spark, sf_dir).select("rid", R.is_clipped("cigar").alias("clipped"))


@register(
    "is_autosome",
    "SELECT DISTINCT n_name, regexp_matches(replace(n_name, 'NATION_', 'chr'), '^chr[0-9]+$') AS autosome FROM nation"
    " UNION SELECT contig, regexp_matches(contig, '^chr[0-9]+$') FROM reads",
)
def is_autosome(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_name", F.replace("n_name", F.lit("NATION_"), F.lit("chr")).alias("c"))
    both = names.unionByName(reads(spark, sf_dir).select(F.col("contig").alias("n_name"), F.col("contig").alias("c")))
    return both.select("n_name", R.is_autosome("c").alias("autosome")).distinct()


@register("flag_mask_filter", "SELECT rid, flag FROM reads WHERE (flag & 2316) = 0")
def flag_mask_filter(spark, sf_dir):
    return reads(spark, sf_dir).filter(R.passes_flag_mask("flag")).select("rid", "flag")


@register("fragment_length_filter", "SELECT rid, tlen FROM reads WHERE ABS(tlen) BETWEEN 20 AND 600")
def fragment_length_filter(spark, sf_dir):
    return reads(spark, sf_dir).filter(R.fragment_length_ok("tlen")).select("rid", "tlen")


@register("contig_filter", "SELECT rid, contig FROM reads WHERE contig IN ('chr1', 'chr7', 'chrX')")
def contig_filter(spark, sf_dir):
    from fragx.operators.intervals import restrict_to_contigs

    return restrict_to_contigs(reads(spark, sf_dir), ["chr1", "chr7", "chrX"]).select("rid", "contig")


@register(
    "parse_cigar",
    """SELECT rid, CAST(i AS INT) AS i, list_extract(regexp_extract_all(cigar, '\\d+([MIDNSHP=X])', 1), i + 1) AS op,
    CAST(list_extract(regexp_extract_all(cigar, '(\\d+)[MIDNSHP=X]', 1), i + 1) AS INT) AS len
    FROM (SELECT rid, cigar, unnest(range(0, len(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')))) AS i FROM reads) c""",
)
def parse_cigar(spark, sf_dir):
    ops_ = reads(spark, sf_dir).select("rid", F.posexplode(R.parse_cigar("cigar")).alias("i", "o"))
    return ops_.select("rid", "i", "o.op", "o.len")


@register("reject_counts", f"SELECT reason, COUNT(*) AS n FROM (SELECT {REASON} AS reason FROM reads) r WHERE reason IS NOT NULL GROUP BY reason")
def reject_counts(spark, sf_dir):
    return ops.reject_counts(reads(spark, sf_dir))


FRAGMENTS = {
    "kept": f"SELECT * FROM (SELECT *, {REASON} AS reason FROM reads) r WHERE reason IS NULL",
    "ordered": """SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY contig, qname ORDER BY pos, rid) - 1) / 2) AS BIGINT) AS pair_id FROM kept""",
    "pairs": """SELECT contig, qname, pair_id, COUNT(*) AS n, MIN(flag) AS lo, MAX(flag) AS hi,
      MAX(CASE WHEN (flag & 16) = 0 THEN pos END) AS p5, MAX(CASE WHEN (flag & 16) <> 0 THEN pos + qlen END) AS p3
      FROM ordered GROUP BY contig, qname, pair_id""",
    "fragments": """SELECT contig, p5 AS pos5, p3 AS pos3, CASE WHEN lo = 99 THEN 'W' ELSE 'C' END AS strand FROM pairs
      WHERE n = 2 AND ((lo = 99 AND hi = 147) OR (lo = 83 AND hi = 163)) AND p5 < p3""",
}


@register("pair_mates", "SELECT contig, pos5, pos3, strand FROM fragments", FRAGMENTS)
def pair_mates(spark, sf_dir):
    return ops.pair_mates(ops.usable_reads(reads(spark, sf_dir)), ["contig"])


@register(
    "strand_of_pair",
    """SELECT a.qname, CASE WHEN LEAST(a.flag, b.flag) = 99 AND GREATEST(a.flag, b.flag) = 147 THEN 'W'
     WHEN LEAST(a.flag, b.flag) = 83 AND GREATEST(a.flag, b.flag) = 163 THEN 'C' END AS strand
    FROM reads a JOIN reads b ON a.qname = b.qname AND a.rid + 1 = b.rid""",
)
def strand_of_pair(spark, sf_dir):
    mates = reads(spark, sf_dir).groupBy("qname").agg(
        F.count(F.lit(1)).alias("n"), F.min("flag").alias("a"), F.max("flag").alias("b")
    )
    return mates.filter("n = 2").select("qname", R.strand_of_pair("a", "b").alias("strand"))


@register(
    "strand_of_pair_whole",
    """SELECT qname, pair_id, CASE WHEN n = 2 AND lo = 99 AND hi = 147 THEN 'W' WHEN n = 2 AND lo = 83 AND hi = 163 THEN 'C' END AS strand FROM
     (SELECT qname, CAST(FLOOR((rk - 1) / 2) AS BIGINT) AS pair_id, COUNT(*) AS n, MIN(flag) AS lo, MAX(flag) AS hi
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qname ORDER BY pos, rid) AS rk FROM reads) r GROUP BY qname, CAST(FLOOR((rk - 1) / 2) AS BIGINT)) p""",
)
def strand_of_pair_whole(spark, sf_dir):
    """Every read: names of any number of reads, two by two; a read without a mate has no strand."""
    ranked = row_numbers(reads(spark, sf_dir).select("qname", "pos", "rid", "flag"), [F.col("pos"), F.col("rid")], ["qname"], "rk")
    pairs = ranked.groupBy("qname", F.floor((F.col("rk") - 1) / 2).alias("pair_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("flag").alias("a"), F.max("flag").alias("b")
    )
    return pairs.select("qname", "pair_id", F.when(F.col("n") == 2, R.strand_of_pair("a", "b")).alias("strand"))


@register(
    "mark_duplicate_templates",
    """SELECT rid, sample_id, CASE WHEN (flag & 2308) <> 0 THEN FALSE WHEN pair_name IS NOT NULL THEN pair_rank > 1 ELSE has_pair OR lone_rank > 1 END AS is_duplicate FROM marked""",
    {
        "ended": """SELECT rid, sample_id, qname, contig, flag, (flag & 16) <> 0 AS reverse, CAST(COALESCE(list_sum(list_filter(qual, lambda q: q >= 15)), 0) AS BIGINT) AS score,
          CASE WHEN (flag & 16) <> 0 THEN pos + CASE cigar WHEN '5S95M' THEN 95 WHEN '60M2D40M' THEN 102 WHEN '50M3I47M' THEN 97 WHEN '95M5S' THEN 100
          WHEN '30M10N70M' THEN 110 ELSE 100 END - 1 ELSE pos - CASE cigar WHEN '5S95M' THEN 5 ELSE 0 END END AS five FROM aligned""",
        "named": """SELECT sample_id, qname, COUNT(*) AS n, MIN((contig, five, reverse)) AS low, MAX((contig, five, reverse)) AS high, MIN(rid) AS rid, SUM(score) AS score
          FROM ended WHERE (flag & 2308) = 0 GROUP BY sample_id, qname""",
        "paired": """SELECT sample_id, qname AS pair_name, low, high, ROW_NUMBER() OVER (PARTITION BY sample_id, low, high ORDER BY score DESC, rid) AS pair_rank FROM named WHERE n = 2""",
        "pair_ends": "SELECT DISTINCT sample_id, e FROM (SELECT sample_id, low AS e FROM paired UNION ALL SELECT sample_id, high FROM paired) x",
        "marked": """SELECT d.rid, d.sample_id, d.flag, p.pair_name, p.pair_rank, e.e IS NOT NULL AS has_pair,
          ROW_NUMBER() OVER (PARTITION BY d.sample_id, d.contig, d.five, d.reverse, p.pair_name IS NULL AND (d.flag & 2308) = 0 ORDER BY d.score DESC, d.rid) AS lone_rank
          FROM ended d LEFT JOIN paired p ON p.sample_id = d.sample_id AND p.pair_name = d.qname AND (d.flag & 2308) = 0
          LEFT JOIN pair_ends e ON e.sample_id = d.sample_id AND e.e = (d.contig, d.five, d.reverse)""",
    },
)
def mark_duplicate_templates(spark, sf_dir):
    return ops.mark_duplicate_templates(table(spark, sf_dir, "aligned"), ["sample_id"]).select("rid", "sample_id", "is_duplicate")


@register(
    "mark_duplicates",
    """SELECT rid, ROW_NUMBER() OVER (PARTITION BY sample_id, contig, CAST(FLOOR(five_prime / 2000.0) AS BIGINT), reverse ORDER BY quality_sum DESC, rid) > 1 AS is_duplicate,
     five_prime, quality_sum FROM
    (SELECT rid, sample_id, contig, (flag & 16) <> 0 AS reverse, CAST(list_sum(list_filter(qual, lambda q: q >= 15)) AS BIGINT) AS quality_sum,
     CASE WHEN (flag & 16) <> 0 THEN pos + CASE cigar WHEN '5S95M' THEN 95 WHEN '60M2D40M' THEN 102 WHEN '50M3I47M' THEN 97 WHEN '95M5S' THEN 100
       WHEN '30M10N70M' THEN 110 ELSE 100 END - 1 ELSE pos - CASE cigar WHEN '5S95M' THEN 5 ELSE 0 END END AS five_prime FROM aligned) r""",
)
def mark_duplicates(spark, sf_dir):
    # ends are taken together over 2 000 bases, so that the test reads have copies
    keyed = ops.duplicate_keys(table(spark, sf_dir, "aligned")).withColumn("place", F.floor(F.col("five_prime") / 2000))
    group = ["sample_id", "contig", "place", "reverse"]
    # winners and reads both come from it, so the reads are placed once
    marked = ops.mark_duplicates(materialize(keyed.select("rid", *group, "five_prime", "quality_sum")), group, "quality_sum")
    return marked.select("rid", "is_duplicate", "five_prime", "quality_sum")


@register(
    "fix_mate_info",
    """SELECT r.rid, m.contig AS mate_contig, m.pos AS mate_pos, (m.flag & 16) <> 0 AS mate_reverse,
     CASE WHEN m.rid IS NULL THEN NULL WHEN (r.pos, r.rid) < (m.pos, m.rid) THEN 1 ELSE -1 END * (GREATEST(r.pos, m.pos) + 100 - LEAST(r.pos, m.pos)) AS template_len
    FROM reads r LEFT JOIN reads m ON r.qname = m.qname AND r.rid <> m.rid""",
)
def fix_mate_info(spark, sf_dir):
    r = reads(spark, sf_dir).withColumn("end", F.col("pos") + F.col("qlen"))
    return ops.fix_mate_info(r, ["qname"]).select("rid", "mate_contig", "mate_pos", "mate_reverse", "template_len")


@register(
    "rev_comp",
    "SELECT contig, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM genome",
)
def rev_comp(spark, sf_dir):
    return table(spark, sf_dir, "genome").select("contig", S.rev_comp("seq").alias("rc"))


@register(
    "sanitize_bases",
    """SELECT doc_id, regexp_replace(regexp_replace(translate(text, 'RYSWKMBDHVryswkmbdhv', 'ACGAGACAAAacgagacaaa'),
      '[^ACGTUNacgtun.*#a-z-]', 'N', 'g'), '[bd-fh-mo-sv-z]', 'n', 'g') AS bases FROM documents""",
)
def sanitize_bases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.sanitize_bases("text").alias("bases"))


@register(
    "region_labels",
    "SELECT rid, CONCAT(contig, ':', CAST(pos + 1 AS VARCHAR), '-', CAST(pos + qlen AS VARCHAR)) AS region, "
    "contig AS back_contig, pos AS back_start, pos + qlen AS back_end, "
    "CONCAT(contig, ':', CAST((pos // 1000000) * 1000000 AS VARCHAR), '-', CAST((pos // 1000000) * 1000000 + 1000000 AS VARCHAR)) AS bin FROM reads",
)
def region_labels(spark, sf_dir):
    r = reads(spark, sf_dir).select(
        "rid", S.region_to_string("contig", "pos", F.col("pos") + F.col("qlen")).alias("region"),
        S.bin_label("contig", "pos", 1_000_000).alias("bin"),
    )
    back = S.string_to_region("region")
    return r.select(
        "rid", "region", back["contig"].alias("back_contig"), back["start"].alias("back_start"),
        back["end"].alias("back_end"), "bin",
    )
