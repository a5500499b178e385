"""Interval joins and region operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragx import constants as K
from fragx.catalog.registry import register
from fragx.fixtures import table
from fragx.operators import intervals as I, ordering as O


def _reads(spark, sf_dir):
    return table(spark, sf_dir, "reads").select("rid", "contig", "pos", (F.col("pos") + F.col("qlen")).alias("rend"))


def _sites(spark, sf_dir):
    return table(spark, sf_dir, "sites").select("site_id", "contig", "st", "en")


@register(
    "point_in_interval_join",
    "SELECT r.rid, s.site_id FROM reads r JOIN sites s ON r.contig = s.contig AND r.pos >= s.st AND r.pos < s.en",
)
def point_in_interval_join(spark, sf_dir):
    return I.point_in_interval_join(_reads(spark, sf_dir), _sites(spark, sf_dir), ["contig"]).select("rid", "site_id")


@register(
    "interval_overlap_join",
    """SELECT r.rid, s.site_id, GREATEST(r.pos, s.st) AS clip_start, LEAST(r.pos + r.qlen, s.en) AS clip_end
    FROM reads r JOIN sites s ON r.contig = s.contig AND r.pos < s.en AND s.st < r.pos + r.qlen""",
)
def interval_overlap_join(spark, sf_dir):
    pairs = I.interval_overlap_join(
        _reads(spark, sf_dir), _sites(spark, sf_dir), ["contig"], ("pos", "rend"), ("st", "en"), clip=True
    )
    return pairs.select("rid", "site_id", "clip_start", "clip_end")


@register(
    "in_regions_point",
    "SELECT rid FROM reads r WHERE EXISTS (SELECT 1 FROM sites s WHERE r.contig = s.contig AND r.pos >= s.st AND r.pos < s.en)",
)
def in_regions_point(spark, sf_dir):
    return I.in_regions(_reads(spark, sf_dir), _sites(spark, sf_dir), ["contig"], pos="pos").select("rid")


@register(
    "in_regions_point_negated",
    "SELECT rid FROM reads r WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE r.contig = s.contig AND r.pos >= s.st AND r.pos < s.en)",
)
def in_regions_point_negated(spark, sf_dir):
    return I.in_regions(_reads(spark, sf_dir), _sites(spark, sf_dir), ["contig"], pos="pos", negate=True).select("rid")


@register(
    "in_regions_interval",
    "SELECT rid FROM reads r WHERE EXISTS (SELECT 1 FROM sites s WHERE r.contig = s.contig AND r.pos < s.en AND s.st < r.pos + r.qlen)",
)
def in_regions_interval(spark, sf_dir):
    return I.in_regions(_reads(spark, sf_dir), _sites(spark, sf_dir), ["contig"], span=("pos", "rend")).select("rid")


@register(
    "in_regions_interval_negated",
    "SELECT rid FROM reads r WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE r.contig = s.contig AND r.pos < s.en AND s.st < r.pos + r.qlen)",
)
def in_regions_interval_negated(spark, sf_dir):
    return I.in_regions(
        _reads(spark, sf_dir), _sites(spark, sf_dir), ["contig"], span=("pos", "rend"), negate=True
    ).select("rid")


@register(
    "restrict_to_regions",
    """SELECT contig, pos, ref, alt FROM variants v WHERE EXISTS (
      SELECT 1 FROM loci l WHERE l.contig = v.contig AND v.pos >= l.locus - 50 AND v.pos < l.locus + 50)""",
)
def restrict_to_regions(spark, sf_dir):
    regions = table(spark, sf_dir, "loci").select(
        "contig", (F.col("locus") - 50).alias("st"), (F.col("locus") + 50).alias("en")
    )
    return I.in_regions(table(spark, sf_dir, "variants"), regions, ["contig"], pos="pos").select(
        "contig", "pos", "ref", "alt"
    )


MERGE = {
    "padded": "SELECT contig, st - 33 AS s, en + 33 AS e FROM sites",
    "reach": """SELECT *, MAX(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM padded""",
    "islands": """SELECT *, SUM(CASE WHEN before IS NULL OR before < s THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM reach""",
}


@register("merge_intervals", "SELECT contig, MIN(s) AS st, MAX(e) AS en FROM islands GROUP BY contig, island", MERGE)
def merge_intervals(spark, sf_dir):
    return I.merge_intervals(_sites(spark, sf_dir), ["contig"], padding=33)


@register(
    "fetch_region",
    "SELECT site_id, st, en FROM sites WHERE contig = 'chr3' AND st < 9000000 AND en > 1000000",
)
def fetch_region(spark, sf_dir):
    return I.fetch_region(_sites(spark, sf_dir), "chr3", 1_000_000, 9_000_000).select("site_id", "st", "en")


@register(
    "split_regions_by_size",
    'SELECT contig, s AS start, LEAST(s + 1500000, len) AS "end" FROM (SELECT contig, len, unnest(range(0, len, 1500000)) AS s FROM contigs) t',
)
def split_regions_by_size(spark, sf_dir):
    return I.tile_contigs(table(spark, sf_dir, "contigs"), bin_size=1_500_000)


TILES = {
    "sized": "SELECT contig, len, (SELECT CAST(CEIL(SUM(len) / 97.0) AS BIGINT) FROM contigs) AS size FROM contigs",
    "tiles": 'SELECT contig, s AS start, LEAST(s + size, len) AS "end" FROM (SELECT contig, len, size, unnest(range(0, len, size)) AS s FROM sized) t',
}


@register("split_regions_by_count", 'SELECT contig, start, "end" FROM tiles', TILES)
def split_regions_by_count(spark, sf_dir):
    return I.tile_contigs(table(spark, sf_dir, "contigs"), num_bins=97)


@register(
    "local_regions",
    """SELECT contig, start, "end", CAST((ROW_NUMBER() OVER (ORDER BY CAST(substring(contig, 4) AS INT), start) - 1) //
      CAST(CEIL((SELECT COUNT(*) FROM tiles) / 16.0) AS BIGINT) AS BIGINT) AS worker FROM tiles""",
    TILES,
)
def local_regions(spark, sf_dir):
    from fragx.operators.shaping import contiguous_chunks

    tiles = I.tile_contigs(table(spark, sf_dir, "contigs"), num_bins=97)
    return contiguous_chunks(tiles, [O.contig_rank("contig"), F.col("start")], 16, "worker")


ORDERED = "CAST(CASE WHEN regexp_matches(contig, '^chr([1-9]|1[0-9]|2[0-2])$') THEN CAST(substring(contig, 4) AS INT) ELSE 25 END AS INT)"


@register(
    "genome_order",
    f"SELECT contig, pos, ref, alt, {ORDERED} AS contig_rank FROM variants ORDER BY {ORDERED}, contig, pos",
)
def genome_order(spark, sf_dir):
    v = table(spark, sf_dir, "variants").select("contig", "pos", "ref", "alt", O.contig_rank("contig").alias("contig_rank"))
    return O.genome_order(v)


@register(
    "normalize_contig",
    """SELECT c_custkey, CASE WHEN contig LIKE 'chr%' THEN contig ELSE CONCAT('chr', contig) END AS contig
    FROM (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN CONCAT('chr', CAST(1 + c_custkey % 22 AS VARCHAR))
      ELSE CAST(1 + c_custkey % 22 AS VARCHAR) END AS contig FROM customer) c""",
)
def normalize_contig(spark, sf_dir):
    from fragx.functions.region import normalize_contig as fix

    raw = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("chr"), (1 + F.col("c_custkey") % 22).cast("string")))
        .otherwise((1 + F.col("c_custkey") % 22).cast("string")).alias("contig"),
    )
    return raw.select("c_custkey", fix("contig").alias("contig"))


CHAIN = {
    "chain": """SELECT contig AS src_contig, st AS src_start, en AS src_end, CONCAT(contig, '_new') AS tgt_contig, st + 1000 + site_id AS tgt_start,
      CASE WHEN site_id % 2 = 0 THEN '+' ELSE '-' END AS strand, site_id FROM sites""",
    "lifted": """SELECT r.rid, c.tgt_contig, CASE WHEN strand = '+' THEN tgt_start + (r.pos - src_start) ELSE tgt_start + (src_end - 1 - r.pos) END AS tgt_pos,
      c.strand, ROW_NUMBER() OVER (PARTITION BY r.rid ORDER BY c.site_id) AS rk
      FROM reads r JOIN chain c ON r.contig = c.src_contig AND r.pos >= c.src_start AND r.pos < c.src_end""",
}


def _chain(spark, sf_dir):
    return _sites(spark, sf_dir).select(
        F.col("contig").alias("src_contig"), F.col("st").alias("src_start"), F.col("en").alias("src_end"),
        F.concat("contig", F.lit("_new")).alias("tgt_contig"), (F.col("st") + 1000 + F.col("site_id")).alias("tgt_start"),
        F.when(F.col("site_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("site_id").alias("block"),
    )


@register(
    "liftover_points",
    "SELECT r.rid, l.tgt_contig, l.tgt_pos, l.strand FROM reads r LEFT JOIN lifted l ON r.rid = l.rid AND l.rk = 1",
    CHAIN,
)
def liftover_points(spark, sf_dir):
    from fragx.operators.liftover import lift_points

    r = _reads(spark, sf_dir).select("rid", "contig", "pos")
    return lift_points(r, _chain(spark, sf_dir), "rid").select("rid", "tgt_contig", "tgt_pos", "strand")


RANGES = {
    "chain": CHAIN["chain"],
    "bases": "SELECT cpg_id, contig, unnest(range(st, en)) AS p, en - st AS n FROM cpg",
    "mapped": """SELECT cpg_id, p, n, MIN(c.site_id) AS block FROM bases b JOIN chain c ON b.contig = c.src_contig
       AND b.p >= c.src_start AND b.p < c.src_end GROUP BY cpg_id, p, n""",
}


@register(
    "liftover_ranges",
    """SELECT k.cpg_id, COALESCE(COUNT(m.p) = 12, FALSE) AS lifted, CAST(CASE WHEN COUNT(m.p) = 12 THEN MIN(CASE WHEN strand = '+'
      THEN tgt_start + (p - src_start) ELSE tgt_start + (src_end - 1 - p) END) END AS BIGINT) AS tgt_min, CAST(CASE WHEN COUNT(m.p) = 12 THEN MAX(CASE WHEN strand = '+'
      THEN tgt_start + (p - src_start) ELSE tgt_start + (src_end - 1 - p) END) END AS BIGINT) AS tgt_max FROM cpg k
      LEFT JOIN mapped m ON k.cpg_id = m.cpg_id LEFT JOIN chain c ON c.site_id = m.block GROUP BY k.cpg_id""",
    RANGES,
)
def liftover_ranges(spark, sf_dir):
    from fragx.operators.liftover import lift_ranges

    c = table(spark, sf_dir, "cpg").select("cpg_id", "contig", "st", "en")
    return lift_ranges(c, _chain(spark, sf_dir), "cpg_id").select("cpg_id", "lifted", "tgt_min", "tgt_max")


@register(
    "ploidy",
    """SELECT c_custkey, contig, pos, NOT (contig IN ('chrX', 'chrY') AND NOT (
      (pos >= 1000 AND pos < 44821) OR (pos >= 94821 AND pos < 133871) OR (pos >= 222346 AND pos < 226276)
      OR (pos >= 226351 AND pos < 1949345) OR (pos >= 2132994 AND pos < 2137388) OR (pos >= 2137488 AND pos < 2781479)
      OR (contig = 'chrX' AND pos >= 155701383 AND pos < 156030895) OR (contig = 'chrY' AND pos >= 56887902 AND pos < 57217415))) AS diploid
    FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'chrX' WHEN 1 THEN 'chrY' ELSE 'chr5' END AS contig,
      (c_custkey * 7919) % 3000000 + CASE WHEN c_nationkey % 5 = 0 THEN 54500000 WHEN c_nationkey % 5 = 1 THEN 153900000 ELSE 0 END AS pos FROM customer) c""",
)
def ploidy(spark, sf_dir):
    from fragx.functions.region import is_diploid

    c = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, "chrX").when(F.col("c_custkey") % 3 == 1, "chrY").otherwise("chr5").alias("contig"),
        (F.col("c_custkey") * 7919 % 3000000
         + F.when(F.col("c_nationkey") % 5 == 0, 54500000).when(F.col("c_nationkey") % 5 == 1, 153900000).otherwise(0)).alias("pos"),
    )
    return c.withColumn("diploid", is_diploid("contig", "pos", haploid=["chrX", "chrY"]))
