"""Variant filters, spectra and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragx.catalog.registry import register
from fragx.fixtures import table
from fragx.functions import genotype as G
from fragx.functions.common import round6
from fragx.operators import genome as N, variants as V
from fragx.operators.ordering import top_ratio as top_ratio_rows
from fragx.operators.ordering import genome_order
from fragx.plans.mutation import mutation as mutation_plan

COMP = "translate({0}, 'ACGT', 'TGCA')"

CALLED = {
    "called": """SELECT contig, pos, filt, gt_a, gt_b, qual, kind, CASE WHEN kind = 'SNP' THEN substring(ref, 1, 1) ELSE ref END AS ref,
      CASE WHEN kind = 'SNP' THEN substring(alt, 1, 1) ELSE alt END AS alt FROM (SELECT *, CASE WHEN LENGTH(ref) < LENGTH(alt) THEN 'INS'
      WHEN LENGTH(ref) > LENGTH(alt) THEN 'DEL' ELSE 'SNP' END AS kind FROM variants) v
      WHERE filt NOT IN ('RefCall', 'LowQual') AND NOT (gt_a = 0 AND gt_b = 0) AND ref <> alt""",
    "snps": "SELECT * FROM called WHERE kind = 'SNP'",
    "tri": """SELECT s.*, substring(g.seq, CAST(pos AS INT), 1) AS l, substring(g.seq, CAST(pos + 2 AS INT), 1) AS r FROM snps s JOIN genome g ON s.contig = g.contig
      WHERE pos >= 1 AND LENGTH(substring(g.seq, CAST(pos AS INT), 3)) = 3 AND substring(g.seq, CAST(pos + 1 AS INT), 1) = s.ref""",
    "sbs": f"""SELECT contig, 'sbs12' AS k, CONCAT(ref, '_to_', alt) AS t FROM snps
      UNION ALL SELECT contig, 'sbs6', CASE WHEN ref IN ('A', 'G') THEN CONCAT({COMP.format('ref')}, '_to_', {COMP.format('alt')}) ELSE CONCAT(ref, '_to_', alt) END FROM snps
      UNION ALL SELECT contig, 'sbs192', CONCAT(l, '_', ref, '_to_', alt, '_', r) FROM tri
      UNION ALL SELECT contig, 'sbs96', CASE WHEN ref IN ('A', 'G') THEN CONCAT({COMP.format('r')}, '_', {COMP.format('ref')}, '_to_', {COMP.format('alt')}, '_', {COMP.format('l')})
        ELSE CONCAT(l, '_', ref, '_to_', alt, '_', r) END FROM tri""",
    "base4": "SELECT unnest(['A', 'C', 'G', 'T']) AS b",
    "types": """SELECT 'sbs12' AS k, CONCAT(x.b, '_to_', y.b) AS t FROM base4 x, base4 y WHERE x.b <> y.b
      UNION ALL SELECT 'sbs6', CONCAT(x.b, '_to_', y.b) FROM base4 x, base4 y WHERE x.b <> y.b AND x.b IN ('C', 'T')
      UNION ALL SELECT 'sbs192', CONCAT(l.b, '_', x.b, '_to_', y.b, '_', r.b) FROM base4 l, base4 x, base4 y, base4 r WHERE x.b <> y.b
      UNION ALL SELECT 'sbs96', CONCAT(l.b, '_', x.b, '_to_', y.b, '_', r.b) FROM base4 l, base4 x, base4 y, base4 r WHERE x.b <> y.b AND x.b IN ('C', 'T')""",
    "spectrum": """SELECT CONCAT(t.k, '_', t.t) AS feature, CAST(COUNT(s.t) AS DOUBLE) AS value FROM types t LEFT JOIN sbs s ON s.k = t.k AND s.t = t.t GROUP BY t.k, t.t
      UNION ALL SELECT CONCAT(t.k, '_', t.contig, '_', t.t), CAST(COUNT(s.t) AS DOUBLE) FROM (SELECT types.*, c.contig FROM types JOIN (SELECT DISTINCT contig, k FROM sbs) c ON c.k = types.k) t
        LEFT JOIN sbs s ON s.k = t.k AND s.t = t.t AND s.contig = t.contig GROUP BY t.k, t.contig, t.t""",
    "sorted_snps": "SELECT *, ROW_NUMBER() OVER (PARTITION BY contig ORDER BY pos, ref, alt, qual, gt_a) AS rn FROM snps",
    "stepped": "SELECT *, CASE WHEN LAG(pos) OVER (PARTITION BY contig ORDER BY rn) = pos - 1 THEN 0 ELSE 1 END AS brk FROM sorted_snps",
    "island": "SELECT *, SUM(brk) OVER (PARTITION BY contig ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM stepped",
    "placed_in": """SELECT *, ROW_NUMBER() OVER (PARTITION BY contig, isl ORDER BY rn) AS k, LEAD(ref) OVER (PARTITION BY contig, isl ORDER BY rn) AS nref,
      LEAD(alt) OVER (PARTITION BY contig, isl ORDER BY rn) AS nalt FROM island""",
    "doublets": "SELECT contig, pos, CONCAT(ref, nref) AS ref2, CONCAT(alt, nalt) AS alt2 FROM placed_in WHERE k % 2 = 1 AND nref IS NOT NULL",
    "dbs": """SELECT contig, CASE WHEN substring(ref2, 1, 1) IN ('A', 'G') THEN CONCAT(reverse(translate(ref2, 'ACGT', 'TGCA')), '>', reverse(translate(alt2, 'ACGT', 'TGCA')))
      ELSE CONCAT(ref2, '>', alt2) END AS k FROM doublets""",
    "dbs_features": """SELECT CONCAT('dbs_', k) AS feature, CAST(COUNT(*) AS DOUBLE) AS value FROM dbs GROUP BY k
      UNION ALL SELECT CONCAT('dbs_', contig, '_', k), CAST(COUNT(*) AS DOUBLE) FROM dbs GROUP BY contig, k""",
    "density": """SELECT CONCAT(CASE WHEN kind = 'SNP' THEN 'snp_' ELSE 'indel_' END, contig, ':', CAST((pos // 1000) * 1000 AS VARCHAR), '-', CAST((pos // 1000) * 1000 + 1000 AS VARCHAR)) AS feature,
      CAST(COUNT(*) AS DOUBLE) AS value FROM called GROUP BY 1""",
}

ORDER = ["ref", "alt", "qual", "gt_a"]


def variants(spark, sf_dir):
    return table(spark, sf_dir, "variants").withColumn("alts", F.array("alt")).drop("alt")


def called(spark, sf_dir):
    return V.called_variants(variants(spark, sf_dir))


def snps(spark, sf_dir):
    return called(spark, sf_dir).filter("kind = 'SNP'")


def chunks(spark, sf_dir):
    return N.chunk_genome(table(spark, sf_dir, "genome"))


@register("called_variants", "SELECT contig, pos, kind, ref, alt FROM called", CALLED)
def called_variants(spark, sf_dir):
    return called(spark, sf_dir).select("contig", "pos", "kind", "ref", "alt")


@register("classify_variant", "SELECT contig, pos, ref, alt, CASE WHEN LENGTH(ref) < LENGTH(alt) THEN 'INS' WHEN LENGTH(ref) > LENGTH(alt) THEN 'DEL' ELSE 'SNP' END AS kind FROM variants")
def classify_variant(spark, sf_dir):
    v = table(spark, sf_dir, "variants")
    return v.select("contig", "pos", "ref", "alt", G.classify_variant("ref", "alt").alias("kind"))


HETS = {
    "hets": """SELECT *, ROW_NUMBER() OVER (PARTITION BY contig ORDER BY qual DESC, pos, ref, alt) AS rk, COUNT(*) OVER (PARTITION BY contig) AS n
      FROM (SELECT DISTINCT contig, pos, ref, alt, qual FROM variants WHERE LEAST(gt_a, gt_b) = 0 AND GREATEST(gt_a, gt_b) = 1 AND qual >= 60) v""",
    "chosen": "SELECT * FROM hets WHERE rk <= FLOOR(n * 0.4)",
}


def _selected(spark, sf_dir):
    v = table(spark, sf_dir, "variants")
    hets = v.filter((F.least("gt_a", "gt_b") == 0) & (F.greatest("gt_a", "gt_b") == 1)).select(
        "contig", "pos", "ref", F.array("alt").alias("alts"), "qual", F.lit(0).alias("gt_a"), F.lit(1).alias("gt_b")
    ).distinct()
    return hets, V.select_het_variants(hets, ["contig"], ratio=0.4, threshold=60, ties=["pos", "ref", "alts"])


@register("select_het_variants", "SELECT contig, pos, ref, alt, qual FROM chosen", HETS)
def select_het_variants(spark, sf_dir):
    _, chosen = _selected(spark, sf_dir)
    return genome_order(chosen.select("contig", "pos", "ref", F.col("alts")[0].alias("alt"), "qual"))


@register(
    "het_summary",
    """SELECT c.contig, COUNT(*) AS selected, ROUND(AVG(qual), 6) + 0.0 AS mean_qual, MAX(qual) AS max_qual, MIN(qual) AS cutoff, ROUND(COUNT(*) / MAX(a.n), 6) + 0.0 AS ratio
    FROM chosen c JOIN (SELECT contig, COUNT(*) AS n FROM (SELECT DISTINCT contig, pos, ref, alt, qual FROM variants
      WHERE LEAST(gt_a, gt_b) = 0 AND GREATEST(gt_a, gt_b) = 1) d GROUP BY contig) a ON a.contig = c.contig GROUP BY c.contig""",
    HETS,
)
def het_summary(spark, sf_dir):
    hets, chosen = _selected(spark, sf_dir)
    out = V.het_summary(hets, chosen, ["contig"])
    return out.select("contig", "selected", round6("mean_qual").alias("mean_qual"), "max_qual", "cutoff", round6("ratio").alias("ratio"))


@register(
    "top_ratio",
    """SELECT o_orderkey, o_orderpriority FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rk,
      COUNT(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) o WHERE rk <= FLOOR(n * 0.25)""",
)
def top_ratio(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return top_ratio_rows(o, 0.25, "o_totalprice", ["o_orderkey"], ["o_orderpriority"]).drop("o_totalprice")


@register(
    "join_truth",
    """SELECT l.contig, l.locus, COALESCE(v.gt_a, 0) AS gt_a, COALESCE(v.gt_b, 0) AS gt_b, v.alleles FROM loci l LEFT JOIN
     (SELECT contig, pos, gt_a, gt_b, CONCAT(ref, ',', alt) AS alleles, ROW_NUMBER() OVER (PARTITION BY contig, pos ORDER BY qual DESC, ref DESC, alt DESC, gt_a DESC, gt_b DESC) AS rk FROM variants) v
     ON l.contig = v.contig AND l.locus = v.pos AND v.rk = 1""",
)
def join_truth(spark, sf_dir):
    v = table(spark, sf_dir, "variants").select(
        "contig", F.col("pos").alias("locus"), "gt_a", "gt_b", F.array("ref", "alt").alias("alleles"),
        F.struct("qual", "ref", "alt", "gt_a", "gt_b").alias("ord"),
    )
    out = V.join_truth(table(spark, sf_dir, "loci"), v, ["contig", "locus"], "ord")
    return out.select("contig", "locus", "gt_a", "gt_b", F.when(F.col("alleles").isNotNull(), F.concat_ws(",", "alleles")).alias("alleles"))


@register(
    "ref_window",
    """SELECT l.contig, l.locus, upper(substring(g.seq, CAST(locus - 16 + 1 AS INT), 33)) AS bases FROM loci l JOIN genome g ON l.contig = g.contig
    WHERE locus - 16 >= 0 AND LENGTH(substring(g.seq, CAST(locus - 16 + 1 AS INT), 33)) = 33""",
)
def ref_window(spark, sf_dir):
    return N.ref_window(table(spark, sf_dir, "loci"), chunks(spark, sf_dir), 16, 17, pos="locus", name="bases")


@register("trinucleotide_context", 'SELECT contig, pos, ref, alt, l AS "left", r AS "right" FROM tri', CALLED)
def trinucleotide_context(spark, sf_dir):
    out = V.trinucleotide_context(snps(spark, sf_dir), chunks(spark, sf_dir))
    return out.select("contig", "pos", "ref", "alt", "left", "right")


@register("mutation_density", "SELECT feature, value FROM density", CALLED)
def mutation_density(spark, sf_dir):
    return V.mutation_density(called(spark, sf_dir), window=1000)


@register("sbs_spectrum", "SELECT feature, value FROM spectrum", CALLED)
def sbs_spectrum(spark, sf_dir):
    return V.sbs_spectrum(snps(spark, sf_dir), chunks(spark, sf_dir))


@register("sbs_keys", "SELECT contig, k, t AS type, COUNT(*) AS n FROM sbs WHERE k IN ('sbs6', 'sbs12') GROUP BY contig, k, t", CALLED)
def sbs_keys(spark, sf_dir):
    s = snps(spark, sf_dir).select(
        "contig",
        F.explode(
            F.array(
                F.struct(F.lit("sbs6").alias("k"), G.sbs_key("ref", "alt").alias("t")),
                F.struct(F.lit("sbs12").alias("k"), G.sbs_key("ref", "alt", folded=False).alias("t")),
            )
        ).alias("s"),
    )
    return s.groupBy("contig", F.col("s.k").alias("k"), F.col("s.t").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@register("pair_adjacent", "SELECT contig, pos, ref2, alt2 FROM doublets", CALLED)
def pair_adjacent(spark, sf_dir):
    return V.pair_adjacent(snps(spark, sf_dir), ["contig"], ORDER)


@register("dbs_spectrum", "SELECT feature, value FROM dbs_features", CALLED)
def dbs_spectrum(spark, sf_dir):
    return V.dbs_spectrum(snps(spark, sf_dir), ORDER)


@register(
    "mutation_features",
    "SELECT * FROM density UNION ALL SELECT * FROM spectrum UNION ALL SELECT * FROM dbs_features",
    CALLED,
)
def mutation_features(spark, sf_dir):
    return mutation_plan(called(spark, sf_dir), chunks(spark, sf_dir), ORDER, window=1000)


@register("sorted_genotype", "SELECT contig, pos, ref, alt, gt_b AS given_a, gt_a AS given_b, LEAST(gt_a, gt_b) AS a, GREATEST(gt_a, gt_b) AS b, CAST(CASE CONCAT(LEAST(gt_a, gt_b), '/', GREATEST(gt_a, gt_b)) WHEN '0/0' THEN 0 WHEN '1/1' THEN 1 WHEN '0/1' THEN 2 WHEN '1/2' THEN 3 END AS INT) AS idx FROM variants")
def sorted_genotype(spark, sf_dir):
    v = table(spark, sf_dir, "variants")
    g = G.sorted_genotype("gt_b", "gt_a")
    return v.select(
        "contig", "pos", "ref", "alt", F.col("gt_b").alias("given_a"), F.col("gt_a").alias("given_b"), g["a"].alias("a"),
        g["b"].alias("b"), G.genotype_index("gt_b", "gt_a").alias("idx"),
    )


LABEL = """CASE WHEN LENGTH(ref) > LENGTH({0}) THEN 'D' WHEN LENGTH(ref) < LENGTH({0}) THEN 'I' ELSE substring({0}, 1, 1) END"""
TYPED = {
    "pairs2": f"""SELECT contig, pos, ref, alt, gt_a, gt_b, qual, x, y, list_sort([{LABEL.format('x')}, {LABEL.format('y')}]) AS g FROM
      (SELECT *, CASE WHEN gt_a = 0 OR gt_b = 0 THEN ref ELSE alt END AS x, alt AS y FROM variants) v""",
}


@register(
    "allele_type",
    "SELECT contig, pos, ref, alt, gt_a, gt_b, qual, CONCAT(CASE WHEN g[1] = g[2] AND g[1] IN ('D', 'I') AND x <> y THEN lower(g[1]) ELSE g[1] END, g[2]) AS at FROM pairs2",
    TYPED,
)
def allele_type(spark, sf_dir):
    v = table(spark, sf_dir, "variants")
    first = F.when((F.col("gt_a") == 0) | (F.col("gt_b") == 0), F.col("ref")).otherwise(F.col("alt"))
    return v.select("contig", "pos", "ref", "alt", "gt_a", "gt_b", "qual", G.allele_type("ref", first, "alt").alias("at"))


LABELED = {
    "alleled": """SELECT contig, pos, ref, alt, qual, CASE WHEN gt_a = 1 AND qual > 80 THEN 2 ELSE gt_a END AS a, CASE WHEN gt_a = 1 AND qual > 80 THEN 2 ELSE gt_b END AS b,
       CASE WHEN qual > 80 THEN [ref, 'TTTTT', alt] WHEN qual > 40 THEN [ref, alt, '*'] ELSE [ref, alt] END AS alleles FROM (SELECT DISTINCT contig, pos, ref, alt, qual, gt_a, gt_b FROM variants) d""",
    "norm": """SELECT *, CASE WHEN a = 2 AND b = 2 THEN 1 ELSE a END AS na, CASE WHEN a = 2 AND b = 2 THEN 1 ELSE b END AS nb, CASE WHEN a = 2 AND b = 2 THEN [alleles[3]] ELSE alleles[2:] END AS alts FROM alleled""",
    "starred": """SELECT *, list_contains(alts, '*') AS star, CASE WHEN list_contains(alts, '*') THEN NOT (na = 1 AND nb = 2) ELSE (na = 0 OR nb = 0) END AS has_ref FROM norm""",
    "expanded": "SELECT *, CASE WHEN len(alts) = 1 THEN (CASE WHEN has_ref THEN [ref, alts[1]] ELSE [alts[1], alts[1]] END) ELSE alts END AS two FROM starred",
    "picked": """SELECT *, CASE WHEN list_contains(two, '*') THEN (CASE WHEN two[1] <> '*' THEN two[1] ELSE two[2] END) ELSE two[1] END AS x,
       CASE WHEN list_contains(two, '*') THEN (CASE WHEN two[1] <> '*' THEN two[1] ELSE two[2] END) ELSE two[2] END AS y FROM expanded""",
    "lettered": f"SELECT *, list_sort([{LABEL.format('x')}, {LABEL.format('y')}]) AS g FROM picked",
}


@register(
    "allele_type_label",
    "SELECT contig, pos, ref, alt, qual, a, b, CONCAT(CASE WHEN g[1] = g[2] AND g[1] IN ('D', 'I') AND x <> y THEN lower(g[1]) ELSE g[1] END, g[2]) AS at FROM lettered",
    LABELED,
)
def allele_type_label(spark, sf_dir):
    v = table(spark, sf_dir, "variants").select("contig", "pos", "ref", "alt", "qual", "gt_a", "gt_b").distinct()
    two = (F.col("gt_a") == 1) & (F.col("qual") > 80)
    v = v.select(
        "contig", "pos", "ref", "alt", "qual", F.when(two, 2).otherwise(F.col("gt_a")).alias("a"),
        F.when(two, 2).otherwise(F.col("gt_b")).alias("b"),
        F.when(F.col("qual") > 80, F.array(F.col("ref"), F.lit("TTTTT"), F.col("alt")))
        .when(F.col("qual") > 40, F.array(F.col("ref"), F.col("alt"), F.lit("*")))
        .otherwise(F.array("ref", "alt")).alias("alleles"),
    )
    return v.select("contig", "pos", "ref", "alt", "qual", "a", "b", G.allele_type_label("a", "b", "alleles").alias("at"))


@register(
    "merge_sorted",
    """SELECT contig, pos, ref, alt, shard FROM (SELECT contig, pos, ref, alt, 'high' AS shard FROM variants WHERE qual >= 50
     UNION ALL SELECT contig, pos, ref, alt, 'low' FROM variants WHERE qual < 50) m""",
)
def merge_sorted(spark, sf_dir):
    from fragx.sources.vcf import merge_sorted as merge

    v = table(spark, sf_dir, "variants")
    part = [v.filter(c).select("contig", "pos", "ref", "alt", F.lit(n).alias("shard")) for n, c in (("high", "qual >= 50"), ("low", "qual < 50"))]
    return merge(part)


@register(
    "parse_indel_token",
    """SELECT contig, pos, ref, alt, token, CASE WHEN LENGTH(ref) = LENGTH(alt) THEN NULL ELSE CONCAT(substring(ref, 1, 1), body) END AS parsed FROM (
      SELECT *, CASE WHEN LENGTH(alt) > LENGTH(ref) THEN substring(alt, 2) ELSE substring(ref, 2) END AS body,
       CASE WHEN LENGTH(alt) > LENGTH(ref) THEN CONCAT(substring(ref, 1, 1), '+', LENGTH(alt) - 1, substring(alt, 2)) WHEN LENGTH(alt) < LENGTH(ref)
       THEN CONCAT(substring(ref, 1, 1), '-', LENGTH(ref) - 1, substring(ref, 2)) ELSE CONCAT(ref, '+7AC') END AS token FROM variants) v""",
)
def parse_indel_token(spark, sf_dir):
    from fragx.functions.sequence import parse_indel_token as parse

    v = table(spark, sf_dir, "variants")
    size = (F.length("alt") - 1).cast("string")
    token = (
        F.when(F.length("alt") > F.length("ref"), F.concat(F.substring("ref", 1, 1), F.lit("+"), size, F.expr("substring(alt, 2)")))
        .when(F.length("alt") < F.length("ref"), F.concat(F.substring("ref", 1, 1), F.lit("-"), (F.length("ref") - 1).cast("string"), F.expr("substring(ref, 2)")))
        .otherwise(F.concat("ref", F.lit("+7AC")))
    )
    return v.select("contig", "pos", "ref", "alt", token.alias("token")).withColumn("parsed", parse("token"))
