"""Class probabilities, variant resolution, features and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragx import constants as K
from fragx.catalog.registry import register
from fragx.fixtures import table
from fragx.functions import genotype as G, probability as P, sequence as S
from fragx.functions.common import round6
from fragx.operators import calling as C, metrics as M

# ----------------------------------------------------------------- probabilities


def probs(spark, sf_dir, width=24):
    p = table(spark, sf_dir, f"probs{width}")
    packed = p.groupBy("vec_id", "label").agg(F.array_sort(F.collect_list(F.struct("idx", "p"))).alias("s"))
    return packed.select("vec_id", "label", F.transform("s", lambda x: x["p"]).alias("probs"))


REF = "substring('ACGT', CAST(vec_id % 4 + 1 AS INT), 1)"


def ref_base():
    return F.substring(F.lit("ACGT"), (F.col("vec_id") % 4 + 1).cast("int"), F.lit(1))


GT_OF = """CASE WHEN {ref} NOT IN ('A','C','G','T') OR contains({ty}, 'N') THEN '0/0' WHEN contains({ty}, {ref}) THEN
 CASE WHEN substring({ty}, 1, 1) = substring({ty}, 2, 1) THEN '0/0' ELSE '0/1' END WHEN substring({ty}, 1, 1) = substring({ty}, 2, 1) THEN '1/1' ELSE '1/2' END"""
TYPES = "[" + ", ".join(f"'{t}'" for t in K.ALLELE_TYPES) + "]"

GENO = {
    "typed": f"SELECT vec_id, label, idx, p, {REF} AS ref, {TYPES}[idx + 1] AS ty FROM probs24",
    "gts": f"SELECT *, {GT_OF.format(ref='ref', ty='ty')} AS gt FROM typed",
    "gp": """SELECT vec_id, SUM(CASE WHEN gt = '0/0' THEN p ELSE 0 END) AS g0, SUM(CASE WHEN gt = '1/1' THEN p ELSE 0 END) AS g1,
      SUM(CASE WHEN gt = '0/1' THEN p ELSE 0 END) AS g2, SUM(CASE WHEN gt = '1/2' THEN p ELSE 0 END) AS g3 FROM gts GROUP BY vec_id""",
    "raw": "SELECT *, [-10 * log10(g0 + 1e-8), -10 * log10(g1 + 1e-8), -10 * log10(g2 + 1e-8), -10 * log10(g3 + 1e-8)] AS l FROM gp",
    "pl": "SELECT *, list_transform(l, lambda x: x - list_min(l)) AS n FROM raw",
}


@register("softmax", """SELECT vec_id, i AS idx, ROUND(exp(x - m) / SUM(exp(x - m)) OVER (PARTITION BY vec_id), 6) + 0.0 AS p FROM
 (SELECT vec_id, CAST(unnest(range(0, len(embedding))) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings) e""")
def softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(P.softmax("embedding")).alias("idx", "p"))
    return e.select("vec_id", "idx", round6("p").alias("p"))


@register("argmax_topk", "SELECT vec_id, CAST(ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY p DESC, idx) - 1 AS INT) AS rank, idx FROM probs24")
def argmax_topk(spark, sf_dir):
    return probs(spark, sf_dir).select("vec_id", F.posexplode(P.ranked_classes("probs")).alias("rank", "idx"))


@register("type_to_genotype", "SELECT vec_id, idx, ref, ty AS kind, gt FROM gts", GENO)
def type_to_genotype(spark, sf_dir):
    names = F.array(*[F.lit(t) for t in K.ALLELE_TYPES])
    p = table(spark, sf_dir, "probs24").select("vec_id", "idx", ref_base().alias("ref"), names[F.col("idx")].alias("kind"))
    return p.withColumn("gt", G.type_to_genotype("ref", "kind"))


@register("genotype_probs", "SELECT vec_id, ROUND(g0, 6) + 0.0 AS g0, ROUND(g1, 6) + 0.0 AS g1, ROUND(g2, 6) + 0.0 AS g2, ROUND(g3, 6) + 0.0 AS g3 FROM gp", GENO)
def genotype_probs(spark, sf_dir):
    g = probs(spark, sf_dir).select("vec_id", G.genotype_probs(ref_base(), "probs").alias("g"))
    return g.select("vec_id", *[round6(F.col("g")[i]).alias(f"g{i}") for i in range(4)])


@register(
    "phred_quality",
    """SELECT vec_id, ROUND(n[1], 5) + 0.0 AS pl0, ROUND(n[2], 5) + 0.0 AS pl1, ROUND(n[3], 5) + 0.0 AS pl2, ROUND(n[4], 5) + 0.0 AS pl3,
      ROUND(LEAST(GREATEST(list_sort(n)[2], 0), 99), 5) + 0.0 AS gq, ROUND(LEAST(GREATEST(l[1], 0), 99), 5) + 0.0 AS qual,
      ROUND(GREATEST(-10 * log10((1.0 - g2 + 1e-10) / (g2 + 1e-10)) + 10, 0), 2) AS score FROM pl""",
    GENO,
)
def phred_quality(spark, sf_dir):
    g = probs(spark, sf_dir).select("vec_id", G.genotype_probs(ref_base(), "probs").alias("g"))
    pl = G.phred_likelihoods("g")
    r5 = lambda c: F.round(c, 5) + F.lit(0.0)
    return g.select(
        "vec_id", *[r5(pl[i]).alias(f"pl{i}") for i in range(4)], r5(G.genotype_quality("g")).alias("gq"),
        r5(G.variant_quality("g")).alias("qual"), G.quality_score(F.col("g")[2]).alias("score"),
    )


@register(
    "origin_probs",
    "SELECT vec_id, 'healthy' AS site, ROUND(SUM(CASE WHEN idx < 2 THEN p ELSE 0 END), 6) + 0.0 AS probability FROM probs11 GROUP BY vec_id "
    "UNION ALL SELECT vec_id, 'cancer', ROUND(1 - SUM(CASE WHEN idx < 2 THEN p ELSE 0 END), 6) + 0.0 FROM probs11 GROUP BY vec_id "
    "UNION ALL SELECT vec_id, ['lung_cancer','gastric_cancer','breast_cancer','pancreatic_cancer','ovarian_cancer','bile_duct_cancer','colorectal_cancer','liver_cancer','head_and_neck_cancer'][idx - 1], ROUND(p, 6) + 0.0 FROM probs11 WHERE idx >= 2",
)
def origin_probs(spark, sf_dir):
    p = probs(spark, sf_dir, 11)
    health = P.collapse_health("probs", 11)
    both = F.array(
        F.struct(F.lit("healthy").alias("site"), health["healthy"].alias("probability")),
        F.struct(F.lit("cancer").alias("site"), health["cancer"].alias("probability")),
    )
    rows = p.select("vec_id", F.explode(F.concat(both, P.origin_probs("probs"))).alias("s"))
    return rows.select("vec_id", "s.site", round6("s.probability").alias("probability"))


# ----------------------------------------------------------------- resolution of alleles

OBSERVED = {
    **GENO,
    "obs": f"""SELECT vec_id, ref, CASE WHEN n > 0 THEN n END AS n, t FROM (SELECT vec_id, {REF} AS ref, unnest(['A', 'C', 'G', 'T', CONCAT('+', {REF}, 'AC'), CONCAT('+', {REF}, 'G'), CONCAT('-', {REF}, 'TT'), CONCAT('-', {REF}, 'T')]) AS t,
      unnest([(vec_id * 3) % 5, (vec_id * 5) % 4, (vec_id * 7) % 6, vec_id % 3, vec_id % 5, (vec_id % 7) % 3 * 2, (vec_id % 5) % 3, (vec_id % 11) % 4]) AS n FROM embeddings) x""",
    "live": "SELECT * FROM obs WHERE n IS NOT NULL",
    "seen": "SELECT vec_id, b, SUM(n) AS folded, SUM(CASE WHEN t = b THEN n END) AS plain FROM (SELECT *, CASE WHEN t LIKE '+%' OR t LIKE '-%' THEN substring(t, 2, 1) ELSE t END AS b FROM live) l GROUP BY vec_id, b",
    "cnt": "SELECT vec_id, b, COALESCE(plain, folded) AS n FROM seen",
    "ranked": "SELECT vec_id, substring(t, 1, 1) AS sign, substring(t, 2) AS s, n, ROW_NUMBER() OVER (PARTITION BY vec_id, substring(t, 1, 1) ORDER BY n DESC, substring(t, 2)) AS rk FROM live WHERE t LIKE '+%' OR t LIKE '-%'",
    "bare": f"SELECT vec_id, {REF} AS ref FROM embeddings",
    "site": """SELECT e.vec_id, e.ref, COALESCE(rc.n, 0) AS rn, rc.n IS NOT NULL AS rs,
      i1.s AS i1, i1.n AS i1n, i2.s AS i2, i2.n AS i2n, d1.s AS d1, d1.n AS d1n, d2.s AS d2, d2.n AS d2n FROM bare e LEFT JOIN cnt rc ON rc.vec_id = e.vec_id AND rc.b = e.ref
      LEFT JOIN ranked i1 ON i1.vec_id = e.vec_id AND i1.sign = '+' AND i1.rk = 1 LEFT JOIN ranked i2 ON i2.vec_id = e.vec_id AND i2.sign = '+' AND i2.rk = 2
      LEFT JOIN ranked d1 ON d1.vec_id = e.vec_id AND d1.sign = '-' AND d1.rk = 1 LEFT JOIN ranked d2 ON d2.vec_id = e.vec_id AND d2.sign = '-' AND d2.rk = 2""",
    "opts": """SELECT g.vec_id, g.idx, g.p, g.ty, g.gt, s.*, substring(g.ty, 1, 1) AS x, substring(g.ty, 2, 1) AS y, cx.n AS cx, cy.n AS cy FROM gts g JOIN site s ON s.vec_id = g.vec_id
      LEFT JOIN cnt cx ON cx.vec_id = g.vec_id AND cx.b = substring(g.ty, 1, 1) LEFT JOIN cnt cy ON cy.vec_id = g.vec_id AND cy.b = substring(g.ty, 2, 1)""",
    "tried": """SELECT *, CASE WHEN gt = '0/0' THEN CASE WHEN rs THEN [ref, ref] END
      WHEN ty = 'II' THEN CASE WHEN i1 IS NOT NULL THEN [ref, i1] END WHEN ty = 'iI' THEN CASE WHEN i2 IS NOT NULL THEN [ref, i1, i2] END
      WHEN ty = 'DD' THEN CASE WHEN d1 IS NOT NULL THEN [d1, ref] END
      WHEN ty = 'dD' THEN CASE WHEN d2 IS NOT NULL THEN CASE WHEN LENGTH(d1) < LENGTH(d2) THEN [d2, ref, CONCAT(ref, right(d2, LENGTH(d2) - LENGTH(d1)))]
          WHEN LENGTH(d1) > LENGTH(d2) THEN [d1, ref, CONCAT(ref, right(d1, LENGTH(d1) - LENGTH(d2)))] ELSE [d1, ref, CONCAT(ref, d1)] END END
      WHEN ty = 'DI' THEN CASE WHEN d1 IS NOT NULL AND i1 IS NOT NULL THEN [d1, ref, CONCAT(i1, substring(d1, 2))] END
      WHEN y = 'I' OR x = 'I' THEN CASE WHEN gt = '0/1' THEN CASE WHEN rs AND i1 IS NOT NULL THEN [ref, i1] END
          WHEN i1 IS NOT NULL AND COALESCE(cx, cy) IS NOT NULL THEN [ref, CASE WHEN x = 'I' THEN y ELSE x END, i1] END
      WHEN y = 'D' OR x = 'D' THEN CASE WHEN gt = '0/1' THEN CASE WHEN rs AND d1 IS NOT NULL THEN [d1, ref] END
          WHEN d1 IS NOT NULL AND COALESCE(cx, cy) IS NOT NULL THEN [d1, CONCAT(CASE WHEN x = 'D' THEN y ELSE x END, substring(d1, 2)), ref] END
      WHEN gt = '1/1' THEN CASE WHEN cx IS NOT NULL THEN [ref, x] END
      WHEN gt = '0/1' THEN CASE WHEN rs AND cx IS NOT NULL AND cy IS NOT NULL THEN [ref, CASE WHEN x = ref THEN y ELSE x END] END
      ELSE CASE WHEN cx IS NOT NULL AND cy IS NOT NULL THEN [ref, x, y] END END AS alleles,
      CASE WHEN gt = '0/0' THEN [rn, rn] WHEN ty = 'II' THEN [rn, i1n] WHEN ty = 'iI' THEN [rn, i1n, i2n] WHEN ty = 'DD' THEN [rn, d1n]
      WHEN ty = 'dD' THEN CASE WHEN LENGTH(d1) < LENGTH(d2) THEN [rn, d2n, d1n] ELSE [rn, d1n, d2n] END WHEN ty = 'DI' THEN [rn, d1n, i1n]
      WHEN y = 'I' OR x = 'I' THEN CASE WHEN gt = '0/1' THEN [rn, i1n] ELSE [rn, COALESCE(cx, cy), i1n] END
      WHEN y = 'D' OR x = 'D' THEN CASE WHEN gt = '0/1' THEN [rn, d1n] ELSE [rn, COALESCE(cx, cy), d1n] END
      WHEN gt = '1/1' THEN [rn, cx] WHEN gt = '0/1' THEN [rn, CASE WHEN x = ref THEN cy ELSE cx END] ELSE [rn, cx, cy] END AS counts FROM opts""",
    "chosen": "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY p DESC, idx DESC) AS pick FROM tried WHERE alleles IS NOT NULL) t WHERE pick = 1",
    "depths": "SELECT vec_id, CAST(SUM(n) AS BIGINT) AS dp FROM live GROUP BY vec_id",
}


def observed(spark, sf_dir):
    p = probs(spark, sf_dir).withColumn("ref_base", ref_base())
    v, r = F.col("vec_id"), F.col("ref_base")
    entries = F.array(
        *[
            F.struct(k.alias("k"), n.cast("long").alias("v"))
            for k, n in (
                (F.lit("A"), v * 3 % 5), (F.lit("C"), v * 5 % 4), (F.lit("G"), v * 7 % 6), (F.lit("T"), v % 3),
                (F.concat(F.lit("+"), r, F.lit("AC")), v % 5), (F.concat(F.lit("+"), r, F.lit("G")), v % 7 % 3 * 2),
                (F.concat(F.lit("-"), r, F.lit("TT")), v % 5 % 3), (F.concat(F.lit("-"), r, F.lit("T")), v % 11 % 4),
            )
        ]
    )
    return p.withColumn("alt_bases", F.map_from_entries(entries)).withColumn("contig", F.lit("chr1")).withColumn("pos", v)


@register(
    "resolve_alleles",
    """SELECT vec_id, ROUND(p, 6) + 0.0 AS prob, gt, ty AS kind, array_to_string(alleles, ',') AS alleles,
      array_to_string(list_transform(counts, lambda x: CAST(x AS BIGINT)), ',') AS counts FROM chosen""",
    OBSERVED,
)
def resolve_alleles(spark, sf_dir):
    c = C.resolve_alleles(observed(spark, sf_dir))
    return c.select(
        "vec_id", round6("call.prob").alias("prob"), "call.gt", F.col("call.at").alias("kind"), F.array_join("call.alleles", ",").alias("alleles"),
        F.array_join(F.transform("call.counts", lambda n: n.cast("string")), ",").alias("counts"),
    )


@register(
    "call_variants",
    """SELECT c.vec_id, array_to_string(alleles, ',') AS alleles, ROUND(p * 100, 2) AS qual, CASE WHEN gt = '0/0' THEN 'RefCall' WHEN ROUND(p * 100, 2) > CASE WHEN regexp_matches(ty, '[ID]') THEN 6.0 ELSE 5.0 END THEN 'PASS' ELSE 'LowQual' END AS filt,
      gt AS "GT", CAST(trunc(LEAST(GREATEST(list_sort(l.n)[2], 0), 99)) AS INT) AS "GQ", dp AS "DP",
      array_to_string(list_transform(CASE WHEN len(alleles) = 2 THEN [l.n[1], l.n[3], l.n[2]] ELSE [l.n[1], l.n[3], l.n[2], 0, l.n[4], 0] END, lambda x: CAST(trunc(x) AS INT)), ',') AS "PL",
      array_to_string(list_transform(counts, lambda x: CAST(x AS BIGINT)), ',') AS "AD", ROUND(counts[2] / dp, 6) + 0.0 AS "AF1", ROUND(p, 2) AS "AP", ROUND(g0, 2) AS "GP0"
      FROM chosen c JOIN pl l ON l.vec_id = c.vec_id JOIN depths d ON d.vec_id = c.vec_id""",
    OBSERVED,
)
def call_variants(spark, sf_dir):
    c = C.call_variants(observed(spark, sf_dir), snp_threshold=5.0, indel_threshold=6.0, keys=["vec_id"])
    joined = lambda n: F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n)
    return c.select(
        "vec_id", joined("alleles"), "qual", "filt", "GT", "GQ", "DP", joined("PL"), joined("AD"),
        round6(F.col("AF")[0]).alias("AF1"), "AP", F.col("GP")[0].alias("GP0"),
    )


@register(
    "pick_indel_alt",
    """SELECT vec_id, CASE WHEN i1 IS NULL THEN '' WHEN i2 IS NULL THEN i1 WHEN starts_with(i2, CONCAT(ref, 'G')) AND NOT starts_with(i1, CONCAT(ref, 'G')) THEN CONCAT(i2, ',', i1) ELSE CONCAT(i1, ',', i2) END AS picked FROM site""",
    OBSERVED,
)
def pick_indel_alt(spark, sf_dir):
    o = observed(spark, sf_dir)
    ins = F.filter(F.map_entries("alt_bases"), lambda e: e["key"].startswith("+") & (e["value"] > 0))
    ranked = F.array_sort(F.transform(ins, lambda e: F.struct((-e["value"]).alias("n"), F.expr("1").alias("one"), e["key"].alias("k"))))
    o = o.withColumn("_ins", F.transform(ranked, lambda s: F.substring(s["k"], F.lit(2), F.length(s["k"]))))
    return o.select(
        "vec_id", F.array_join(S.pick_indel_alt(F.array(F.concat("ref_base", F.lit("G"))), "_ins", 2), ",").alias("picked")
    )


# ----------------------------------------------------------------- metrics

CURVE = {
    "per": "SELECT score AS threshold, SUM(y) AS tp, SUM(1 - y) AS fp FROM scores GROUP BY score",
    "curve": """SELECT threshold, tp, fp, SUM(tp) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
      SUM(fp) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps FROM per""",
    "tot": "SELECT SUM(tp) AS p, SUM(fp) AS n FROM per",
}


def scores(spark, sf_dir):
    return table(spark, sf_dir, "scores")


@register("roc_curve", "SELECT ROUND(threshold, 6) + 0.0 AS threshold, CAST(tps AS BIGINT) AS tps, CAST(fps AS BIGINT) AS fps FROM curve", CURVE)
def roc_curve(spark, sf_dir):
    return M.roc_curve(scores(spark, sf_dir), "score", "y").select(round6("threshold").alias("threshold"), "tps", "fps")


@register("auc", "SELECT ROUND(SUM(fp * (2 * tps - tp) / 2.0) / MAX(tot.p * tot.n), 6) + 0.0 AS auc FROM curve, tot", CURVE)
def auc(spark, sf_dir):
    return M.auc(scores(spark, sf_dir), "score", "y").select(round6("auc").alias("auc"))


@register(
    "sensitivity_at_specificity",
    "SELECT ROUND(tps / tot.p, 6) + 0.0 AS sensitivity, ROUND(1 - fps / tot.n, 6) + 0.0 AS specificity, ROUND(threshold, 6) + 0.0 AS threshold FROM curve, tot WHERE fps / tot.n <= 1.0::DOUBLE - 0.95::DOUBLE ORDER BY curve.threshold LIMIT 1",
    CURVE,
)
def sensitivity_at_specificity(spark, sf_dir):
    s = M.sensitivity_at_specificity(scores(spark, sf_dir), "score", "y", 0.95)
    return s.select(*[round6(c).alias(c) for c in s.columns])


CELLS = {
    "top": "SELECT vec_id, label, arg_max(idx, {p: p, i: -idx}) AS yhat FROM probs11 GROUP BY vec_id, label",
    "cells": "SELECT y, yhat, CAST(COUNT(t.vec_id) AS BIGINT) AS n FROM (SELECT CAST(y AS INT) AS y, CAST(z AS INT) AS yh FROM range(0, 11) a(y), range(0, 11) b(z)) g LEFT JOIN top t ON t.label = g.y AND t.yhat = g.yh GROUP BY y, yhat, yh",
    "matrix": "SELECT CAST(g.y AS INT) AS y, CAST(g.yh AS INT) AS yhat, COUNT(t.vec_id) AS n FROM (SELECT a.y, b.z AS yh FROM range(0, 11) a(y), range(0, 11) b(z)) g LEFT JOIN top t ON t.label = g.y AND t.yhat = g.yh GROUP BY g.y, g.yh",
    "rows_": "SELECT y AS c, SUM(n) AS a FROM matrix GROUP BY y",
    "cols_": "SELECT yhat AS c, SUM(n) AS b FROM matrix GROUP BY yhat",
    "diag": "SELECT y AS c, n AS t FROM matrix WHERE y = yhat",
    "alln": "SELECT SUM(n) AS n, SUM(CASE WHEN y = yhat THEN n ELSE 0 END) AS h FROM matrix",
}
del CELLS["cells"]


def predicted(spark, sf_dir):
    return probs(spark, sf_dir, 11).withColumn("yhat", M.argmax("probs"))


@register("confusion_matrix", "SELECT y, yhat, n FROM matrix", CELLS)
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(predicted(spark, sf_dir), "label", "yhat", 11)


@register(
    "class_metrics",
    """SELECT r.c AS class, ROUND(alln.h / alln.n, 6) + 0.0 AS acc_global, ROUND((alln.n - a - b + 2 * t) / alln.n, 6) + 0.0 AS acc, ROUND(t / NULLIF(b, 0), 6) + 0.0 AS "precision", ROUND(t / NULLIF(a, 0), 6) + 0.0 AS recall,
      ROUND(2.0 * (t / NULLIF(b, 0)) * (t / NULLIF(a, 0)) / NULLIF(t / NULLIF(b, 0) + t / NULLIF(a, 0), 0), 6) + 0.0 AS f1
      FROM rows_ r JOIN cols_ USING (c) JOIN diag USING (c), alln""",
    CELLS,
)
def class_metrics(spark, sf_dir):
    m = M.class_metrics(M.confusion_matrix(predicted(spark, sf_dir), "label", "yhat", 11))
    return m.select("class", *[round6(c).alias(c) for c in m.columns if c != "class"])


@register(
    "multilabel_confusion",
    """SELECT CAST(idx AS INT) AS label, CAST(SUM(CASE WHEN label <> idx AND p <= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(SUM(CASE WHEN label <> idx AND p > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
      CAST(SUM(CASE WHEN label = idx AND p <= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(SUM(CASE WHEN label = idx AND p > 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM probs11 GROUP BY idx""",
)
def multilabel_confusion(spark, sf_dir):
    p = probs(spark, sf_dir, 11)
    onehot = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: (i == F.col("label")).cast("int"))
    return M.multilabel_confusion(p.select(onehot.alias("truth"), "probs"), "truth", "probs", 0.1)


@register("variant_metrics", "SELECT ROUND(AVG(CASE WHEN label = yhat THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS metric FROM (SELECT vec_id, label, arg_max(idx, {p: p, i: -idx}) AS yhat FROM probs24 GROUP BY vec_id, label) t")
def variant_metrics(spark, sf_dir):
    p = probs(spark, sf_dir, 24).withColumn("yhat", M.argmax("probs"))
    return M.accuracy(p, "label", "yhat").select(round6("metric").alias("metric"))


BINARY = {
    "two": "SELECT y, score AS p1 FROM scores",
    "mat": "SELECT CAST(SUM(CASE WHEN y = 1 AND p1 > 1 - p1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, SUM(CASE WHEN y = 0 AND p1 > 1 - p1 THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN y = 1 AND NOT p1 > 1 - p1 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN y = 0 AND NOT p1 > 1 - p1 THEN 1 ELSE 0 END) AS tn, COUNT(*) AS n FROM two",
    "pc": "SELECT 1 AS class, tp / NULLIF(tp + fp, 0) AS pr, tp / NULLIF(tp + fn, 0) AS re, (tp + tn) / n AS a FROM mat UNION ALL SELECT 0, tn / NULLIF(tn + fn, 0), tn / NULLIF(tn + fp, 0), (tp + tn) / n FROM mat",
    **CURVE,
    "area": "SELECT SUM(fp * (2 * tps - tp) / 2.0) / MAX(tot.p * tot.n) AS auc FROM curve, tot",
}


@register(
    "methylation_metrics",
    'SELECT class, ROUND(a, 6) + 0.0 AS acc_global, ROUND(a, 6) + 0.0 AS acc, ROUND(pr, 6) + 0.0 AS "precision", ROUND(re, 6) + 0.0 AS recall, ROUND(2 * pr * re / NULLIF(pr + re, 0), 6) + 0.0 AS f1, ROUND(auc, 6) + 0.0 AS auc FROM pc, area',
    BINARY,
)
def methylation_metrics(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("probs", F.array(1 - F.col("score"), F.col("score")))
    m = M.methylation_metrics(s, "y", "probs")
    return m.select("class", *[round6(c).alias(c) for c in m.columns if c != "class"])


MCED = {
    "col": "SELECT vec_id, CASE WHEN label > 1 THEN 1 ELSE 0 END AS y, 1.0::DOUBLE - (SUM(CASE WHEN idx = 0 THEN p ELSE 0 END) + SUM(CASE WHEN idx = 1 THEN p ELSE 0 END)) AS s FROM probs11 GROUP BY vec_id, label",
    "per": "SELECT s AS threshold, SUM(y) AS tp, SUM(1 - y) AS fp FROM col GROUP BY s",
    "curve": CURVE["curve"],
    "tot": CURVE["tot"],
    "basic": "SELECT AVG(CASE WHEN (s > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS acc, COALESCE(2.0 * SUM(CASE WHEN s > 0.5 AND y = 1 THEN 1 ELSE 0 END) / NULLIF(2 * SUM(CASE WHEN s > 0.5 AND y = 1 THEN 1 ELSE 0 END) + SUM(CASE WHEN (s > 0.5) <> (y = 1) THEN 1 ELSE 0 END), 0), 0) AS f1 FROM col",
    "area": BINARY["area"],
    "pt": "SELECT tps / tot.p AS se, 1 - fps / tot.n AS sp FROM curve, tot WHERE fps / tot.n <= 1.0::DOUBLE - 0.98::DOUBLE ORDER BY threshold LIMIT 1",
}


@register(
    "mced_metrics",
    """SELECT ROUND(acc, 6) + 0.0 AS acc, ROUND(f1, 6) + 0.0 AS f1, ROUND(auc, 6) + 0.0 AS auc, ROUND(COALESCE((SELECT se FROM pt), 0), 6) + 0.0 AS sens_98, ROUND(COALESCE((SELECT sp FROM pt), 1), 6) + 0.0 AS spec_98
      FROM basic, area""",
    MCED,
)
def mced_metrics(spark, sf_dir):
    m = M.mced_metrics(probs(spark, sf_dir, 11), "label", "probs", 11)
    return m.select(*[round6(c).alias(c) for c in m.columns])


@register("balanced_weights", "SELECT doc_id, y, ROUND((SELECT COUNT(*) / COUNT(DISTINCT y) FROM scores) / COUNT(*) OVER (PARTITION BY y), 6) + 0.0 AS weight FROM scores")
def balanced_weights(spark, sf_dir):
    return M.balanced_weights(scores(spark, sf_dir), "y").select("doc_id", "y", round6("weight").alias("weight"))


@register("summary_stats", 'SELECT y, ROUND(AVG(score), 6) + 0.0 AS mean, ROUND(STDDEV_SAMP(score), 6) + 0.0 AS std, ROUND(MAX(score), 6) + 0.0 AS "max", ROUND(MIN(score), 6) + 0.0 AS "min" FROM scores GROUP BY y')
def summary_stats(spark, sf_dir):
    s = M.summary_stats(scores(spark, sf_dir), "score", ["y"])
    return s.select("y", *[round6(c).alias(c) for c in ("mean", "std", "max", "min")])


@register("mean_of_metrics", "SELECT event_type AS metric, ROUND(AVG(value), 6) + 0.0 AS mean FROM events GROUP BY event_type")
def mean_of_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")
    return M.mean_of_metrics(e).select("metric", round6("mean").alias("mean"))


@register("ensemble_mean", "SELECT label AS sample, CAST(idx AS INT) AS idx, ROUND(AVG(p), 6) + 0.0 AS p FROM probs11 GROUP BY label, idx")
def ensemble_mean(spark, sf_dir):
    e = M.ensemble_mean(probs(spark, sf_dir, 11), ["label"])
    return e.select(F.col("label").alias("sample"), F.posexplode("probs").alias("idx", "p")).select("sample", "idx", round6("p").alias("p"))


@register("evaluate_by", "SELECT d.lang, ROUND(AVG(CASE WHEN (s.score > 0.5) = (s.y = 1) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy, ROUND(AVG((s.score - s.y) * (s.score - s.y)), 6) + 0.0 AS brier FROM scores s JOIN documents d ON d.doc_id = s.doc_id GROUP BY d.lang")
def evaluate_by(spark, sf_dir):
    s = scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    s = s.withColumn("yhat", (F.col("score") > 0.5).cast("int"))
    e = M.evaluate_by(s, ["lang"], {"accuracy": lambda: M.accuracy_metric("y", "yhat"), "brier": M.brier_metric("y", "score")})
    return e.select("lang", round6("accuracy").alias("accuracy"), round6("brier").alias("brier"))


@register(
    "user_aggregate",
    """SELECT lang, ROUND(SUM(p * (below + n / 2.0)) / NULLIF(SUM(p) * SUM(n), 0), 6) + 0.0 AS auc FROM
      (SELECT lang, p, n, SUM(n) OVER (PARTITION BY lang ORDER BY bin) - n AS below FROM
        (SELECT d.lang, floor(s.score * 1000) AS bin, CAST(SUM(s.y) AS DOUBLE) AS p, CAST(SUM(1 - s.y) AS DOUBLE) AS n FROM scores s JOIN documents d ON d.doc_id = s.doc_id GROUP BY ALL) t) u GROUP BY lang""",
)
def user_aggregate(spark, sf_dir):
    from fragx.operators import modeling as L

    s = scores(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    out = L.user_aggregate(s.select("lang", "y", "score"), ["lang"], ["y", "score"], L.BinnedAuc("y", "score"), "double", "auc")
    return out.select("lang", round6("auc").alias("auc"))


@register("masked_mean", "SELECT vec_id, ROUND(SUM(CASE WHEN x > 0 THEN x ELSE 0 END) / (1e-10 + SUM(CASE WHEN x > 0 THEN 1 ELSE 0 END)), 6) + 0.0 AS mean FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e GROUP BY vec_id")
def masked_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mask = F.transform("embedding", lambda x: (x > 0).cast("int"))
    return e.select("vec_id", round6(S.masked_mean(mask, "embedding")).alias("mean"))
