"""From allele-type probabilities to variant records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fragx import constants as K
from fragx.functions import genotype as G
from fragx.functions.common import string_array
from fragx.functions.region import is_diploid
from fragx.functions.sequence import pick_indel_alt


def _count(name: Column) -> Column:
    """Reads of a symbol: the plain count where it stands alone, else what its indels carry."""
    return F.coalesce(
        F.try_element_at("_alts", name), F.try_element_at("_folded", name), F.lit(0).cast("long")
    )


def _indels(sign: str) -> Column:
    entries = F.filter(F.map_entries("_alts"), lambda e: e["key"].startswith(sign))
    ranked = F.array_sort(
        F.transform(entries, lambda e: F.struct((-e["value"]).alias("n"), F.substring(e["key"], F.lit(2), F.length(e["key"])).alias("s")))
    )
    return F.transform(ranked, lambda s: s["s"])


def _attempt(prob: Column, idx: Column, kind: Column, r: Column) -> Column:
    """What one allele type would call; null when the reads do not support it."""
    x, y = F.substring(kind, 1, 1), F.substring(kind, 2, 1)
    gt = G.type_to_genotype(r, kind)
    ref_n = F.col("_ref_n")

    def seen(b):
        return F.array_contains("_bases", b)

    def rest(text):
        return F.substring(text, F.lit(2), F.length(text))

    ref_seen = seen(r)
    n_ins, n_del = F.size("_ins"), F.size("_del")
    ins1, ins2 = F.get("_ip", F.lit(0)), F.get("_ip", F.lit(1))
    del1, del2 = F.get("_dp", F.lit(0)), F.get("_dp", F.lit(1))
    ins_n1, ins_n2 = _count(F.concat(F.lit("+"), ins1)), _count(F.concat(F.lit("+"), ins2))
    del_n1, del_n2 = _count(F.concat(F.lit("-"), del1)), _count(F.concat(F.lit("-"), del2))
    swap = F.length(del1) < F.length(del2)
    longer, extra = F.when(swap, del2).otherwise(del1), F.abs(F.length(del1) - F.length(del2))
    # Equal lengths leave the whole text as tail, as a slice from negative zero does.
    tail = F.when(extra == 0, longer).otherwise(F.right(longer, extra))
    # The base beside a single I or D, and the base beside the reference in a heterozygous SNP.
    beside_i, beside_d = F.when(x == "I", y).otherwise(x), F.when(x == "D", y).otherwise(x)
    other = F.when(x == r, y).otherwise(x)
    het = gt == "0/1"
    one_ins = F.when(het, ref_seen).otherwise(seen(beside_i)) & (n_ins >= 1)
    one_del = F.when(het, ref_seen).otherwise(seen(beside_d)) & (n_del >= 1)

    def call(alleles, counts):
        return F.struct(
            prob.cast("double").alias("prob"), idx.alias("idx"), gt.alias("gt"), kind.alias("at"),
            F.array(*alleles).alias("alleles"), F.array(*counts).alias("counts"),
        )

    found = (
        F.when(gt == "0/0", F.when(ref_seen, call([r, r], [ref_n, ref_n])))
        .when(kind == "II", F.when(n_ins >= 1, call([r, ins1], [ref_n, ins_n1])))
        .when(kind == "iI", F.when(n_ins >= 2, call([r, ins1, ins2], [ref_n, ins_n1, ins_n2])))
        .when(kind == "DD", F.when(n_del >= 1, call([del1, r], [ref_n, del_n1])))
        .when(
            kind == "dD",
            F.when(
                n_del >= 2,
                call(
                    [longer, r, F.concat(r, tail)],
                    [ref_n, F.when(swap, del_n2).otherwise(del_n1), F.when(swap, del_n1).otherwise(del_n2)],
                ),
            ),
        )
        .when(
            kind == "DI",
            F.when((n_del >= 1) & (n_ins >= 1), call([del1, r, F.concat(ins1, rest(del1))], [ref_n, del_n1, ins_n1])),
        )
        # Beside a base the allele is the most frequent insertion, the count that of the best match.
        .when(
            kind.contains("I"),
            F.when(
                one_ins,
                F.when(het, call([r, ins1], [ref_n, ins_n1])).otherwise(
                    call([r, beside_i, F.get("_ins", F.lit(0))], [ref_n, _count(beside_i), ins_n1])
                ),
            ),
        )
        .when(
            kind.contains("D"),
            F.when(
                one_del,
                F.when(het, call([del1, r], [ref_n, del_n1])).otherwise(
                    call([del1, F.concat(beside_d, rest(del1)), r], [ref_n, _count(beside_d), del_n1])
                ),
            ),
        )
        .when(gt == "1/1", F.when(seen(x), call([r, x], [ref_n, _count(x)])))
        .when(het, F.when(ref_seen & seen(other), call([r, other], [ref_n, _count(other)])))
        .otherwise(F.when(seen(x) & seen(y), call([r, x, y], [ref_n, _count(x), _count(y)])))
    )
    return F.when(F.col("_diploid") | ~gt.isin("0/1", "1/2"), found)


def resolve_alleles(
    sites: DataFrame, probs: str = "probs", ref: str = "ref_base", alts: str = "alt_bases",
    diploid: Column | None = None, predicted: str | None = None,
) -> DataFrame:
    """The most probable allele type that the observed alleles support, as ``call``.

    ``call`` = struct(prob, idx, gt, at, alleles, counts); a site whose reads
    support no type gives no row. All 24 types are tested inside one projection by one rule over
    the probability array: no shuffle and no second pass. On equal probabilities the later type wins; equal indel counts
    order by sequence. ``predicted`` names an array of expected indels (``+``/``-``
    texts), matched by prefix.
    """
    seen = F.map_filter(F.col(alts), lambda _, n: n > 0)
    base = sites.withColumn("_alts", seen)
    keys = F.array_distinct(
        F.transform(
            F.map_keys("_alts"),
            lambda k: F.when(k.startswith("+") | k.startswith("-"), F.substring(k, 2, 1)).otherwise(k),
        )
    )
    fold = F.map_from_arrays(
        F.col("_bases"),
        F.transform(
            F.col("_bases"),
            lambda b: F.aggregate(
                F.filter(
                    F.map_entries("_alts"),
                    lambda e: (e["key"] == b) | (e["key"].rlike(r"^[+\-]") & (F.substring(e["key"], 2, 1) == b)),
                ),
                F.lit(0).cast("long"),
                lambda acc, e: acc + e["value"],
            ),
        ),
    )
    base = base.withColumn("_bases", keys).withColumn("_folded", fold)
    base = base.withColumn("_ins", _indels("+")).withColumn("_del", _indels("-"))

    def expected(sign):
        return F.array_distinct(
            F.transform(
                F.filter(F.col(predicted), lambda a: a.startswith(sign)), lambda a: F.substring(a, F.lit(2), F.length(a))
            )
        )

    for sign, listed, name in (("+", "_ins", "_ip"), ("-", "_del", "_dp")):
        picked = F.slice(listed, 1, 2) if predicted is None else pick_indel_alt(expected(sign), listed, 2)
        base = base.withColumn(name, picked)
    two = diploid if diploid is not None else F.lit(True)
    base = base.withColumn("_diploid", two)
    base = base.withColumn("_ref_n", _count(F.col(ref)))
    kinds = string_array(K.ALLELE_TYPES)
    tried = F.transform(F.col(probs), lambda p, i: _attempt(p, i, F.get(kinds, i), F.col(ref)))
    # A generator, not a filter on the result: the optimizer would copy the whole rule into the filter.
    best = F.explode(F.array_compact(F.array(F.array_max(F.array_compact(tried)))))
    helpers = ["_alts", "_bases", "_folded", "_ins", "_del", "_ip", "_dp", "_diploid", "_ref_n"]
    return base.select("*", best.alias("call")).drop(*helpers)


def call_variants(
    sites: DataFrame, probs: str = "probs", contig: str = "contig", pos: str = "pos", ref: str = "ref_base",
    alts: str = "alt_bases", snp_threshold: float = 55.0, indel_threshold: float = 55.0,
    haploid: list[str] | None = None, mode: str = "msa", keys: list[str] | None = None,
) -> DataFrame:
    """Variant records: genotype, qualities, depth, allele counts and fractions, filter.

    Sites without a supported allele type give no record. Likelihoods stand in
    the order 0/0, 0/1, 1/1 and 1/2 and are padded for three alleles. PASS needs
    a quality strictly above the threshold of its kind.
    """
    called = resolve_alleles(sites, probs, ref, alts, diploid=is_diploid(contig, pos, haploid or []))
    gp = G.genotype_probs(ref, probs)
    rows = called.withColumn("_gp", gp).withColumn("_pl", G.phred_likelihoods("_gp"))
    pl = F.transform("_pl", lambda x: x.cast("int"))
    rows = rows.withColumn("_pl4", pl)
    depth = F.aggregate(F.map_values(alts), F.lit(0).cast("long"), lambda acc, n: acc + n)
    qual = F.round(F.col("call.prob") * 100, 2)
    indel = F.col("call.at").rlike("[ID]")
    threshold = F.when(indel, indel_threshold).otherwise(snp_threshold)
    verdict = F.when(F.col("call.gt") == "0/0", "RefCall").when(F.col("qual") > threshold, "PASS").otherwise("LowQual")
    p = [F.col("_pl4")[i] for i in range(4)]
    likelihoods = F.when(F.size("call.alleles") == 2, F.array(p[0], p[2], p[1])).otherwise(
        F.array(p[0], p[2], p[1], F.lit(0), p[3], F.lit(0))
    )
    rows = rows.withColumn("qual", qual).withColumn("dp", depth)
    return rows.select(
        *(keys or []), contig, pos, F.col("call.alleles").alias("alleles"), "qual", verdict.alias("filt"),
        F.col("call.gt").alias("GT"), G.genotype_quality("_gp").cast("int").alias("GQ"), F.col("dp").alias("DP"),
        likelihoods.alias("PL"), F.col("call.counts").alias("AD"),
        F.transform(F.slice("call.counts", 2, 2), lambda n: F.try_divide(n, F.col("dp"))).alias("AF"),
        F.round("call.prob", 2).alias("AP"), F.transform("_gp", lambda x: F.round(x, 2)).alias("GP"),
        F.lit("P" if mode == "profile" else "M").alias("IM"), F.col("call.at").alias("at"),
    )
