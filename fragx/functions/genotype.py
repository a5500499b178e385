"""Allele-type, genotype and quality expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fragx import constants as K
from fragx.functions.common import col


def sorted_genotype(a: Column | str, b: Column | str) -> Column:
    """struct(a,b) in ascending order; a pair with a missing allele is left alone."""
    a, b = col(a), col(b)
    known = a.isNotNull() & b.isNotNull()
    return F.struct(
        F.when(known, F.least(a, b)).otherwise(a).alias("a"),
        F.when(known, F.greatest(a, b)).otherwise(b).alias("b"),
    )


def genotype_index(a: Column | str, b: Column | str) -> Column:
    """Index in 0/0, 1/1, 0/1, 1/2; null for any other pair."""
    text = F.concat_ws("/", F.least(col(a), col(b)).cast("string"), F.greatest(col(a), col(b)).cast("string"))
    chain = F.lit(None).cast("int")
    for i, name in enumerate(K.GENOTYPES):
        chain = F.when(text == name, F.lit(i)).otherwise(chain)
    return chain


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _label(ref: Column, alt: Column) -> Column:
    alt = F.when(alt.contains("*"), F.lit("")).otherwise(alt)
    return (
        F.when(F.length(ref) > F.length(alt), "D")
        .when(F.length(ref) < F.length(alt), "I")
        .otherwise(F.substring(alt, 1, 1))
    )


def allele_type(ref, alt0, alt1) -> Column:
    """Two-letter allele type; the first letter is lower case for two different indels of one kind."""
    ref, alt0, alt1 = col(ref), col(alt0), col(alt1)

    def letters(v: Column) -> Column:
        return F.array_sort(F.array(_label(v["ref"], v["alt0"]), _label(v["ref"], v["alt1"])))

    def text(v: Column) -> Column:
        first, second = v["pair"][0], v["pair"][1]
        two_indels = (first == second) & first.isin("D", "I") & v["other"]
        return F.concat(F.when(two_indels, F.lower(first)).otherwise(first), second)

    named = F.struct(ref.alias("ref"), alt0.alias("alt0"), alt1.alias("alt1"))
    return _once(named, lambda v: _once(F.struct(letters(v).alias("pair"), (v["alt0"] != v["alt1"]).alias("other")), text))


def allele_type_label(a, b, alleles) -> Column:
    """Training label of a variant: the allele type after genotype normalisation."""
    a, b, alleles = col(a), col(b), col(alleles)
    ref = alleles[0]
    doubled = (a == 2) & (b == 2)
    alts = F.when(doubled, F.array(F.get(alleles, F.lit(2)))).otherwise(
        F.slice(alleles, F.lit(2), F.greatest(F.size(alleles) - 1, F.lit(0)))
    )

    def two(alts: Column) -> Column:
        starred = F.array_contains(alts, "*")
        has_ref = F.when(starred, ~((a == 1) & (b == 2))).when(doubled, F.lit(False)).otherwise((a == 0) | (b == 0))
        one = F.when(has_ref, F.array(ref, alts[0])).otherwise(F.array(alts[0], alts[0]))
        return F.when(F.size(alts) == 1, one).otherwise(alts)

    def shown(pair: Column) -> Column:
        first, second = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
        other = F.when(first != "*", first).otherwise(second)
        is_starred = F.array_contains(pair, "*")
        return F.struct(F.when(is_starred, other).otherwise(first).alias("x"), F.when(is_starred, other).otherwise(second).alias("y"))

    return _once(_once(_once(alts, two), shown), lambda v: allele_type(ref, v["x"], v["y"]))


def type_to_genotype(ref: Column | str, kind: Column | str) -> Column:
    """Genotype text of an allele type seen against a reference base."""
    ref, kind = col(ref), col(kind)
    same = F.substring(kind, 1, 1) == F.substring(kind, 2, 1)
    return (
        F.when(~ref.isin(*K.BASES) | kind.contains("N"), "0/0")
        .when(kind.contains(ref), F.when(same, "0/0").otherwise("0/1"))
        .when(same, "1/1")
        .otherwise("1/2")
    )


def _genotype_of(ref: str, kind: str) -> str:
    """The rule of ``type_to_genotype`` for a known base, used to lay out constant sums."""
    if "N" in kind:
        return "0/0"
    same = kind[0] == kind[1]
    if ref in kind:
        return "0/0" if same else "0/1"
    return "1/1" if same else "1/2"


def genotype_probs(ref: Column | str, probs: Column | str) -> Column:
    """24 allele-type probabilities summed into the 4 genotypes."""
    ref, probs = col(ref), col(probs)

    def total(indexes):
        out = F.lit(0.0)
        for i in indexes:
            out = out + probs[i]
        return out

    everything = total(range(len(K.ALLELE_TYPES)))
    totals = []
    for name in K.GENOTYPES:
        chain = everything if name == "0/0" else F.lit(0.0)
        for base in K.BASES:
            members = [i for i, kind in enumerate(K.ALLELE_TYPES) if _genotype_of(base, kind) == name]
            chain = F.when(ref == base, total(members)).otherwise(chain)
        totals.append(chain)
    return F.array(*totals)


def phred_likelihoods(gt_probs: Column | str, normalize: bool = True, eps: float = 1e-8) -> Column:
    pl = F.transform(col(gt_probs), lambda p: F.lit(-10.0) * F.log10(p + F.lit(eps)))
    return F.transform(pl, lambda x: x - F.array_min(pl)) if normalize else pl


def _clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def genotype_quality(gt_probs: Column | str) -> Column:
    """Second smallest normalised likelihood, held in 0..99."""
    return _clip(F.array_sort(phred_likelihoods(gt_probs))[1], 0.0, 99.0)


def variant_quality(gt_probs: Column | str, eps: float = 1e-8) -> Column:
    """Phred-scaled probability of a homozygous reference, held in 0..99."""
    return _clip(F.lit(-10.0) * F.log10(col(gt_probs)[0] + F.lit(eps)), 0.0, 99.0)


def quality_score(prob: Column | str, eps: float = 1e-10) -> Column:
    p = _clip(col(prob), 0.0, 1.0)
    score = F.lit(-10.0) * F.log10((F.lit(1.0) - p + F.lit(eps)) / (p + F.lit(eps))) + F.lit(10.0)
    return F.round(F.greatest(score, F.lit(0.0)), 2)


def classify_variant(ref: Column | str, alt: Column | str) -> Column:
    ref, alt = col(ref), col(alt)
    return (
        F.when(F.length(ref) < F.length(alt), "INS").when(F.length(ref) > F.length(alt), "DEL").otherwise("SNP")
    )


def sbs_key(ref, alt, left=None, right=None, folded: bool = True) -> Column:
    """Substitution label; folded labels are written from the pyrimidine strand."""
    ref, alt = col(ref), col(alt)

    def comp(c):
        return F.translate(c, "ACGT", "TGCA")

    flip = ref.isin("A", "G") if folded else F.lit(False)
    change = F.concat(
        F.when(flip, comp(ref)).otherwise(ref), F.lit("_to_"), F.when(flip, comp(alt)).otherwise(alt)
    )
    if left is None:
        return change
    left, right = col(left), col(right)
    return F.concat_ws(
        "_",
        F.when(flip, comp(right)).otherwise(left),
        change,
        F.when(flip, comp(left)).otherwise(right),
    )


def dbs_key(ref2: Column | str, alt2: Column | str) -> Column:
    """Doublet label, written from the other strand when it starts with a purine."""
    from fragx.functions.sequence import rev_comp

    ref2, alt2 = col(ref2), col(alt2)
    flip = F.substring(ref2, 1, 1).isin("A", "G")
    return F.concat(
        F.when(flip, rev_comp(ref2)).otherwise(ref2),
        F.lit(">"),
        F.when(flip, rev_comp(alt2)).otherwise(alt2),
    )
