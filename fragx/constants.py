"""Fixed values of the domain (human genome build 38 and label vocabularies)."""

from __future__ import annotations

# Contig order.
AUTOSOMES = [f"chr{i}" for i in range(1, 23)]
GENOME_ORDER = AUTOSOMES + ["chrX", "chrY"]

# End of the short arm, start and end of the long arm.
ARM_BOUNDS = [
    ("chr1", 121700000, 125100000, 248956422),
    ("chr2", 91800000, 96000000, 242193529),
    ("chr3", 87800000, 94000000, 198295559),
    ("chr4", 48200000, 51800000, 190214555),
    ("chr5", 46100000, 51400000, 181538259),
    ("chr6", 58500000, 62600000, 170805979),
    ("chr7", 58100000, 62100000, 159345973),
    ("chr8", 42200000, 47200000, 145138636),
    ("chr9", 42200000, 45500000, 138394717),
    ("chr10", 38000000, 41600000, 133797422),
    ("chr11", 51000000, 55800000, 135086622),
    ("chr12", 33200000, 37800000, 133275309),
    ("chr13", 16500000, 18900000, 114364328),
    ("chr14", 16100000, 18200000, 107043718),
    ("chr15", 17500000, 20500000, 101991189),
    ("chr16", 35300000, 38400000, 90338345),
    ("chr17", 22700000, 27400000, 83257441),
    ("chr18", 15400000, 21500000, 80373285),
    ("chr19", 24200000, 28100000, 58617616),
    ("chr20", 25700000, 30400000, 64444167),
    ("chr21", 10900000, 13000000, 46709983),
    ("chr22", 13700000, 17400000, 50818468),
]

# Contig lengths; the long arm runs to the end of the contig.
CONTIG_LENGTHS = {name: length for name, _, _, length in ARM_BOUNDS}
CONTIG_LENGTHS.update({"chrX": 156040895, "chrY": 57227415})

# Pseudo-autosomal regions, shared ones first, then the contig's last one.
_SHARED_PAR = [
    (1000, 44821),
    (94821, 133871),
    (222346, 226276),
    (226351, 1949345),
    (2132994, 2137388),
    (2137488, 2781479),
]
PAR_REGIONS = (
    [("chrX", s, e) for s, e in _SHARED_PAR]
    + [("chrX", 155701383, 156030895)]
    + [("chrY", s, e) for s, e in _SHARED_PAR]
    + [("chrY", 56887902, 57217415)]
)

# The 24 diploid allele types (I insertion, D deletion, lower case: two different ones).
ALLELE_TYPES = [
    "NN", "AA", "AC", "AG", "AT", "AI", "AD", "CC", "CG", "CT", "CI", "CD",
    "GG", "GT", "GI", "DG", "TT", "IT", "DT", "DD", "DI", "II", "dD", "iI",
]

# Genotype order of the probability vector.
GENOTYPES = ["0/0", "1/1", "0/1", "1/2"]

# Symbol order of the per-column profiles.
PROFILE5 = ["N", "A", "C", "G", "T"]
PROFILE14 = ["A", "C", "G", "T", "N", "DS", "IS", "a", "c", "g", "t", "n", "ds", "is"]
PROFILE38 = (
    ["A", "C", "G", "T", "N", "a", "c", "g", "t", "n"]
    + ["A+", "C+", "G+", "T+", "N+", "a+", "c+", "g+", "t+", "n+"]
    + ["A-", "C-", "G-", "T-", "N-", "a-", "c-", "g-", "t-", "n-"]
    + ["DS", "DE", "IS", "IE", "ds", "de", "is", "ie"]
)

# End-motif names in feature order (NCG first, then CGN).
NCG_MOTIFS = ["ACG", "TCG", "CCG", "GCG"]
CGN_MOTIFS = ["CGA", "CGT", "CGC", "CGG"]
END_MOTIFS = NCG_MOTIFS + CGN_MOTIFS

# Substitution classes.
BASES = ["A", "C", "G", "T"]
SBS6 = ["C_to_A", "C_to_G", "C_to_T", "T_to_A", "T_to_C", "T_to_G"]
SBS12 = [f"{ref}_to_{alt}" for ref in BASES for alt in BASES if alt != ref]


def with_context(changes: list[str]) -> list[str]:
    """Every change between every left and right flank."""
    return [f"{left}_{change}_{right}" for change in changes for left in BASES for right in BASES]


SBS_TYPES = {"sbs6": SBS6, "sbs12": SBS12, "sbs96": with_context(SBS6), "sbs192": with_context(SBS12)}

# Classes of the tissue-of-origin score, by position in the probability vector.
ORIGIN_CLASSES = {
    2: "lung_cancer",
    3: "gastric_cancer",
    4: "breast_cancer",
    5: "pancreatic_cancer",
    6: "ovarian_cancer",
    7: "bile_duct_cancer",
    8: "colorectal_cancer",
    9: "liver_cancer",
    10: "head_and_neck_cancer",
}

# Read flag bits.
FLAG_PAIRED, FLAG_PROPER_PAIR, FLAG_UNMAPPED, FLAG_MATE_UNMAPPED, FLAG_REVERSE = 1, 2, 4, 8, 16
FLAG_READ2, FLAG_SECONDARY, FLAG_QCFAIL, FLAG_DUPLICATE, FLAG_SUPPLEMENTARY = 128, 256, 512, 1024, 2048
