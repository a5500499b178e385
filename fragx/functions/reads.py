"""Expressions over the flag, CIGAR and name of an aligned read."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fragx import constants as K
from fragx.functions.common import col

NO_CIGAR = 10_000_000_000


def has_flag(flag: Column | str, bits: int) -> Column:
    return col(flag).bitwiseAND(F.lit(bits)) != 0


def is_forward(flag: Column | str) -> Column:
    return ~has_flag(flag, K.FLAG_REVERSE)


def parse_cigar(cigar: Column | str) -> Column:
    """CIGAR text to ``array<struct<op,len>>``."""
    cigar = col(cigar)
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(ops, lengths, lambda op, n: F.struct(op.alias("op"), n.cast("int").alias("len")))


def mismatch_count(nm: Column | str, cigar: Column | str) -> Column:
    """The NM tag, or the bases in X, I and D operations, or a huge number without a CIGAR."""
    cigar = col(cigar)
    counted = F.aggregate(
        F.regexp_extract_all(cigar, F.lit(r"(\d+)[XID]"), F.lit(1)),
        F.lit(0).cast("long"),
        lambda acc, n: acc + n.cast("long"),
    )
    missing = cigar.isNull() | cigar.isin("", "*")
    return F.coalesce(col(nm).cast("long"), F.when(missing, F.lit(NO_CIGAR)).otherwise(counted))


def is_clipped(cigar: Column | str) -> Column:
    return col(cigar).rlike(r"^\d+[SH]|[SH]$")


def is_autosome(contig: Column | str) -> Column:
    return col(contig).rlike(r"^chr[0-9]+$")


def passes_qc(flag: Column | str, mapq: Column | str, min_mapq: int = 30) -> Column:
    bits = (
        K.FLAG_UNMAPPED | K.FLAG_SECONDARY | K.FLAG_QCFAIL | K.FLAG_DUPLICATE | K.FLAG_SUPPLEMENTARY
    )
    return ~has_flag(flag, bits) & (col(mapq) >= min_mapq)


def passes_flag_mask(flag: Column | str, mask: int = 2316) -> Column:
    return ~has_flag(flag, mask)


def fragment_length_ok(tlen: Column | str, low: int = 20, high: int = 600) -> Column:
    return F.abs(col(tlen)).between(low, high)


def reject_reason(
    flag="flag", mapq="mapq", nm="nm", cigar="cigar", contig="contig",
    min_mapq: int = 30, max_mismatch: int = 2, filter_clip: bool = True,
) -> Column:
    """The first failing check, in a fixed order; null for a read that is kept."""
    unpaired = has_flag(flag, K.FLAG_UNMAPPED | K.FLAG_MATE_UNMAPPED) | ~has_flag(flag, K.FLAG_PAIRED)
    technical = has_flag(
        flag, K.FLAG_QCFAIL | K.FLAG_SECONDARY | K.FLAG_DUPLICATE | K.FLAG_SUPPLEMENTARY
    )
    reason = (
        F.when(unpaired, "unmapped_or_unpaired")
        .when(technical, "qc_secondary_duplicate_supplementary")
        .when(col(mapq) < min_mapq, "low_mapq")
        .when(mismatch_count(nm, cigar) > max_mismatch, "mismatches")
        .when(~is_autosome(contig), "non_autosome")
    )
    return reason.when(is_clipped(cigar), "read_clip") if filter_clip else reason


def strand_of_pair(flag1: Column | str, flag2: Column | str) -> Column:
    """W for flags 99 with 147, C for 83 with 163, otherwise null."""
    low, high = F.least(col(flag1), col(flag2)), F.greatest(col(flag1), col(flag2))
    return F.when((low == 99) & (high == 147), "W").when((low == 83) & (high == 163), "C")


def base_name(qname: Column | str) -> Column:
    return F.regexp_replace(col(qname), r"/[12]$", "")
