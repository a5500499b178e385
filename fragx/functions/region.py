"""Contig names and ploidy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fragx import constants as K
from fragx.functions.common import col


def normalize_contig(contig: Column | str) -> Column:
    contig = col(contig)
    return F.when(contig.startswith("chr"), contig).otherwise(F.concat(F.lit("chr"), contig))


def haploid_contigs(contigs: list[str]) -> list[str]:
    """X and Y are haploid when the assembly of the sample holds a Y contig."""
    return ["chrX", "chrY"] if {"chrY", "Y"} & set(contigs) else []


def in_par(contig: Column | str, pos: Column | str) -> Column:
    """Position inside a pseudo-autosomal region: a handful of constant ranges, so no join."""
    contig, pos = col(contig), col(pos)
    hit = F.lit(False)
    for name, start, end in K.PAR_REGIONS:
        hit = hit | ((contig == name) & (pos >= start) & (pos < end))
    return hit


def is_diploid(contig: Column | str, pos: Column | str, haploid: list[str]) -> Column:
    if not haploid:
        return F.lit(True)
    return ~col(contig).isin(*haploid) | in_par(contig, pos)
