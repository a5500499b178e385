"""Candidate sites, read stacks, a caller-supplied model, and variant records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fragx.operators import calling as C, intervals as I, pileup as P, stacks as T
from fragx.operators.modeling import map_batches
from fragx.session import materialize


def candidates(
    reads: DataFrame, chunks: DataFrame, regions: DataFrame | None = None, keys: list[str] | None = None,
    min_depth: int = 4, snp_af: float = 0.08, indel_af: float = 0.08, **pileup,
) -> DataFrame:
    """Candidate positions, inside ``regions`` when given; reads outside them are dropped before the pileup."""
    if regions is not None:
        spans = reads.withColumn("_re", F.col("pos") + T.ref_span("cigar"))
        reads = I.in_regions(spans, regions, ["contig"], span=("pos", "_re")).drop("_re")
    sites = P.candidate_sites(P.pileup_counts(reads, chunks, keys, **pileup), min_depth, snp_af, indel_af)
    return sites if regions is None else I.in_regions(sites, regions, ["contig"], pos="pos")


def call_from_reads(
    reads: DataFrame, chunks: DataFrame, predict: Callable, regions: DataFrame | None = None, flank: int = 16,
    max_seqs: int | None = None, haploid: list[str] | None = None, keys: list[str] | None = None,
    **options,
) -> DataFrame:
    """Variant records: ``predict`` maps a pandas frame of examples to 24 probabilities per site.

    ``keys`` (the sample) keep the reads of many samples apart in one run and
    lead the rows that ``predict`` gets and returns.
    """
    by = list(keys or [])
    found = materialize(candidates(reads, chunks, regions, by, **options))
    site, place = [*by, "contig", "pos"], [*by, "contig", "locus"]
    windows = T.site_windows(found.select(*site), chunks, flank, flank + 1, pos="pos")
    # The site position is carried under its own name: the reads have a ``pos`` of their own.
    windows = materialize(windows.withColumnRenamed("pos", "locus"))
    pairs = T.reads_around_sites(windows, reads, ["rid", "qname", "flag", "mapq", "seq", "qual"], keys=by)
    rows = materialize(T.stack_rows(pairs, place))
    examples = T.site_examples(
        T.fragment_consensus(rows, place), T.fragment_events(rows, place), windows, place, 2 * flank + 1, max_seqs,
    )
    types = dict(windows.dtypes)
    scored = map_batches(examples, predict, ", ".join(f"{c} {types[c]}" for c in place) + ", probs array<double>")
    sites = found.join(scored.withColumnRenamed("locus", "pos"), site)
    return C.call_variants(sites, haploid=haploid, keys=by)
