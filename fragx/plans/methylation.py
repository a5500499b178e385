"""Sites and reads to methylation calls and features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from fragx.functions import probability as P
from fragx.operators import methylation as M, pileup as C, stacks as T
from fragx.operators.modeling import map_batches
from fragx.session import materialize


def call_methylation(
    reads: DataFrame, sites: DataFrame, chunks: DataFrame, predict: Callable, flank: int = 128, max_seqs: int | None = None,
    max_len: int = 256, min_bq: int = 15, min_depth: int = 3, seed: int = 42, keys: list[str] | None = None,
) -> DataFrame:
    """Call rows (chr, position, probability, depth) for the sites (contig, locus) that have enough reads.

    ``predict`` maps a pandas frame of examples to two logits per site. All
    fragments of a site reach it. ``keys`` (the sample) keep the reads of many
    samples apart in one run and lead the rows that ``predict`` gets and returns; with ``max_seqs`` an example has so many rows
    at most, the reference and ``max_seqs`` - 1 fragments.
    """
    named = sites.select(F.concat_ws(":", "contig", F.col("locus").cast("string")).alias("site"), "contig", "locus")
    by = list(keys or [])
    site = [*by, "contig", "locus"]
    covered = C.base_coverage(named, reads, "site", keys=by, min_bq=min_bq)
    if by:
        covered = covered.join(named, "site")
    chosen = M.select_candidates(covered, 1, min_depth)
    windows = materialize(T.site_windows(chosen.select(*site), chunks, flank - 1, flank + 1))
    pairs = T.reads_around_sites(windows, reads, ["rid", "qname", "flag", "mapq", "seq", "qual"], keys=by)
    rows = materialize(T.stack_rows(pairs, site))
    consensus = T.fragment_consensus(rows, site)
    examples = T.site_examples(
        consensus, T.fragment_events(rows, site), windows, site, 2 * flank,
        None if max_seqs is None else max_seqs - 1,
        max_len=max_len, seed=seed,
    )
    depth = consensus.groupBy(*site).agg(F.count_distinct("fragment").alias("depth"))
    types = dict(windows.dtypes)
    scored = map_batches(examples, predict, ", ".join(f"{c} {types[c]}" for c in site) + ", logits array<double>")
    joined = scored.join(depth, site).withColumn("probs", P.softmax("logits"))
    return M.methylation_calls(
        joined.select(*by, F.col("contig").alias("chr"), F.col("locus").alias("position"), "probs", "depth"),
        keys=(*by, "chr", "position"),
    )
