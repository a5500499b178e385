"""Reads to end-motif features."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fragx.operators import endmotif as E
from fragx.operators.reads import pair_mates, usable_reads
from fragx.session import materialize


def end_motif(
    reads: DataFrame, regions: DataFrame, region_id: str, length: int = 12, samples: list[str] | None = None,
    min_mapq: int = 30, **reject,
) -> DataFrame:
    """Filter, pair, cover the regions and derive the features (feature, value) of every sample.

    The change points of the covered regions serve both the profiles and the
    motif counters, so they are computed once.
    """
    keys = [*(samples or []), "contig"]
    fragments = pair_mates(usable_reads(reads, min_mapq=min_mapq, **reject), keys)
    runs = materialize(E.coverage_runs(regions, fragments, ["contig"], region_id, samples))
    groups = E.with_groups(regions)
    return E.end_motif_features(
        E.profile_by_group(runs, groups, region_id, length, samples), E.end_motifs(runs, groups, region_id, samples), samples
    )
