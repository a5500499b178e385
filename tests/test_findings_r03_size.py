"""Findings of the third round on size: the same rows as the plain operators, without a row per base or pair."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fragx import catalog
from fragx.catalog import pileup as C
from fragx.operators import columns as L, stacks as T

SMALL = "/root/testdata/sf0.001"


def same(a, b):
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    got = rows(a)
    assert got and got == rows(b)


@pytest.fixture(scope="module")
def stacked(spark):
    """Reads (some unmapped, mates that overlap), windows and the rows of the plain operators."""
    aligned = C.aligned(spark, SMALL).withColumn("flag", F.when(F.col("rid") % 41 == 0, F.col("flag") + 4).otherwise(F.col("flag")))
    aligned = aligned.withColumn("qname", F.when(F.col("rid") % 13 == 0, "twice").otherwise(F.col("qname"))).localCheckpoint()
    windows = T.site_windows(C.loci(spark, SMALL), C.chunks(spark, SMALL), 16, 17).localCheckpoint()
    pairs = T.reads_around_sites(windows, aligned, ["rid", "qname", "flag", "mapq", "seq", "qual"])
    return aligned, windows, T.stack_rows(pairs, ["site"]).localCheckpoint()


def test_first_fragments_equal_the_ranks_of_all_rows(spark, stacked):
    aligned, windows, rows = stacked
    for limit in (1, 3):
        want = T.cap_depth(T.fragment_consensus(rows, ["site"]), ["site"], limit).select("site", "fragment", "row").distinct()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # buckets cross batches
        try:
            got = L.first_fragments(windows, aligned, ["site"], limit, 33).localCheckpoint()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        same(got, want)


def test_cap_depth_makes_no_pairs_of_windows_and_reads(spark):
    plan = catalog.queries()["cap_depth"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ref_pos" not in plan


def test_window_texts_equal_those_of_all_pairs(spark, stacked):
    aligned, windows, _ = stacked
    wide = T.site_windows(C.loci(spark, SMALL), C.chunks(spark, SMALL), 63, 65).localCheckpoint()
    reads = aligned.withColumn("tlen", F.when(F.col("rid") % 17 == 0, 900).otherwise(F.col("tlen")))
    pairs = T.reads_around_sites(wide, reads, ["rid", "qname", "flag", "mapq", "seq", "qual", "tlen"])
    want = T.fragment_consensus_simple(pairs, ["site"], half_window=64, half_core=16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # fragments cross batches
    try:
        got = L.fragment_texts(wide, reads, ["site"], half_window=64, half_core=16).localCheckpoint()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same(got, want)


def test_events_and_cores_equal_those_of_all_rows(spark, stacked):
    aligned, windows, rows = stacked
    same(T.site_events(windows, aligned, ["site"]), T.fragment_events(rows, ["site"]))
    same(T.touched_cores(windows, aligned, ["site"], F.lit(16), 8), T.touches_core(rows, ["site"], F.lit(16), 8))


def test_events_texts_and_cores_make_no_row_per_base(spark):
    for name in ("insertion_track", "insertion_track_whole", "fragment_events", "touches_core_window", "fragment_consensus_simple"):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "ref_pos" not in plan and "del_base" not in plan


def test_lifts_through_blocks_that_overlap_by_hand_and_without_pairs(spark):
    import random

    from fragx.operators.liftover import first_blocks, lift_points, lift_ranges

    rng = random.Random(3)
    blocks = []
    for i in rng.sample(range(500), 120):
        s = rng.randrange(0, 900)
        blocks.append((rng.choice("ab"), s, s + rng.randrange(0, rng.choice((8, 400))), f"t{i % 3}", 5000 + 7 * i, rng.choice("+-"), i))
    chain = spark.createDataFrame(blocks, "src_contig string, src_start long, src_end long, tgt_contig string, tgt_start long, strand string, block long")

    def lift(c, p):
        for k, s, e, t, ts, strand, _ in sorted(blocks, key=lambda b: b[-1]):
            if k == c and s <= p < e:
                return t, ts + (p - s if strand == "+" else e - 1 - p), strand
        return None, None, None

    places = [(i, rng.choice("abc"), rng.randrange(0, 1300)) for i in range(600)]
    points = spark.createDataFrame([*places, (900, None, 5), (901, "a", None)], "id int, contig string, pos long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # buckets cross batches
    try:
        got = {tuple(r) for r in lift_points(points, chain, "id").collect()}
        spans = [(i, c, p, p + rng.randrange(0, 12)) for i, c, p in places]
        ranges = lift_ranges(spark.createDataFrame(spans, "id int, contig string, st long, en long"), chain, "id").collect()
        pieces = first_blocks(chain).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(i, c, p, *lift(c, p)) for i, c, p in places} | {(900, None, 5, None, None, None), (901, "a", None, None, None, None)}
    want = set()
    for i, c, s, e in spans:
        to = [lift(c, p)[1] for p in range(s, e)]
        whole = bool(to) and None not in to
        want.add((i, c, s, e, whole, min(to) if whole else None, max(to) if whole else None))
    assert {tuple(r) for r in ranges} == want
    held = [(r.src_contig, p) for r in pieces for p in range(r._ps, r._pe)]
    assert len(held) == len(set(held))


def test_first_examples_equal_those_of_all_rows(spark, stacked):
    aligned, windows, rows = stacked
    consensus, events = T.fragment_consensus(rows, ["site"]).localCheckpoint(), T.fragment_events(rows, ["site"])
    for limit, crop in ((2, 31), (8, None)):
        want = T.site_examples(consensus, events, windows, ["site"], 33, limit, max_len=crop)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # sites cross batches
        try:
            got = L.first_examples(windows, aligned, ["site"], 33, limit, max_len=crop).localCheckpoint()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        same(got, want)


def test_site_examples_makes_no_pairs_of_windows_and_bases(spark):
    plan = catalog.queries()["site_examples"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ref_pos" not in plan
