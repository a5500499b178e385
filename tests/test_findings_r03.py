"""Findings of the third round: each of these failed before."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from fragx import catalog

SMALL = "/root/testdata/sf0.001"


def test_haploid_calls_of_any_id_lie_outside_the_shared_regions(spark, tmp_path):
    from check_oracle import compare

    folder = str(tmp_path)
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").withColumn("vec_id", F.col("vec_id") + 1000)
    rows.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    name = "call_variants_haploid"
    n, verdict, _ = compare(spark, con, folder, name, catalog.queries()[name], catalog.oracles()[name])
    assert n > 0 and verdict == "ok"


def test_consensus_by_place_equals_the_consensus_of_each_window(spark):
    from fragx.catalog import pileup as C
    from fragx.operators import columns as L, stacks as T

    aligned = C.aligned(spark, SMALL).withColumn("seq", F.regexp_replace("seq", "^(.{20}).", "$1N")).localCheckpoint()
    windows = T.site_windows(C.loci(spark, SMALL), C.chunks(spark, SMALL), 16, 17).localCheckpoint()
    pairs = T.reads_around_sites(windows, aligned, ["rid", "qname", "flag", "mapq", "seq", "qual"])
    rows = T.stack_rows(pairs, ["site"]).localCheckpoint()
    consensus, events = T.fragment_consensus(rows, ["site"]), T.fragment_events(rows, ["site"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # fragments cross batches
    try:
        counts = L.place_counts(aligned).localCheckpoint()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    summed = lambda df, *by: {tuple(r) for r in df.groupBy(*by).agg(F.sum("n")).collect()}
    got = summed(L.symbol_rows(counts, windows, ["site"]), "site", "offset", "symbol")
    assert got and got == summed(T.base_profile(consensus, events, ["site"]), "site", "offset", "symbol")
    seen = L.around_sites(counts.filter("kind = 'base'"), windows)
    by = ["site", "offset", "base", "strand"]
    want = consensus.groupBy(*by).agg(F.count("*"), F.sum("bq"), F.sum("mapq"), F.min("fragment"), F.max("fragment"))
    assert {tuple(r) for r in seen.select(*by, "n", "bq_sum", "mapq_sum", "first_fragment", "last_fragment").collect()} == {tuple(r) for r in want.collect()}


def test_the_number_of_sites_does_not_multiply_the_rows_of_reads(spark):
    for name in ("base_profile5", "fragment_consensus"):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        # the reads are counted by place before any join with windows
        assert "MapInArrow" in plan


def _by_hand(spark):
    import random

    rng = random.Random(5)
    spans = [(c, s, s + rng.randrange(0, 60)) for c in "ab" for s in (rng.randrange(0, 400) for _ in range(60))]
    regions = [(i, rng.choice("abc"), s, s + rng.randrange(0, 200)) for i, s in enumerate(rng.randrange(0, 420) for _ in range(40))]
    return (spans, regions, spark.createDataFrame(spans, "contig string, pos5 long, pos3 long"),
            spark.createDataFrame(regions, "id int, contig string, st long, en long"))


def test_depth_and_steps_of_regions_by_hand_and_without_pairs_of_fragments(spark):
    from fragx.operators import endmotif as E

    spans, regions, s, r = _by_hand(spark)
    depth = E.region_depth(r.filter("en > st"), s, ["contig"], "id", width=64)
    over = lambda c, a, b: sum(max(0, min(b, y) - max(a, x)) for k, x, y in spans if k == c)
    assert {tuple(x) for x in depth.collect()} == {(i, over(c, a, b) / (b - a)) for i, c, a, b in regions if b > a}
    # fragments are summed by block; no join matches them with regions
    assert "_bucket" not in depth._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for i, c, a, b in regions:
        near = [(max(a, x), min(b, y)) for k, x, y in spans if k == c and y > x and x < b and a < y]
        at = sorted({p for q in near for p in q})
        want |= {(i, p, q, n) for p, q in zip(at, at[1:]) if (n := sum(x <= p < y for x, y in near))}
    assert {tuple(x) for x in E.coverage_steps(r, s, ["contig"], "id", block=64).collect()} == want
