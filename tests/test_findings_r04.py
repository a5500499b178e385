"""Findings of the fourth round: each of these failed before."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragx.catalog import pileup as C

READ = "rid long, qname string, contig string, pos long, mapq int, flag int, cigar string, tlen int, seq string, qual array<int>"


def read(rid, pos, cigar, seq, qname=None, contig="c", flag=0, qual=None, mapq=60):
    return rid, qname or f"q{rid}", contig, pos, mapq, flag, cigar, 100, seq, qual or [30] * len(seq)


def test_a_core_is_thirty_two_bases_to_both_sides_of_every_site(spark, monkeypatch):
    sites = spark.createDataFrame([("c:100", "c", 100), ("c:5", "c", 5)], "site string, contig string, locus long")
    starts = {1: 66, 2: 67, 3: 68, 4: 132, 5: 133, 6: 36, 7: 38}
    rows = [read(i, p, "2M", "AC") for i, p in starts.items()]
    reads = spark.createDataFrame([*rows, read(8, 60, "5M60D5M", "ACGTACGTAC"), read(9, 60, "5M30N5M", "ACGTACGTAC")], READ)
    monkeypatch.setattr(C, "loci", lambda *a: sites)
    monkeypatch.setattr(C, "aligned", lambda *a: reads)
    got = {tuple(r) for r in C.touches_core_window(spark, "").collect()}
    shown = {i: range(p, p + 2) for i, p in starts.items()} | {8: [*range(60, 65), *range(125, 130)], 9: [*range(60, 65), *range(95, 100)]}
    want = {(f"c:{x}", f"q{i}") for x in (100, 5) for i, spots in shown.items() if any(x - 31 <= p < x + 33 for p in spots)}
    assert got == want and {("c:100", "q3"), ("c:100", "q4"), ("c:5", "q6")} <= got and ("c:100", "q1") not in got


def _random_stacks(spark):
    """Reads of every kind of operation, names that repeat or are missing, and windows that lie close together."""
    import random

    rng = random.Random(11)
    rows = []
    for i in range(400):
        ops = rng.choice(["20M", "4S12M", "8M2D9M", "6M3I8M", "7M30N9M", "5M1I1D6M", "3M2N2D5M", "2I9M", "9M4D", "5M6I", "40D3M", "3=2X4M", "0M9M", "11H6M", "*"])
        size = sum(int(n) for n, op in __import__("re").findall(r"(\d+)([MIDNSHP=X])", ops) if op in "M=XIS")
        seq = "".join(rng.choice("ACGTNACGTacR") for _ in range(size))
        name = rng.choice([f"q{i // 2}", f"q{i // 2}", f"q{i // 2}", "often", None])
        rows.append((i, name, rng.choice("ab"), rng.randrange(0, 170), rng.choice([None, 5, 60]), rng.choice([0, 16, 0, 16, 4]), ops, 100, seq,
                     [rng.choice([0, 10, 30, 30, 41]) for _ in seq]))
    reads = spark.createDataFrame(rows, READ).localCheckpoint()
    places = [(c, w) for c in "ab" for w in sorted(rng.sample(range(0, 170), 60))]
    windows = spark.createDataFrame(
        [(f"{c}:{w}", c, w, w + rng.choice([11, 11, 11, 7]), "".join(rng.choice("ACGTN") for _ in range(11))) for c, w in places],
        "site string, contig string, ws long, we long, ref_seq string")
    windows = windows.withColumn("ref_seq", F.expr("substring(ref_seq, 1, int(we - ws))")).localCheckpoint()
    return reads, windows


def _both_ways(spark, reads, windows):
    from fragx.operators import stacks as T

    pairs = T.reads_around_sites(windows, reads, ["rid", "qname", "flag", "mapq", "seq", "qual"])
    rows = T.stack_rows(pairs, ["site"]).localCheckpoint()
    return T.fragment_consensus(rows, ["site"]).localCheckpoint(), T.fragment_events(rows, ["site"]).localCheckpoint()


def _same(got, want):
    rows = lambda df: sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())
    found = rows(got)
    assert found and found == rows(want)


def test_profiles_and_consensus_of_a_walk_equal_those_of_all_rows(spark):
    from fragx.operators import stacks as T, walks as W

    reads, windows = _random_stacks(spark)
    consensus, _ = _both_ways(spark, reads, windows)
    column = F.col("offset") + 1
    named = reads.filter("qname is not null").localCheckpoint()  # the plain profile joins indels by name
    profile = T.base_profile(*_both_ways(spark, named, windows), ["site"]).localCheckpoint()
    sums = consensus.groupBy("site", "base", "strand").agg(
        F.count("*").alias("n"), F.sum(F.col("bq") * column).alias("bq_sum"), F.sum(F.col("mapq") * column).cast("long").alias("mapq_sum"),
        F.min("fragment").alias("first_fragment"), F.max("fragment").alias("last_fragment"))
    for records, width in ((7, 32), (10_000, 2048)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))  # fragments and buckets cross batches
        try:
            _same(W.site_symbols(windows, named, ["site"], 11, width=width), profile)
            totals = profile.groupBy("site", "symbol").agg(F.sum("n").alias("n"), F.sum(F.col("n") * column).alias("weighted"))
            _same(W.site_symbols(windows, named, ["site"], 11, total=True, width=width), totals)
            _same(W.site_base_counts(windows, reads, ["site"], 11, width=width), T.base_profile5(consensus, windows, ["site"]))
            _same(W.site_consensus_sums(windows, reads, ["site"], 11, width=width), sums)
            _same(W.site_profiles(windows, named, ["site"], 11, width=width), T.profile_arrays(profile, ["site"], 11, T.K.PROFILE38))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_walk_takes_large_missing_and_half_qualities(spark):
    from fragx.operators import stacks as T, walks as W

    reads, windows = _random_stacks(spark)
    odd = reads.withColumn("qual", F.expr("transform(qual, (q, i) -> CASE WHEN i % 5 = 0 THEN 300 ELSE q + rid % 2 * 0.5D END)"))
    odd = odd.filter("cigar not like '%D%' and qname is not null").localCheckpoint()
    consensus, events = _both_ways(spark, odd, windows)
    _same(W.site_symbols(windows, odd, ["site"], 11, width=64), T.base_profile(consensus, events, ["site"]))


def test_profiles_shuffle_reads_once_and_nothing_behind_the_walk(spark):
    from fragx import catalog

    for name in ("base_profile5", "base_profile14", "base_profile38", "fragment_consensus"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan.splitlines()[0]


def test_base_profile5_tells_every_column(spark):
    from fragx import catalog

    found = catalog.queries()["base_profile5"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["site", "offset", "n_n", "n_a", "n_c", "n_g", "n_t"]
    assert [tuple(r) for r in found.groupBy("site").count().select("count").distinct().collect()] == [(33,)]
