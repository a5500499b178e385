"""Operators against brute force and hand-made examples, with skewed inputs where skew matters."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fragx.operators import bins, cna, genome, intervals, methylation, metrics, ordering, pileup, reads, shaping, stacks, variants
from fragx.operators.skew import salted_join


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_intervals(rng, n, span=3000, longest=400):
    st = rng.integers(0, span, n)
    return [(f"c{int(rng.integers(0, 2))}", int(s), int(s + 1 + rng.integers(0, longest)), i) for i, s in enumerate(st)]


@pytest.mark.parametrize("side", ["left", "right"])
def test_overlap_join_with_hot_bucket(spark, side):
    rng = np.random.default_rng(1)
    a, b = random_intervals(rng, 60), random_intervals(rng, 40)
    b += [("c0", 100, 120, 1000)] * 50  # exact copies in one bucket
    left = spark.createDataFrame(a, "g string, ls bigint, le bigint, lid int")
    right = spark.createDataFrame(b, "g string, rs bigint, re bigint, rid int")
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    got = intervals.interval_overlap_join(
        left, right, ["g"], ("ls", "le"), ("rs", "re"), width=500, hot_rows=5, hot_side=side
    )
    assert rows(got.select("lid", "rid")) == want


def test_point_joins_with_hot_bucket(spark):
    rng = np.random.default_rng(2)
    regions = random_intervals(rng, 30)
    points = [("c0", 777, i) for i in range(300)] + [("c1", int(p), 1000 + i) for i, p in enumerate(rng.integers(0, 3500, 100))]
    p = spark.createDataFrame(points, "g string, pos bigint, pid int")
    r = spark.createDataFrame(regions, "g string, st bigint, en bigint, id int")
    hit = [(q[2], x[3]) for q in points for x in regions if q[0] == x[0] and x[1] <= q[1] < x[2]]
    got = intervals.point_in_interval_join(p, r, ["g"], width=400, hot_rows=20)
    assert rows(got.select("pid", "id")) == sorted(hit)
    inside = {h[0] for h in hit}
    semi = intervals.in_regions(p, r, ["g"], pos="pos", width=400, hot_rows=20)
    anti = intervals.in_regions(p, r, ["g"], pos="pos", negate=True, width=400, hot_rows=20)
    assert {x.pid for x in semi.collect()} == inside and semi.count() == len(inside)
    assert {x.pid for x in anti.collect()} == {q[2] for q in points} - inside


def test_interval_membership_keeps_copies(spark):
    rng = np.random.default_rng(3)
    regions, probes = random_intervals(rng, 25), random_intervals(rng, 40) * 2
    d = spark.createDataFrame(probes, "g string, a bigint, b bigint, id int")
    r = spark.createDataFrame(regions, "g string, st bigint, en bigint, x int")
    hit = lambda q: any(q[0] == x[0] and q[1] < x[2] and x[1] < q[2] for x in regions)
    yes = intervals.in_regions(d, r.drop("x"), ["g"], span=("a", "b"), width=300, hot_rows=4)
    no = intervals.in_regions(d, r.drop("x"), ["g"], span=("a", "b"), width=300, hot_rows=4, negate=True)
    assert rows(yes) == sorted(q for q in probes if hit(q))
    assert rows(no) == sorted(q for q in probes if not hit(q))


def test_merge_intervals(spark):
    rng = np.random.default_rng(4)
    data = random_intervals(rng, 80, span=20000)
    want = []
    for g in ("c0", "c1"):
        cur = None
        for s, e in sorted((s - 7, e + 7) for c, s, e, _ in data if c == g):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                want.append((g, cur))
    df = spark.createDataFrame(data, "g string, st bigint, en bigint, id int")
    got = intervals.merge_intervals(df, ["g"], padding=7, width=1000)
    assert rows(got) == sorted((g, s, e) for g, (s, e) in want)


def test_salted_join_left_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, i) for i in range(40)] + [(2, 99)], "k int, v int")
    right = spark.createDataFrame([(1, "a")], "k int, w string")
    got = salted_join(left, right, ["k"], None, "left", hot_rows=3)
    assert got.count() == 41 and got.filter("w is null").count() == 1


def test_running_totals_with_ties_and_hot_group(spark):
    data = [("a", i // 7, i) for i in range(200)] + [("b", 5, 1000), ("b", 1, 2000)]
    df = spark.createDataFrame(data, "g string, o int, v int")
    got = ordering.running_totals(df, {"t": "v"}, [F.col("o"), F.col("v")], ["g"], slices=7)
    pdf = pd.DataFrame(data, columns=["g", "o", "v"]).sort_values(["g", "o", "v"])
    pdf["t"] = pdf.groupby("g")["v"].cumsum()
    assert rows(got) == sorted(pdf.itertuples(index=False, name=None))
    numbered = ordering.row_numbers(df, [F.col("o"), F.col("v")], slices=5)
    assert sorted(r.rn for r in numbered.collect()) == list(range(1, 203))


def greedy(snps):
    out, i = [], 0
    ordered = sorted(snps)
    while i < len(ordered) - 1:
        a, b = ordered[i], ordered[i + 1]
        if a[0] == b[0] and b[1] == a[1] + 1:
            out.append((a[0], a[1], a[2] + b[2], a[3] + b[3]))
            i += 2
        else:
            i += 1
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_pair_adjacent_equals_greedy_loop(spark, seed):
    rng = np.random.default_rng(seed)
    snps = [("c%d" % rng.integers(0, 2), int(p), "ACGT"[rng.integers(4)], "ACGT"[rng.integers(4)]) for p in rng.integers(0, 120, 150)]
    snps = sorted(set(snps))
    df = spark.createDataFrame(snps, "contig string, pos bigint, ref string, alt string")
    assert rows(variants.pair_adjacent(df, ["contig"], ["ref", "alt"], width=16)) == greedy(snps)


def test_pair_adjacent_runs(spark):
    for length, pairs in ((2, 1), (3, 1), (4, 2), (5, 2)):
        df = spark.createDataFrame([("c", 10 + i, "A", "C") for i in range(length)], "contig string, pos bigint, ref string, alt string")
        assert variants.pair_adjacent(df, ["contig"], ["ref"], width=3).count() == pairs


def test_pair_mates(spark):
    data = [
        ("q1", 0, 99, 10, 5), ("q1/2", 1, 147, 30, 5),  # Watson, name endings removed
        ("q2", 2, 163, 50, 5), ("q2", 3, 83, 60, 5),  # Crick
        ("q3", 4, 99, 10, 5),  # alone
        ("q4", 5, 99, 90, 5), ("q4", 6, 163, 95, 5),  # no strand
        ("q5", 7, 99, 1, 5), ("q5", 8, 147, 3, 5), ("q5", 9, 99, 7, 5), ("q5", 10, 147, 9, 5), ("q5", 11, 99, 20, 5),
    ]
    df = spark.createDataFrame([("c", *d) for d in data], "contig string, qname string, rid int, flag int, pos int, qlen int")
    got = rows(reads.pair_mates(df, ["contig"]).select("pos5", "pos3", "strand"))
    assert got == [(1, 8, "W"), (7, 14, "W"), (10, 35, "W"), (50, 65, "C")]


def naive_lowess(y, x, frac, passes):
    n, k = len(x), int(frac * len(x))
    w = np.ones(n)
    for step in range(passes + 1):
        fit = np.empty(n)
        for i in range(n):
            d = np.abs(x - x[i])
            r = np.sort(d)[k - 1]
            t = np.where(d < r, (1 - (d / r) ** 3) ** 3, 0) * w
            m = (t * x).sum() / t.sum()
            s = (t * (x - m) ** 2).sum() / t.sum()
            fit[i] = (t * y).sum() / t.sum() + ((t * y * (x - m)).sum() / t.sum() / s) * (x[i] - m)
        res = np.abs(y - fit)
        u = res / (6 * np.median(res))
        w = np.where(u < 1, (1 - u**2) ** 2, 0)
    return fit


def test_gc_correct_equals_rowwise_fit(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(0.3, 0.7, 120), 2)
    y = 100 + 200 * (x - 0.5) ** 2 + rng.normal(0, 3, 120)
    y[7] = 400
    assert np.allclose(cna._lowess(y, x, 0.5, 3), naive_lowess(y, x, 0.5, 3))
    pdf = pd.DataFrame({"sample_id": "s", "reads": y, "gc": x, "ideal": True})
    pdf.loc[0, "ideal"] = False
    got = cna.gc_correct(spark.createDataFrame(pdf)).toPandas()
    fit = naive_lowess(y[1:], x[1:], 0.5, 3)
    want = dict(zip(np.round(y[1:], 6), y[1:] / (fit / np.median(fit))))
    for r in got.itertuples():
        if r.ideal:
            assert abs(want[round(r.reads, 6)] - r.corrected) < 1e-6
        else:
            assert np.isnan(r.corrected)


def test_panel_counts_missing_keys(spark):
    df = spark.createDataFrame([("a", "k1", 2.0), ("b", "k1", 4.0), ("c", "k2", 3.0)], "s string, key string, share double")
    got = {r.key: (r.mean, r.std) for r in cna.build_panel(df, "s", ["key"]).collect()}
    for key, values in (("k1", [2.0, 4.0, 1e-10]), ("k2", [1e-10, 1e-10, 3.0])):
        assert np.allclose(got[key], (np.mean(values), np.std(values, ddof=1)))


def test_expand_alignment_clips_to_window(spark):
    df = spark.createDataFrame(
        [(1, 10, "2S3M1I2M2D2M", "SSACGTTACC", list(range(10)), 11, 18, "CGNNNNN")],
        "rid int, pos bigint, cigar string, seq string, qual array<int>, ws bigint, we bigint, ref string",
    )
    got = [(r.kind, r.ref_pos, r.base, r.bq, r.event) for r in reads.expand_alignment(df, ["rid"], window=("ws", "we"), ref="ref").collect()]
    assert sorted(got, key=lambda r: (r[1], r[0])) == [
        ("base", 11, "C", 3.0, None), ("base", 12, "G", 4.0, None), ("base", 13, "T", 6.0, None), ("ins", 13, "G", 5.0, "T"),
        ("base", 14, "A", 7.0, None), ("del", 15, "A", 8.0, "NN"), ("del_base", 15, "-", 8.0, None), ("del_base", 16, "-", 8.0, None),
        ("base", 17, "C", 8.0, None),
    ]
    # An insertion before any kept base is ignored.
    early = df.withColumn("ws", F.lit(13)).withColumn("ref", F.lit("TANNN"))
    kinds = [r.kind for r in reads.expand_alignment(early, ["rid"], window=("ws", "we"), ref="ref").collect()]
    assert "ins" not in kinds and "del" in kinds


def test_fragment_consensus_rules(spark):
    data = [
        ("f1", 0, True, 60, 0, "A", 30.0), ("f1", 1, False, 50, 0, "C", 30.0),  # tie: later read
        ("f2", 2, True, 20, 0, "A", 30.0), ("f2", 3, False, 40, 0, "C", 20.0),  # better quality
        ("f3", 4, False, 20, 0, "N", 30.0), ("f3", 5, False, 40, 0, "C", 10.0),  # unclear gives way
        ("f4", 6, False, 20, 0, "G", 10.0), ("f4", 7, True, 40, 0, "N", 30.0),  # unclear wins on quality
        ("f5", 8, False, 33, 0, "T", 10.0),
    ]
    df = spark.createDataFrame(
        [("s", *d, 1, "base", None) for d in data],
        "site string, fragment string, ord int, forward boolean, mapq int, offset int, base string, bq double, size int, kind string, event string",
    )
    got = {r.fragment: (r.base, r.bq, r.mapq, r.strand) for r in stacks.fragment_consensus(df, ["site"]).collect()}
    assert got == {
        "f1": ("C", 30.0, 60, 2), "f2": ("A", 30.0, 40, 2), "f3": ("C", 10.0, 40, 2), "f4": ("N", 30.0, 40, 2), "f5": ("T", 10.0, 33, 1),
    }


def test_cap_depth(spark):
    df = spark.createDataFrame([("s", f"f{i:03d}", i) for i in range(300)] + [("t", "x", 1)], "site string, fragment string, ord int")
    first = stacks.cap_depth(df, ["site"], 5)
    assert {r.fragment for r in first.filter("site = 's'").collect()} == {f"f{i:03d}" for i in range(5)}
    a, b = (rows(stacks.cap_depth(df, ["site"], 5, seed=3)) for _ in range(2))
    assert a == b and len(a) == 6


def test_dense_bins(spark):
    counts = spark.createDataFrame([("a", 20, 2), ("a", 50, 5), ("b", 0, 1)], "c string, start bigint, reads bigint")
    got = rows(bins.dense_bins(counts, ["c"], 10))
    assert got == [("a", s, s + 10, {20: 2, 50: 5}.get(s, 0)) for s in range(0, 60, 10)] + [("b", 0, 10, 1)]
    lengths = spark.createDataFrame([("a", 35), ("b", 20), ("d", 11)], "c string, len bigint")
    got = rows(bins.dense_bins(counts, ["c"], 10, lengths))
    assert got == (
        [("a", s, s + 10, {20: 2}.get(s, 0)) for s in range(0, 40, 10)] + [("b", 0, 10, 1), ("b", 10, 20, 0)]
        + [("d", 0, 10, 0), ("d", 10, 20, 0)]
    )


def test_methylation_features_of_many_samples(spark):
    sites = spark.createDataFrame(
        [("chr1", 5, 0.5, "a,b"), ("chr1", 7, 0.1, "a"), ("chr1", 25, 0.0, "a")],
        "chr string, position bigint, reference double, group string",
    )
    calls = spark.createDataFrame(
        [("x", "chr1", 5, 0.9, 1), ("x", "chr1", 5, 0.2, 2), ("x", "chr1", 7, None, 3), ("x", "chr1", 99, 1.0, 4), ("y", "chr1", 25, 0.4, 5)],
        "s string, chr string, position bigint, probability double, ord int",
    )
    got = {(r.s, r.feature): round(r.value, 9) for r in methylation.methylation_features(sites, calls, "ord", 10, samples=["s"]).collect()}
    assert got == {
        ("x", "a_chr1:0-10"): 0.4, ("x", "b_chr1:0-10"): 0.4, ("x", "a_chr1:20-30"): -1.0,
        ("y", "a_chr1:0-10"): -1.0, ("y", "b_chr1:0-10"): -1.0, ("y", "a_chr1:20-30"): 0.4,
    }
    plain = {r.feature: r.value for r in methylation.methylation_features(sites, calls.filter("s = 'y'"), "ord", 10, calibrate=False, fill=-9.0).collect()}
    assert plain == {"a_chr1:0-10": -9.0, "b_chr1:0-10": -9.0, "a_chr1:20-30": 0.4}


def test_auc_edge_cases(spark):
    df = spark.createDataFrame([("x", 1, 0.9), ("x", 0, 0.9), ("x", 1, 0.2), ("y", 1, 0.5)], "g string, y int, s double")
    got = {r.g: r.auc for r in metrics.auc(df, "s", "y", ["g"]).collect()}
    assert got == {"x": 0.25, "y": 0.0}
    sens = metrics.sensitivity_at_specificity(df.filter("g = 'x'"), "s", "y", 0.98).first()
    assert (sens.sensitivity, sens.specificity, sens.threshold) == (0.0, 1.0, float("inf"))
    weighted = df.withColumn("w", F.lit(2.0))
    assert {r.g: r.auc for r in metrics.auc(weighted, "s", "y", ["g"], weight="w").collect()} == got


def test_blend_and_shards(spark):
    a = spark.range(30).select(F.col("id"), F.lit("a").alias("src"))
    b = spark.range(10).select(F.col("id"), F.lit("b").alias("src"))
    out = shaping.blend(spark, [a, b], [1.0, 9.0], [F.col("id")], num_samples=2000, seed=1)
    again = shaping.blend(spark, [a, b], [1.0, 9.0], [F.col("id")], num_samples=2000, seed=1)
    assert rows(out) == rows(again) and out.count() == 2000
    share = out.filter("src = 'b'").count() / 2000
    assert abs(share - 90 / 120) < 0.05
    ids = spark.range(10)
    sizes = {r.shard: r.n for r in shaping.shard_contiguous(ids, [F.col("id")], 4).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 3, 1: 3, 2: 2, 3: 2}
    few = shaping.shard_strided(spark.range(2), [F.col("id")], 7, pad=True)
    assert sorted(r.shard for r in few.collect()) == list(range(7))
    assert shaping.shard_strided(ids, [F.col("id")], 4, drop_last=True).count() == 8


def test_candidate_pairs_stay_near_the_hits(spark):
    """150-base reads at high depth against dense sites: buckets of read width meet at most three times the hits."""
    from fragx.functions.common import floor_div

    rng = random.Random(5)
    spans = [(i, "c", p, p + 150) for i, p in enumerate(rng.randrange(0, 20_000) for _ in range(4000))]
    sites = [(i, "c", p) for i, p in enumerate(range(0, 20_000, 40))]
    r = spark.createDataFrame(spans, "rid int, contig string, st long, en long")
    s = spark.createDataFrame(sites, "sid int, contig string, pos long")
    hits = intervals.point_in_interval_join(s, r, ["contig"], width=intervals.READ_WIDTH).count()
    assert hits == sum(st <= p < en for _, _, st, en in spans for _, _, p in sites)
    buckets = r.select(F.explode(F.sequence(floor_div("st", intervals.READ_WIDTH), floor_div(F.col("en") - 1, intervals.READ_WIDTH))).alias("b"))
    candidates = buckets.join(s.select(floor_div("pos", intervals.READ_WIDTH).alias("b")), "b").count()
    assert candidates <= 3 * hits
    assert intervals.point_in_interval_join(s, r, ["contig"]).count() == hits


def test_names_with_many_reads_pair_two_by_two(spark):
    data = [(i, "q", "c", 100 + 10 * i, 99 if i % 2 == 0 else 147, 50) for i in range(5)] + [(9, "r", "c", 5, 99, 50)]
    frame = spark.createDataFrame(data, "rid int, qname string, contig string, pos long, flag int, qlen int")
    got = sorted((r.pos5, r.pos3) for r in reads.pair_mates(frame, ["contig"]).collect())
    assert got == [(100, 160), (120, 180)]


def test_duplicates_of_two_files_with_equal_ids(spark):
    data = [(0, s, "c", 100, f"{k}S{90 - k}M", 0, [q] * 90) for s, k, q in (("a", 0, 20), ("b", 5, 30))]
    data += [(1, "a", "c", 105, "5S85M", 0, [30] * 90), (2, "a", "c", 100, "85M5S", 16, [30] * 90), (3, "a", "c", 110, "80M", 16, [10] * 80)]
    frame = spark.createDataFrame(data, "rid int, sample_id string, contig string, pos long, cigar string, flag int, qual array<int>")
    keyed = reads.duplicate_keys(frame)
    marked = reads.mark_duplicates(keyed, ["sample_id", "contig", "five_prime", "reverse"], "quality_sum").collect()
    assert sorted((r.sample_id, r.rid, r.five_prime, r.quality_sum, r.is_duplicate) for r in marked) == [
        ("a", 0, 100, 1800, True), ("a", 1, 100, 2700, False), ("a", 2, 189, 2700, False), ("a", 3, 189, 0, True), ("b", 0, 95, 2700, False),
    ]


def test_long_deletions_are_spelled_over_chunks(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("ACGT") for _ in range(200))
    chunks = genome.chunk_genome(spark.createDataFrame([("c", text)], "contig string, seq string"), 20, 5)
    read = text[10:30] + text[95:115]
    data = [(i, f"q{i}", 0, "c", 10, 60, "20M65D20M", read, [30] * 40) for i in range(3)]
    frame = spark.createDataFrame(data, "rid int, qname string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual array<int>")
    at = {r.pos: r for r in pileup.pileup_counts(frame, chunks, chunk=20, overlap=5).collect()}
    assert at[29].alt_bases["-" + text[29 : 29 + 66]] == 3
    wide = genome.ref_window(spark.createDataFrame([("c", 100)], "contig string, pos long"), chunks, 50, 40, chunk=20, overlap=5).first()
    assert wide.window == text[50:140]
