"""Chain files, the clustered layout, versioned state and grouped folds."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fragx.operators import metrics, modeling
from fragx.operators.liftover import lift_points
from fragx.sources import chain, layout
from fragx.streaming import state

TEXT = """# two chains
chain 4900 chr1 1000 + 100 190 chrA 500 + 10 95 7
30 10 5
20\t0\t10
30

chain 100 chr2 800 + 0 60 chrB 300 - 40 110 8
25 10 20
25
"""


def test_chain_text(spark, tmp_path):
    path = tmp_path / "a.chain"
    path.write_text(TEXT)
    got = sorted(tuple(r) for r in chain.read_chain(spark, str(path)).collect())
    assert got == [
        ("chr1", 100, 130, "chrA", 10, "+", 1, "7"), ("chr1", 140, 160, "chrA", 45, "+", 2, "7"), ("chr1", 160, 190, "chrA", 75, "+", 3, "7"),
        ("chr2", 0, 25, "chrB", 235, "-", 4, "8"), ("chr2", 35, 60, "chrB", 190, "-", 5, "8"),
    ]
    points = spark.createDataFrame([(1, "chr1", 145), (2, "chr1", 135), (3, "chr2", 0), (4, "chr2", 59)], "id int, contig string, pos long")
    lifted = {r.id: r.tgt_pos for r in lift_points(points, chain.read_chain(spark, str(path)), "id").collect()}
    assert lifted == {1: 50, 2: None, 3: 259, 4: 190}


def test_chain_split_over_tasks_and_written_back(spark, tmp_path):
    rng, rows = random.Random(5), []
    for name in range(40):
        strand, a, b = rng.choice("+-"), rng.randrange(1000), rng.randrange(1000)
        for _ in range(rng.randrange(1, 200)):
            n = rng.randrange(1, 90)
            rows.append((f"chr{name % 3}", a, a + n, f"new{name % 4}", b if strand == "+" else 100_000 - b - n, strand, f"{name:03d}"))
            a, b = a + n + rng.randrange(9), b + n + rng.randrange(9)
    blocks = spark.createDataFrame(rows, "src_contig string, src_start long, src_end long, tgt_contig string, tgt_start long, strand string, chain string")
    sizes = [spark.createDataFrame([(f"{p}{i}", 100_000) for i in range(4)], "contig string, size long") for p in ("chr", "new")]
    chain.write_chain(blocks, *sizes, f"{tmp_path}/out")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        back = chain.read_chain(spark, f"{tmp_path}/out").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((*r[:6], r.chain) for r in back) == sorted(rows)
    assert sorted(r.block for r in back) == list(range(1, len(rows) + 1))


def test_chain_errors(spark, tmp_path):
    (tmp_path / "bad").write_text("chain 1 a 9 + 0 5 b 9 + 0 5 1\nfive\n")
    with pytest.raises(Exception, match="invalid chain line"):
        chain.read_chain(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "none").write_text("# nothing\n")
    assert chain.read_chain(spark, str(tmp_path / "none")).count() == 0


def test_a_fetch_opens_few_files(spark, tmp_path):
    df = spark.range(20_000).select("id", F.concat(F.lit("chr"), F.col("id") % 2).alias("contig"), (F.col("id") * 7919 % 1_000_000).alias("st"))
    df = df.withColumn("en", F.col("st") + 100)
    layout.write_clustered(df, f"{tmp_path}/t", files=100)
    got = layout.fetch_clustered(spark, f"{tmp_path}/t", "chr1", 500_000, 510_000)
    want = df.filter("contig = 'chr1' AND st < 510000 AND en > 500000")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    assert len(got.inputFiles()) < 5
    assert layout.fetch_clustered(spark, f"{tmp_path}/t", "chr9").count() == 0


def test_versioned_state(spark, tmp_path):
    write, path, want, rng = state.versioned_sink(["k"], str(tmp_path), every=3), str(tmp_path), {}, random.Random(1)
    for batch in range(8):
        rows = [(k, batch * 10 + k) for k in rng.sample(range(12), 4)]
        want.update(rows)
        frame = spark.createDataFrame(rows, "k int, n int")
        for _ in range(1 + batch % 2):  # a batch that runs again changes nothing
            write(frame, batch)
        assert {r.k: r.n for r in state.read_versioned(spark, path, ["k"]).collect()} == want
    write(spark.createDataFrame([(0, -1)], "k int, n int"), 1)  # compacted long ago
    latest = state.read_versioned(spark, path, ["k"])
    assert {r.k: r.n for r in latest.collect()} == want
    assert not any("epoch=0" in f and "changes" in f for f in latest.inputFiles())


def test_folds_keep_groups_and_shares(spark):
    rng = random.Random(2)
    rows = [(g, int(g % 4 == 0), [float(g % 4 == 0) + rng.random(), rng.random()]) for g in range(120) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "g int, label int, features array<double>")
    split = modeling.grouped_folds(df, "g", "label", 4).collect()
    assert len(split) == len(rows) and all(len({r.fold for r in split if r.g == g}) == 1 for g in range(120))
    for label in (0, 1):
        sizes = [sum(r.fold == f and r.label == label for r in split) for f in range(4)]
        assert max(sizes) - min(sizes) <= 8
    held = modeling.cross_validate(df, "g", folds=3, numTrees=4, maxDepth=3, seed=1)
    called = held.withColumn("yhat", (F.col("probs")[1] > 0.5).cast("int"))
    per = metrics.class_metrics(metrics.confusion_matrix(called, "label", "yhat", 2, ["fold"]), ["fold"]).collect()
    assert len(per) == 6 and all(r.acc_global > 0.8 for r in per) and held.count() == len(rows)
