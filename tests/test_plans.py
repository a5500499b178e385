"""Whole analyses on a small made-up sample, streaming against batch, and the registry."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fragx import catalog
from fragx.constants import ALLELE_TYPES, SBS_TYPES
from fragx.operators import bins, calling, genome, modeling
from fragx.plans import copy_number, end_motif, methylation, variant_calling
from fragx.streaming import incremental

REF = "ACGTTGCATCGGATCCATGCAAGTCTAGCCGATTACGGCTAACGTGCATTGCCAGTCAGGCTTACGATCGTTAGC" * 3


@pytest.fixture(scope="module")
def sample(spark):
    """20 read pairs over one contig; half of them carry another base at position 60."""
    data = []
    for i in range(20):
        for mate, pos in enumerate((30 + i % 4, 50 + i % 4)):
            seq = list(REF[pos : pos + 40])
            if i % 2 and pos <= 60 < pos + 40:
                seq[60 - pos] = "A" if REF[60] != "A" else "C"
            flag = (99, 147)[mate]
            data.append((2 * i + mate, f"q{i}", flag, "chr1", pos, 60, "40M", 60, "".join(seq), [30] * 40, 40, 0))
    reads = spark.createDataFrame(
        data,
        "rid bigint, qname string, flag int, contig string, pos bigint, mapq int, cigar string, tlen int, seq string, "
        "qual array<int>, qlen int, nm int",
    )
    chunks = genome.chunk_genome(spark.createDataFrame([("chr1", REF)], "contig string, seq string"))
    return reads, chunks


def test_variant_calling(spark, sample):
    reads, chunks = sample
    alt = "A" if REF[60] != "A" else "C"
    kind = "".join(sorted(REF[60] + alt))

    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        probs = np.full(24, 0.1 / 23)
        probs[ALLELE_TYPES.index(kind)] = 0.9
        assert all(len(t) == 13 for t in batch["tokens"])
        return batch[["contig", "locus"]].assign(probs=[probs] * len(batch))

    got = variant_calling.call_from_reads(reads, chunks, predict, flank=8, max_seqs=12).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.contig, r.pos, r.GT, r.filt, r.alleles, r.DP) == ("chr1", 60, "0/1", "PASS", [REF[60], alt], 40)
    assert r.AD == [20, 20] and r.AF == [0.5] and r.qual == 90.0
    regions = spark.createDataFrame([("chr1", 0, 50)], "contig string, st bigint, en bigint")
    assert variant_calling.candidates(reads, chunks, regions).count() == 0


def test_methylation_calls(spark, sample):
    reads, chunks = sample
    c = REF.index("C", 45)
    sites = spark.createDataFrame([("chr1", c), ("chr1", 2)], "contig string, locus bigint")

    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["contig", "locus"]].assign(logits=[np.array([0.0, np.log(3.0)])] * len(batch))

    got = methylation.call_methylation(reads, sites, chunks, predict, flank=20, max_seqs=6, max_len=30).collect()
    assert [(r.chr, r.position, round(r.probability, 6), r.depth) for r in got] == [("chr1", c, 0.75, 20)]


def test_many_samples_in_one_run_equal_single_runs(spark, sample):
    reads, chunks = sample
    other = reads.filter("rid % 4 < 2").withColumn("mapq", F.lit(50))  # fewer reads, the same ids and names
    both = reads.withColumn("sample_id", F.lit("a")).unionByName(other.withColumn("sample_id", F.lit("b")))
    c = REF.index("C", 45)
    sites = spark.createDataFrame([("chr1", c), ("chr1", 2)], "contig string, locus bigint")

    def logits(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [np.array([0.0, float(len(t))]) for t in batch["tokens"]]
        return batch[[x for x in ("sample_id", "contig", "locus") if x in batch]].assign(logits=rows)

    def probs(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [np.full(24, 1 / 24)] * len(batch)
        return batch[[x for x in ("sample_id", "contig", "locus") if x in batch]].assign(probs=rows)

    options = {"flank": 20, "max_len": 30}
    one = {(n, *r) for n, part in (("a", reads), ("b", other)) for r in methylation.call_methylation(part, sites, chunks, logits, **options).collect()}
    many = methylation.call_methylation(both, sites, chunks, logits, keys=["sample_id"], **options).collect()
    assert {tuple(r) for r in many} == one and len(one) == 2
    text = lambda n, r: (n, r.contig, r.pos, r.DP, str(r.alleles), str(r.AD), r.GT)
    one = {text(n, r) for n, part in (("a", reads), ("b", other)) for r in variant_calling.call_from_reads(part, chunks, probs, flank=8).collect()}
    many = variant_calling.call_from_reads(both, chunks, probs, flank=8, keys=["sample_id"]).collect()
    assert {text(r.sample_id, r) for r in many} == one and one


def test_end_motif_counts_equal_fragments_once(spark, sample):
    reads, _ = sample
    regions = spark.createDataFrame(
        [(1, "chr1", 26, 38, "ACG", "CGT", "hyper", "lung,liver")],
        "rid_ int, contig string, st bigint, en bigint, ncg string, cgn string, typ string, cancer string",
    )
    got = {r.feature: r.value for r in end_motif.end_motif(reads, regions, "rid_").collect()}
    # Four distinct fragments start at 30..33: offsets 4 to 7 of the region.
    assert abs(got["cle_lung_chr1_hyper_4"] - 1 / (1 + 4 + 1e-8)) < 1e-6
    assert abs(got["end_liver_chr1_hyper_ACG"] - 1 / 4) < 1e-6 and abs(got["ratio_lung_chr1_hyper"] - 1) < 1e-6
    assert len(got) == 2 * (12 + 8 + 1)
    by_sample = end_motif.end_motif(reads.withColumn("s", F.lit("x")), regions, "rid_", samples=["s"])
    assert {r.feature: r.value for r in by_sample.collect()} == got


def test_copy_number_flat_samples(spark):
    data = [(s, "chr1", b * 1_000_000, (b + 1) * 1_000_000, 100 + (b * 7 + k) % 5) for k, s in enumerate("abc") for b in range(40)]
    counts = spark.createDataFrame(data, "sample_id string, contig string, start bigint, end bigint, reads bigint")
    arms = spark.createDataFrame([("chr1", 18_000_000, 20_000_000)], "contig string, p_end bigint, q_start bigint")
    places = counts.select("contig", "start").distinct()
    gc = places.withColumn("gc", 0.3 + (F.col("start") / 1_000_000 % 20) / 100)
    z = copy_number.copy_number(counts, arms, gc, places.withColumn("map", F.lit(1.0)))
    out = z.toPandas()
    assert set(out["level"]) == {"arm", "bin"} and len(out) == 3 * 42
    assert out.groupby(["level", "key"])["z"].sum().abs().max() < 1e-6


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.range(500).select(F.concat(F.lit("chr"), (F.col("id") % 3).cast("string")).alias("contig"), (F.col("id") * 37 % 1000).alias("pos"))
    df.repartition(4).write.parquet(source)
    stream = incremental.read_stream(spark, source, df.schema, files_per_batch=1)
    incremental.stream_bin_counts(stream, ["contig"], 100, f"{tmp_path}/out", f"{tmp_path}/state")
    got = incremental.latest_counts(spark, f"{tmp_path}/out", ["contig", "start"])
    want = bins.bin_counts(df, ["contig"], 100)
    assert sorted(map(tuple, got.select("contig", "start", "reads").collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() == 4


def test_predicted_indels_choose_the_allele(spark):
    probs = [0.0] * 24
    probs[ALLELE_TYPES.index("II")] = 1.0
    df = spark.createDataFrame(
        [("A", {"A": 2, "+ACC": 5, "+AGT": 3}, probs, ["+AG"])],
        "ref_base string, alt_bases map<string,bigint>, probs array<double>, pred array<string>",
    )
    assert calling.resolve_alleles(df).first()["call"]["alleles"] == ["A", "ACC"]
    assert calling.resolve_alleles(df, predicted="pred").first()["call"]["alleles"] == ["A", "AGT"]
    # A heterozygous type is skipped on a haploid site.
    probs2 = [0.0] * 24
    probs2[ALLELE_TYPES.index("AI")], probs2[ALLELE_TYPES.index("II")] = 0.7, 0.3
    d2 = spark.createDataFrame([("A", {"A": 2, "+ACC": 5}, probs2)], "ref_base string, alt_bases map<string,bigint>, probs array<double>")
    assert calling.resolve_alleles(d2).first()["call"]["gt"] == "0/1"
    assert calling.resolve_alleles(d2, diploid=F.lit(False)).first()["call"]["gt"] == "1/1"


def test_group_apply(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "k string, v int")
    out = modeling.group_apply(df, ["k"], lambda p: p.groupby("k", as_index=False)["v"].max(), "k string, v int")
    assert sorted(map(tuple, out.collect())) == [("a", 3), ("b", 5)]


def test_shuffle_is_a_repeatable_permutation(spark):
    from fragx.operators.ordering import shuffle_rows

    first, again = ([r.id for r in shuffle_rows(spark.range(100), "id", 5).collect()] for _ in range(2))
    assert first == again and sorted(first) == list(range(100)) and first != list(range(100))


def test_tree_models(spark):
    data = [(i, int(i % 10 == 0), [float(i % 10 == 0), float(i % 3)]) for i in range(200)]
    df = spark.createDataFrame(data, "id int, label int, features array<double>")
    for model in (
        modeling.fit_classifier(df, numTrees=4, maxDepth=2, seed=1),
        modeling.grid_search(df, {"numTrees": [3, 4]}, folds=2).bestModel,
    ):
        scored = modeling.predict_classes(model, df).collect()
        assert sum((r.probs[1] > 0.5) == (r.label == 1) for r in scored) >= 195
        assert all(abs(sum(r.probs) - 1) < 1e-9 for r in scored)


def test_scoring_reports(spark):
    from fragx.plans.scoring import reports, score_samples

    features = spark.createDataFrame([("x", "age", 50.0), ("x", "f", 2.0), ("y", "g", 1.0)], "sample_id string, feature string, value double")

    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        assert [list(v) for v in batch["features"] if v[0]] in ([], [[50.0, 2.0]])
        return pd.DataFrame({"sample_id": batch["sample_id"], "probs": [np.array([0.25, 0.25, 0.5] + [0.0] * 8)] * len(batch)})

    short, origin = reports(score_samples(features, ["age", "f"], predict))
    assert sorted(tuple(r) for r in short.collect()) == [("x", 0.5, 0.5), ("y", 0.5, 0.5)]
    assert origin.columns[2] == "probability_lung_cancer" and origin.first().probability_lung_cancer == 0.5


def test_registry():
    assert {k: len(v) for k, v in SBS_TYPES.items()} == {"sbs6": 6, "sbs12": 12, "sbs96": 96, "sbs192": 192}
    assert len(ALLELE_TYPES) == 24
    assert set(catalog.oracles()) <= set(catalog.queries())


QUICK = [
    "dense_bin_share", "point_in_interval_join", "interval_overlap_join", "pair_mates", "coverage_profile",
    "methylation_features", "pair_adjacent", "resolve_alleles", "roc_curve", "feature_table", "pack_sequences", "base_coverage",
]


@pytest.mark.parametrize("name", QUICK)
def test_queries_match_sql(spark, name):
    """The quick part of tools/check_oracle.py, which compares every query."""
    import sys
    from pathlib import Path

    import duckdb

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
    from check_oracle import TABLES, compare

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    n, verdict, _ = compare(spark, con, sf_dir, name, catalog.queries()[name], catalog.oracles()[name])
    assert verdict == "ok" and n > 0
