"""Readers and writers on small text files with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from fragx.sources import bed, fasta, maf, panels, records, sam, vcf, wig


def write(path, text):
    path.write_text(text)
    return str(path)


def test_sam(spark, tmp_path):
    path = write(
        tmp_path / "a.sam",
        "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100\n"
        "q1\t99\tchr1\t11\t60\t5M\t=\t31\t25\tACGTA\tIIII!\tNM:i:1\tXA:Z:a:b\n"
        "q2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n",
    )
    a, b = sam.read_sam(spark, path).orderBy("rid").collect()
    assert (a.qname, a.flag, a.contig, a.pos, a.mapq, a.cigar) == ("q1", 99, "chr1", 10, 60, "5M")
    assert (a.mate_contig, a.mate_pos, a.tlen, a.seq, a.nm, a.qlen) == ("chr1", 30, 25, "ACGTA", 1, 5)
    assert a.qual == [40, 40, 40, 40, 0] and a.tags["XA"] == "a:b"
    assert b.contig is None and b.cigar is None and b.seq is None and b.qual is None and b.nm is None


def test_fasta_round_trip(spark, tmp_path):
    path = write(tmp_path / "a.fa", '>s1 first {"k": 1}\nACGT\n\n# note\nAC\n>s2\nTT\n>s1\nGG\n>s1\nCC\n')
    rows = fasta.read_fasta(spark, path).orderBy("ord")
    got = [(r.id, r.description, r.seq) for r in rows.collect()]
    assert got == [("s1", 'first {"k": 1}', "ACGTAC"), ("s2", "", "TT"), ("s10", "", "GG"), ("s11", "", "CC")]
    meta = rows.select(F.get_json_object(fasta.json_description(), "$.k").alias("k")).first().k
    assert meta == "1"
    out = str(tmp_path / "out")
    fasta.write_fasta(rows.limit(1), out, description="description", width=4)
    assert [r.value for r in spark.read.text(out).collect()] == ['>s1 first {"k": 1}', "ACGT", "AC"]


def test_vcf_round_trip(spark, tmp_path):
    text = (
        "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n"
        "chr2\t5\t.\tA\tC,G\t90.5\tPASS\tIM=M;DB\tGT:DP\t2/1:12\n"
        "chr1\t7\trs1\tAT\tA\t.\tLowQual;x\t.\tGT\t./.\n"
    )
    rows = {r.contig: r for r in vcf.read_vcf(spark, write(tmp_path / "a.vcf", text)).collect()}
    two, one = rows["chr2"], rows["chr1"]
    assert (two.pos, two.alleles, two.qual, two.filt, two.gt_a, two.gt_b) == (4, ["A", "C", "G"], 90.5, "PASS", 1, 2)
    assert two.info["IM"] == "M" and two.samples[0]["DP"] == "12"
    assert one.qual is None and one.filt == "LowQual" and one.gt_a is None and one.id == "rs1" and one.info is None
    records_ = spark.createDataFrame(
        [("chr10", 4, ["A", "C"], 9.5, "PASS", "0/1", [3, 4]), ("chr2", 0, ["G", "T"], 1.0, "LowQual", "1/1", [0, 2])],
        "contig string, pos bigint, alleles array<string>, qual double, filt string, GT string, AD array<int>",
    )
    out = str(tmp_path / "v")
    vcf.write_vcf(records_, out, vcf.vcf_header({"chr2": 9, "chr10": 9}, ["s"], {"LowQual": "low"}), ["GT", "AD"], partitions=2)
    lines = [r.value for r in spark.read.text(f"{out}/records").collect()]
    assert sorted(lines) == sorted(
        ["chr2\t1\t.\tG\tT\t1.0\tLowQual\t.\tGT:AD\t1/1:0,2", "chr10\t5\t.\tA\tC\t9.5\tPASS\t.\tGT:AD\t0/1:3,4"]
    )
    head = [r.value for r in spark.read.text(f"{out}/header").collect()]
    assert head[0] == "##fileformat=VCFv4.2" and head[-1].endswith("FORMAT\ts")
    both = vcf.read_vcf(spark, [f"{out}/header", f"{out}/records"])
    assert both.count() == 2


def test_bed(spark, tmp_path):
    path = write(tmp_path / "a.bed", "#chrom start end name kind\ntrack x\n1 5 9 n1 k1\nchr2\t7\t7\tn2\tk2\n\n")
    assert bed.header_fields(spark, path) == ["name", "kind"]
    got = [tuple(r) for r in bed.read_bed(spark, path, columns=["name", "kind"]).orderBy("contig").collect()]
    assert got == [("chr1", 5, 9, "n1", "k1"), ("chr2", 7, 8, "n2", "k2")]
    assert bed.read_bed(spark, path, contigs=["chr2"]).first().other == ["n2", "k2"]
    with pytest.raises(Exception, match="invalid region"):
        bed.read_bed(spark, write(tmp_path / "b.bed", "chr1 9 5\n")).collect()


def test_wig(spark, tmp_path):
    text = (
        "track type=wiggle_0\nfixedStep chrom=chr1 start=1 step=10 span=10\n1\n-1\n0.5\n"
        "variableStep chrom=chr2 span=5\n3 7\n20 2.5\nfixedStep chrom=chr3 start=5 step=2\n4\n"
    )
    got = [tuple(r) for r in wig.read_wig(spark, write(tmp_path / "a.wig", text)).orderBy("chrom", "start").collect()]
    assert got == [
        ("chr1", 0, 10, 1.0), ("chr1", 10, 20, -1.0), ("chr1", 20, 30, 0.5), ("chr2", 2, 7, 7.0), ("chr2", 19, 24, 2.5),
        ("chr3", 4, 5, 4.0),
    ]
    with pytest.raises(Exception, match="data without header"):
        wig.read_wig(spark, write(tmp_path / "b.wig", "1\n2\n")).collect()
    bins = spark.createDataFrame([("chr1", 0, 4), ("chr1", 20, 5), ("chr2", 10, 1)], "contig string, start bigint, reads bigint")
    blocks = wig.wig_lines(bins, 10)
    assert {r.chrom: r.value for r in blocks.collect()} == {
        "chr1": "fixedStep chrom=chr1 start=1 step=10 span=10\n4\n0\n5",
        "chr2": "fixedStep chrom=chr2 start=1 step=10 span=10\n0\n1",
    }
    out = str(tmp_path / "w")
    wig.write_wig(blocks, out)
    back = [tuple(r) for r in wig.read_wig(spark, out + "/*.txt").filter("value > 0").orderBy("chrom", "start").collect()]
    assert back == [("chr1", 0, 10, 4.0), ("chr1", 20, 30, 5.0), ("chr2", 10, 20, 1.0)]
    counts = spark.createDataFrame([("chr1", 9, 2), ("chr1", 2, 1)], "contig string, start bigint, n bigint")
    assert wig.variable_lines(counts, 5).first().value == "variableStep chrom=chr1 span=5\n3 1\n10 2"


def test_maf(spark, tmp_path):
    names = "\t".join(maf.COLUMNS)
    rows = [
        ["p1", "1", "GRCh38", "11", "15", "ACGTA", "-", "DEL", "x", "G1", "7"],
        ["p1", "chr2", "GRCh37", "21", "22", "-", "TT", "INS", "y", "G2", "8"],
        ["p2", "MT", "GRCh38", "1", "1", "A", "C", "SNP", "z", "G3", "9"],
    ]
    path = write(tmp_path / "a.maf", "#version\n" + names + "\n" + "\n".join("\t".join(r) for r in rows) + "\n")
    got = {r.chr: r for r in maf.read_maf(spark, path, max_len=3).collect()}
    assert set(got) == {"chr1", "chr2"}
    assert (got["chr1"].ref_start, got["chr1"].ref_end, got["chr1"].ref_seq, got["chr1"].id) == (10, 13, "ACG", "p1-chr1-10")
    assert (got["chr2"].ref_start, got["chr2"].ref_end, got["chr2"].var_seq) == (20, 21, "TT")
    assert maf.read_maf(spark, path, sample_ids=["p2"]).count() == 0


def test_panels(spark, tmp_path):
    doc = {"arm": {"mean": {"chr1p": 1.5}, "std": {"chr1p": 0.5}}, "bin": {"mean": {"chr1:0-10": 2.0}, "std": {}}}
    path = write(tmp_path / "p.json", json.dumps(doc, indent=1))
    table = panels.panel_to_table(spark, path)
    assert sorted(tuple(r) for r in table.collect()) == [("arm", "chr1p", 1.5, 0.5), ("bin", "chr1:0-10", 2.0, None)]
    back = json.loads(panels.table_to_panel(table.fillna(0.0)).first().value)
    assert back["arm"] == doc["arm"] and back["bin"]["std"] == {"chr1:0-10": 0.0}
    scores = spark.createDataFrame([("s", "arm", "a", 1.0), ("s", "bin", "b", 2.0), ("s", "bin", "a", 3.0)], "sample_id string, level string, key string, z double")
    assert json.loads(panels.scores_to_json(scores).first().value) == {"arm": {"a": 1.0}, "bin": {"b": 2.0, "a": 3.0}}
    path = write(tmp_path / "z.json", json.dumps({"arm": {"a": 1.0}, "bin": {"b": 2.0}}))
    assert sorted(tuple(r)[1:] for r in panels.scores_to_table(spark, path).collect()) == [("arm", "a", 1.0), ("bin", "b", 2.0)]
    assert {r.feature: r.value for r in panels.cnv_features(scores, ["sample_id"]).collect()} == {"a": 1.0, "b": 2.0}


def test_records(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1, 2.0), ("s2", 3, 4.0)], "sample_id string, a int, b double")
    for kind in ("json", "csv", "parquet"):
        out = f"{tmp_path}/by_{kind}"
        records.write_by_sample(df, out, kind=kind)
        one = spark.read.format(kind).load(f"{out}/sample_id=s1")
        assert one.count() == 1
    records.write_jsonl(df, f"{tmp_path}/r.jsonl")
    assert records.read_jsonl(spark, f"{tmp_path}/r.jsonl", df.schema).count() == 2
    df.coalesce(1).write.option("header", True).csv(f"{tmp_path}/r.csv")
    assert records.read_samples(spark, f"{tmp_path}/r.csv", ["b", "none"]).columns == ["b"]
    with pytest.raises(ValueError):
        records.read_samples(spark, "x.bin")
    reads = spark.createDataFrame([("chr1", 5), ("chr1", 9_000_000), ("chr2", 7)], "contig string, pos bigint")
    records.write_by_contig(reads, f"{tmp_path}/reads")
    assert spark.read.parquet(f"{tmp_path}/reads").filter("contig = 'chr1'").count() == 2
    write(tmp_path / "methylation_sites.tsv", "chr\tposition\treference\tgroup\nchr1\t5\t0.5\ta,b\n")
    assert tuple(records.load_site_table(spark, str(tmp_path), "methylation_sites").first()) == ("chr1", 5, 0.5, "a,b")
