"""Files written by the writers and read back by the readers, compared with the tables they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fragx.catalog.bins import COUNTS
from fragx.catalog.registry import register
from fragx.fixtures import table
from fragx.operators import bins as B
from fragx.operators.genome import chunks_of_lines
from fragx.operators.reads import qc_reads
from fragx.session import ensure_checkpoint_dir
from fragx.sources import bed, chain, fasta, layout, maf, panels, records, sam, vcf, wig


def folder(spark, name):
    """A new place in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register(
    "sam_round_trip",
    """SELECT qname, flag, contig, pos, mapq, cigar, tlen, seq, CAST(list_sum(qual) AS BIGINT) AS qual_sum, CAST(rid AS VARCHAR) AS rid_tag FROM aligned""",
)
def sam_round_trip(spark, sf_dir):
    path = folder(spark, "sam")
    sam.write_sam(table(spark, sf_dir, "aligned"), path, tags={"XR": "rid"})
    back = sam.read_sam(spark, path)
    total = F.aggregate("qual", F.lit(0).cast("long"), lambda a, q: a + q)
    return back.select("qname", "flag", "contig", "pos", "mapq", "cigar", "tlen", "seq", total.alias("qual_sum"), sam.tag("XR").alias("rid_tag"))


@register("fasta_round_trip", "SELECT contig, seq FROM genome")
def fasta_round_trip(spark, sf_dir):
    path = folder(spark, "fasta")
    fasta.write_fasta(table(spark, sf_dir, "genome"), path, id="contig")
    return fasta.read_fasta(spark, path).select(F.col("id").alias("contig"), "seq")


@register(
    "genome_from_lines",
    """SELECT contig, CAST(k AS BIGINT) AS chunk_id, CAST(k * 1000 AS BIGINT) AS chunk_start, SUBSTRING(seq, CAST(k * 1000 + 1 AS INT), 1100) AS chunk_seq
    FROM (SELECT contig, seq, unnest(range(0, (LENGTH(seq) + 999) // 1000)) AS k FROM genome WHERE LENGTH(seq) > 0) g""",
)
def genome_from_lines(spark, sf_dir):
    path = folder(spark, "fasta")
    fasta.write_fasta(table(spark, sf_dir, "genome"), path, id="contig")
    return chunks_of_lines(fasta.read_fasta_lines(spark, path), 1000, 100)


@register(
    "vcf_round_trip", "SELECT contig, pos, ref, alt, filt, CAST(qual AS DOUBLE) AS qual, gt_a, gt_b FROM variants"
)
def vcf_round_trip(spark, sf_dir):
    path = folder(spark, "vcf")
    v = table(spark, sf_dir, "variants").withColumn("alleles", F.array("ref", "alt")).withColumn("GT", F.concat_ws("/", "gt_b", "gt_a"))
    vcf.write_vcf(v, path, vcf.vcf_header({"chr1": 1000}, ["s"]), ["GT"])
    back = vcf.read_vcf(spark, [f"{path}/header", f"{path}/records"])
    return back.select("contig", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "filt", "qual", "gt_a", "gt_b")


@register("bed_round_trip", "SELECT contig, st, en, CAST(site_id AS VARCHAR) AS site_id FROM sites")
def bed_round_trip(spark, sf_dir):
    path = folder(spark, "bed")
    bed.write_bed(table(spark, sf_dir, "sites"), path, ["site_id"])
    return bed.read_bed(spark, path, columns=["site_id"])


@register(
    "wig_round_trip",
    """SELECT contig AS chrom, start, start + 1000000 AS "end", CAST(SUM(reads) AS DOUBLE) AS value FROM dense GROUP BY contig, start""",
    COUNTS,
)
def wig_round_trip(spark, sf_dir):
    path = folder(spark, "wig")
    counts = B.bin_counts(qc_reads(table(spark, sf_dir, "reads")), ["contig"], 1_000_000)
    wig.write_wig(wig.wig_lines(counts, 1_000_000), path)
    return wig.read_wig(spark, f"{path}/part-*")


@register(
    "wig_variable_round_trip",
    """SELECT contig AS chrom, start, start + 1000000 AS "end", CAST(SUM(reads) AS DOUBLE) AS value FROM counted GROUP BY contig, start""",
    COUNTS,
)
def wig_variable_round_trip(spark, sf_dir):
    path = folder(spark, "wig")
    counts = B.bin_counts(qc_reads(table(spark, sf_dir, "reads")), ["contig"], 1_000_000)
    wig.write_wig(wig.variable_lines(counts, 1_000_000, value="reads"), path)
    return wig.read_wig(spark, f"{path}/part-*")


@register(
    "maf_round_trip",
    """SELECT CONCAT('t', CAST(pos % 7 AS VARCHAR), '-', contig, '-', CAST(pos AS VARCHAR)) AS id, CONCAT('t', CAST(pos % 7 AS VARCHAR)) AS sample_id,
     ref AS ref_seq, alt AS var_seq, pos AS ref_start, pos + CASE WHEN LENGTH(ref) < LENGTH(alt) THEN 1 ELSE LENGTH(ref) END AS ref_end,
     contig AS chr, CASE WHEN LENGTH(ref) < LENGTH(alt) THEN 'INS' WHEN LENGTH(ref) > LENGTH(alt) THEN 'DEL' ELSE 'SNP' END AS variant_type
    FROM variants WHERE contig IN (SELECT CONCAT('chr', CAST(i AS VARCHAR)) FROM range(1, 23) r(i))""",
)
def maf_round_trip(spark, sf_dir):
    path = folder(spark, "maf")
    v = table(spark, sf_dir, "variants")
    kind = F.when(F.length("ref") < F.length("alt"), "INS").when(F.length("ref") > F.length("alt"), "DEL").otherwise("SNP")
    rows = v.select(
        F.concat(F.lit("t"), (F.col("pos") % 7).cast("string")).alias("Tumor_Sample_Barcode"), F.substring("contig", 4, 9).alias("Chromosome"),
        F.lit("GRCh38").alias("NCBI_Build"), (F.col("pos") + 1).alias("Start_Position"), (F.col("pos") + F.length("ref")).alias("End_Position"),
        F.col("ref").alias("Reference_Allele"), F.col("alt").alias("Tumor_Seq_Allele2"), kind.alias("Variant_Type"), F.lit("x").alias("Variant_Classification"),
        F.lit("G").alias("Hugo_Symbol"), F.lit("1").alias("Entrez_Gene_Id"),
    )
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return maf.read_maf(spark, path).select("id", "sample_id", "ref_seq", "var_seq", "ref_start", "ref_end", "chr", "variant_type")


@register("jsonl_round_trip", "SELECT chr, position, probability, depth FROM calls")
def jsonl_round_trip(spark, sf_dir):
    path = folder(spark, "jsonl")
    calls = table(spark, sf_dir, "calls").select("chr", "position", "probability", "depth")
    records.write_jsonl(calls, path)
    return records.read_jsonl(spark, path, calls.schema)


@register("write_by_sample", "SELECT sample_id, rid, contig, pos FROM reads")
def write_by_sample(spark, sf_dir):
    path = folder(spark, "by-sample")
    records.write_by_sample(table(spark, sf_dir, "reads").select("sample_id", "rid", "contig", "pos"), path)
    return spark.read.schema("rid long, contig string, pos long, sample_id string").json(path)


@register("write_by_contig", "SELECT rid, pos, contig FROM reads")
def write_by_contig(spark, sf_dir):
    path = folder(spark, "by-contig")
    records.write_by_contig(table(spark, sf_dir, "reads").select("rid", "pos", "contig"), path)
    return spark.read.parquet(path)


@register("site_table", "SELECT contig AS chr, st AS position, reference, cancer AS \"group\" FROM cpg")
def site_table(spark, sf_dir):
    path = folder(spark, "sites")
    sites = table(spark, sf_dir, "cpg").select(F.col("contig").alias("chr"), F.col("st").alias("position"), "reference", F.col("cancer").alias("group"))
    sites.write.option("sep", "\t").option("header", True).csv(f"{path}/methylation_sites.tsv")
    return records.load_site_table(spark, path, "methylation_sites")


@register(
    "panel_round_trip",
    """SELECT 'bin' AS level, CONCAT(contig, ':', CAST(start AS VARCHAR)) AS key, ROUND(AVG(reads), 6) + 0.0 AS mean, CAST(COUNT(*) AS DOUBLE) AS std
      FROM counted GROUP BY contig, start
     UNION ALL SELECT 'arm', contig, ROUND(AVG(reads), 6) + 0.0, CAST(COUNT(*) AS DOUBLE) FROM counted GROUP BY contig""",
    COUNTS,
)
def panel_round_trip(spark, sf_dir):
    path = folder(spark, "panel")
    counts = B.bin_counts(qc_reads(table(spark, sf_dir, "reads")), ["sample_id", "contig"], 1_000_000)
    figures = F.round(F.avg("reads"), 6).alias("mean"), F.count(F.lit(1)).cast("double").alias("std")
    bins = counts.groupBy("contig", "start").agg(*figures).select(F.lit("bin").alias("level"), F.concat_ws(":", "contig", F.col("start").cast("string")).alias("key"), "mean", "std")
    arms = counts.groupBy("contig").agg(*figures).select(F.lit("arm").alias("level"), F.col("contig").alias("key"), "mean", "std")
    panels.table_to_panel(arms.unionByName(bins)).write.text(path)
    return panels.panel_to_table(spark, path)


BLOCKS = {
    "aligned_blocks": """SELECT CONCAT('chr', 1 + l_orderkey % 22) AS src_contig, CAST(1000 * (l_orderkey % 1000) + 200 * l_linenumber AS BIGINT) AS src_start,
      CAST(1000 * (l_orderkey % 1000) + 200 * l_linenumber + 20 + floor(l_quantity) AS BIGINT) AS src_end, CONCAT('new', 1 + l_orderkey % 7) AS tgt_contig,
      CAST(CASE WHEN l_orderkey % 2 = 0 THEN 5000 + 150 * l_linenumber ELSE 2000000 - 5020 - 150 * l_linenumber - floor(l_quantity) END AS BIGINT) AS tgt_start,
      CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(l_orderkey AS VARCHAR) AS chain
      FROM (SELECT l_orderkey, l_linenumber, MAX(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) l"""
}


@register("chain_round_trip", "SELECT src_contig, src_start, src_end, tgt_contig, tgt_start, strand, chain FROM aligned_blocks", BLOCKS)
def chain_round_trip(spark, sf_dir):
    key, at, n = F.col("l_orderkey"), F.col("l_linenumber"), F.floor("l_quantity")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    blocks = lines.select(
        F.concat(F.lit("chr"), 1 + key % 22).alias("src_contig"), (1000 * (key % 1000) + 200 * at).cast("long").alias("src_start"),
        (1000 * (key % 1000) + 200 * at + 20 + n).cast("long").alias("src_end"), F.concat(F.lit("new"), 1 + key % 7).alias("tgt_contig"),
        F.when(key % 2 == 0, 5000 + 150 * at).otherwise(2_000_000 - 5020 - 150 * at - n).cast("long").alias("tgt_start"),
        F.when(key % 2 == 0, "+").otherwise("-").alias("strand"), key.cast("string").alias("chain"),
    )
    size = F.lit(2_000_000).cast("long").alias("size")
    sizes = [blocks.select(F.col(c).alias("contig"), size).distinct() for c in ("src_contig", "tgt_contig")]
    path = folder(spark, "chain")
    chain.write_chain(blocks, *sizes, path)
    return chain.read_chain(spark, path).drop("block")


@register("fetch_clustered", "SELECT site_id, contig, st, en FROM sites WHERE contig = 'chr5' AND st < 12000000 AND en > 2000000")
def fetch_clustered(spark, sf_dir):
    path = folder(spark, "clustered")
    layout.write_clustered(table(spark, sf_dir, "sites").select("site_id", "contig", "st", "en"), path, files=48)
    return layout.fetch_clustered(spark, path, "chr5", 2_000_000, 12_000_000)
