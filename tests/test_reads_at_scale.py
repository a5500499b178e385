"""Pileups from differences, site arrays, pairing of names of any size and duplicates by both ends, against plain Python."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from fragx.operators import genome, pileup, reads

READ = "rid int, sample string, qname string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual array<int>, qlen int"


def random_reads(seed, text, n=150):
    """Reads with all CIGAR operations; a third of them at one place, bases sometimes changed or unclear."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ops = []
        for _ in range(rng.randrange(1, 7)):
            kind = rng.choice("MMMM=XIDNSHP")
            if ops and ops[-1][1] == kind:
                continue
            ops.append((rng.randrange(1, 12), kind))
        pos = 40 if i % 3 == 0 else rng.randrange(len(text) + 5)
        seq, at = [], pos
        for size, kind in ops:
            for _ in range(size):
                if kind in "M=X":
                    base = text[at] if at < len(text) else "A"
                    seq.append(rng.choice("ACGTNacgt") if rng.random() < 0.15 else base)
                elif kind in "IS":
                    seq.append(rng.choice("ACGT"))
                at += kind in "M=XDN"
        out.append((i, f"s{i % 2}", f"q{i // 2}", rng.choice([99, 147, 83, 163, 0, 16]), "c", pos, 60, "".join(f"{s}{k}" for s, k in ops), "".join(seq), [rng.randrange(40) for _ in seq], len(seq)))
    return out


def brute_pileup(rows, text, min_bq):
    counts, texts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)

    def add(pos, symbol, name, c=1, n=1):
        counts[pos][symbol] += c
        texts[pos][symbol, name] += n

    for r in rows:
        at, q, begun = r[5], 0, False
        for size, kind in ((int(n), k) for n, k in re.findall(r"(\d+)(\D)", r[7])):
            if kind in "ID" and begun:
                base = r[8][q - 1 : q].upper() if q else ""
                name = f"+{base}{r[8][q : q + size].upper()}" if kind == "I" else f"-{text[at - 1 : at + size].upper()}"
                add(at - 1, kind, name)
                add(at - 1, base, base, 0, -1)
            for k in range(size):
                if kind in "M=X" and r[9][q + k] >= min_bq:
                    base = r[8][q + k].upper()
                    add(at + k, base if base in "ACGT" else "O", base)
                elif kind in "DN":
                    add(at + k, "O", "*" if kind == "D" else ">")
            begun = begun or kind in "M=XD"
            at += size if kind in "M=XDN" else 0
            q += size if kind in "M=XIS" else 0
    out = {}
    for pos, found in counts.items():
        if 0 <= pos < len(text):
            alts = {name: n for (_, name), n in texts[pos].items() if n > 0}
            out[pos] = (text[pos].upper(), *[found[s] for s in "ACGTIDO"], sum(found.values()), alts)
    return out


@pytest.mark.parametrize("seed,min_bq", [(1, 0), (2, 12), (3, 0), (4, 25)])
def test_pileup_from_differences_equals_plain_counting(spark, seed, min_bq):
    rng = random.Random(seed)
    text = "".join(rng.choice("ACGTacgtN") for _ in range(230))
    rows = random_reads(seed, text)
    frame = spark.createDataFrame(rows, READ)
    chunks = genome.chunk_genome(spark.createDataFrame([("c", text)], "contig string, seq string"), 25, 6)
    got = pileup.pileup_counts(frame, chunks, min_bq=min_bq, chunk=25, overlap=6, proper_pairs=False, flag_mask=0)
    names = ["ref_base", "a", "c", "g", "t", "ins", "del", "other", "depth", "alt_bases"]
    assert {r.pos: tuple(r[n] for n in names) for r in got.collect()} == brute_pileup(rows, text, min_bq)
    # per sample as well
    by_sample = pileup.pileup_counts(frame, chunks, ["sample"], min_bq=min_bq, chunk=25, overlap=6, proper_pairs=False, flag_mask=0).collect()
    for s in ("s0", "s1"):
        assert {r.pos: tuple(r[n] for n in names) for r in by_sample if r["sample"] == s} == brute_pileup([r for r in rows if r[1] == s], text, min_bq)


def test_pileup_rows_are_differences_and_operations(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("ACGT") for _ in range(3000))
    rows, different, operations = [], 0, 0
    for i in range(200):
        pos = rng.randrange(2500)
        seq = list(text[pos : pos + 60] + text[pos + 62 : pos + 102])
        for at in rng.sample(range(100), i % 3):
            seq[at] = "A" if seq[at] != "A" else "C"
            different += 1
        operations += 3
        rows.append((i, "s", f"q{i}", 0, "c", pos, 60, "60M2D40M", "".join(seq), [30] * 100, 100))
    chunks = genome.chunk_genome(spark.createDataFrame([("c", text)], "contig string, seq string"))
    made = pileup.delta_rows(spark.createDataFrame(rows, READ), chunks, ["contig"]).count()
    assert made + 4 * 200 <= different + 4 * operations  # with the rows that meet their chunk: 3 stretches and an indel per read


@pytest.mark.parametrize("width", [8, 256])
def test_base_coverage_probes_site_arrays(spark, width):
    text = "".join(random.Random(3).choice("ACGT") for _ in range(230))
    rows = random_reads(3, text)
    sites = [(f"k{i}", "c", p) for i, p in enumerate([*range(0, 230, 3), 42, 42])] + [("far", "d", 4)]
    places = spark.createDataFrame(sites, "key string, contig string, locus long")
    want = {k: collections.Counter() for k, _, _ in sites}
    for key, contig, locus in sites:
        for r in rows:
            at, q = r[5], 0
            for size, kind in ((int(n), k) for n, k in re.findall(r"(\d+)(\D)", r[7])):
                if kind in "M=X" and at <= locus < at + size and contig == "c" and r[9][q + locus - at] >= 15:
                    want[key][r[8][q + locus - at].upper()] += 1
                at += size if kind in "M=XDN" else 0
                q += size if kind in "M=XIS" else 0
    got = pileup.base_coverage(places, spark.createDataFrame(rows, READ), "key", flag_mask=0, width=width).collect()
    assert {r.key: (r.a, r.c, r.g, r.t) for r in got} == {k: tuple(c[b] for b in "ACGT") for k, c in want.items()}
    by = pileup.base_coverage(places, spark.createDataFrame(rows, READ), "key", keys=["sample"], flag_mask=0, width=width)
    summed = by.groupBy("key").agg(*[F.sum(c).alias(c) for c in "acgt"]).collect()
    assert {r.key: (r.a, r.c, r.g, r.t) for r in summed} == {k: tuple(c[b] for b in "ACGT") for k, c in want.items() if sum(c[b] for b in "ACGT")}


def test_a_name_of_very_many_reads_pairs_in_slices(spark):
    hot, n = 2_000, 300_000  # three quarters of all reads share a name; its mates are 10 bases apart
    even = F.col("id") % 2 == 0
    many = spark.range(n).select(
        F.col("id").alias("rid"), F.lit("hot").alias("qname"), F.lit("c").alias("contig"), (F.col("id") * 10).alias("pos"),
        F.when(even, 99).otherwise(147).alias("flag"), F.lit(7).alias("qlen"),
    )
    few = spark.range(100_000).select(
        (F.col("id") + n).alias("rid"), F.concat(F.lit("n"), (F.col("id") / 2).cast("int").cast("string")).alias("qname"), F.lit("c").alias("contig"),
        F.col("id").alias("pos"), F.when(even, 83).otherwise(163).alias("flag"), F.lit(50).alias("qlen"),
    )
    both = many.unionByName(few)
    sliced, plain = reads.pair_mates(both, ["contig"], hot_rows=hot), reads.pair_mates(both, ["contig"], hot_rows=None)
    figures = [F.count(F.lit(1)), F.sum("pos5"), F.sum("pos3"), F.sum(F.xxhash64("pos5", "pos3", "strand").cast("decimal(38,0)")), F.count_if(F.col("strand") == "W")]
    got = sliced.agg(*figures).first()
    assert got == plain.agg(*figures).first() and got[-1] == n // 2
    assert sliced.filter("strand = 'W'").agg(F.max(F.col("pos3") - F.col("pos5"))).first()[0] == 17


def brute_templates(rows, with_score):
    """rid -> copy; ``rows`` as READ, one sample."""
    ends, names = {}, collections.defaultdict(list)
    for r in rows:
        if r[3] & 2308:
            continue
        ops = [(int(n), k) for n, k in re.findall(r"(\d+)(\D)", r[7])]
        span = sum(n for n, k in ops if k in "M=XDN")
        lead, tail = re.match(r"((?:\d+[SH])*)", r[7])[1], re.search(r"((?:\d+[SH])*)$", r[7])[1]
        clip = lambda t: sum(map(int, re.findall(r"\d+", t)))
        ends[r[0]] = (r[4], r[5] + span + clip(tail) - 1, True) if r[3] & 16 else (r[4], r[5] - clip(lead), False)
        names[r[2]].append(r[0])
    pairs = {q: sorted(ids, key=lambda i: (ends[i], i)) for q, ids in names.items() if len(ids) == 2}
    in_pair = {i for ids in pairs.values() for i in ids}
    copies, groups = set(), collections.defaultdict(list)
    for ids in pairs.values():
        groups[ends[ids[0]], ends[ids[1]]].append(ids)
    for group in groups.values():
        best = min(group, key=lambda ids: (-sum(with_score[i] for i in ids), min(ids)))
        copies |= {i for ids in group if ids is not best for i in ids}
    lone = collections.defaultdict(list)
    for i in ends:
        if i not in in_pair:
            lone[ends[i]].append(i)
    taken = {ends[i] for i in in_pair}
    for end, ids in lone.items():
        best = None if end in taken else min(ids, key=lambda i: (-with_score[i], i))
        copies |= {i for i in ids if i != best}
    return {r[0]: r[0] in copies for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicates_by_both_ends(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        cigar = rng.choice(["20M", "2S18M", "18M2S", "1H19M", "10M3D10M"])
        length = sum(int(n) for n, k in re.findall(r"(\d+)(\D)", cigar) if k in "M=XIS")
        flag = rng.choice([0, 16, 0, 16, 4, 256, 2064])
        rows.append((i, "s", f"q{i // 2 if i < 200 else rng.randrange(90, 110)}", flag, rng.choice("cd"), rng.choice([100, 102, 98, 101]), 60, cigar, "A" * length, [rng.choice([10, 30])] * length, length))
    score = {r[0]: sum(q for q in r[9] if q >= 15) for r in rows}
    frame = spark.createDataFrame(rows, READ)
    got = {r.rid: r.is_duplicate for r in reads.mark_duplicate_templates(frame, ["sample"]).collect()}
    want = brute_templates(rows, score)
    assert got == want and 20 < sum(want.values()) < 200


def test_pairs_that_differ_in_one_end_stay_apart(spark):
    def read(rid, name, flag, contig, pos, q=30, sample="s"):
        return (rid, sample, name, flag, contig, pos, 60, "10M", "A" * 10, [q] * 10, 10)

    rows = [
        read(0, "a", 99, "c", 100), read(1, "a", 147, "c", 200), read(2, "b", 99, "c", 100, 20), read(3, "b", 147, "c", 200, 20),  # b copies a
        read(4, "x", 99, "c", 100), read(5, "x", 147, "c", 201), read(6, "y", 99, "c", 100), read(7, "y", 147, "d", 200),  # other right ends
        read(8, "lone", 0, "c", 100, 40), read(9, "only", 0, "c", 300, 20), read(10, "more", 0, "c", 300, 30),  # a pair's end wins, else the better read
        read(0, "a", 99, "c", 100, 30, None), read(1, "a", 147, "c", 200, 30, None),  # another sample
    ]
    marked = reads.mark_duplicate_templates(spark.createDataFrame(rows, READ), ["sample"]).collect()
    assert sorted(r.rid for r in marked if r.is_duplicate) == [2, 3, 8, 9] and len(marked) == len(rows)
