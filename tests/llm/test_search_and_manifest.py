"""N-gram join, lexical search and Merkle manifest against brute force, on skewed, odd and small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from fragx.llm import lexical, merkle, ngramjoin

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, content string, gram long, n int, m long, tree string, path string, pos int, size int, root string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ODD = [
    (None, "a text without an id but with some words"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, LONG), (5, LONG), (6, "x" * 100_000), (7, LONG),
    (8, "Same words here twice"), (9, "same  words here TWICE"), (9, "another text of one id"), (10, "  　 café \U0001f600"), (2, ""), (-3, "negative id"), (11, "two words"), (12, "two\nWords"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None if i % 2 else "en", "src", i, *[None] * 9) for i, r in enumerate(ODD)], COLUMNS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# n-gram join


def gram_set(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_join(rows, percent=90):
    """(doc_id, size, component) of every row."""
    sets = [gram_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted(((d, len(s), low[root(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(df, **options):
    return sorted((tuple(r) for r in ngramjoin.ngram_join(df, **options).collect()), key=str)


def test_ngram_join_equals_brute_force(documents, odd):
    assert joined(documents) == brute_join(pairs_of(documents))
    assert joined(odd) == brute_join(ODD)
    assert joined(odd.limit(0)) == []


@pytest.mark.parametrize("hot,block", [(128, 256), (4, 8)])
def test_ngram_join_of_near_copies_at_the_threshold(spark, hot, block):
    # a third of all rows are edits of one text, so that some pairs are just above and some just below the threshold
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows = []
    for i in range(60):
        words = base[:]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"v{rng.randrange(300)}" for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [(200 + i, " ".join([*base[:30], *[f"u{rng.randrange(900)}" for _ in range(rng.randrange(40))]])) for i in range(60)]
    rows += [(300 + i, " ".join(f"x{k}" for k in range(i))) for i in range(25)]
    rng.shuffle(rows)
    got = joined(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, block=block)
    want = brute_join(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 40  # links there are


def test_ngram_join_bounds():
    for percent in (50, 80, 90, 100):
        for a in range(1, 40):
            for b in range(a, 40):
                least = ngramjoin.needed(a, b, percent)
                fits = [i for i in range(a + 1) if 100 * i >= percent * (a + b - i)]
                assert (min(fits) if fits else a + 1) <= max(least, 0) <= (min(fits) if fits else b + 1)
                if fits:  # linked sets share one of the first columns in any order
                    assert ngramjoin.first_columns(a, percent) > a - min(fits) or a == 0
                    assert ngramjoin.first_columns(b, percent) > b - min(fits)


def test_blocked_product_counts_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30_000, rng.integers(1, 9_000))) for _ in range(12)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = ngramjoin.multiply(sets)
    off = ~np.eye(12, dtype=bool)
    assert (got[off] == want[off]).all()
    assert (ngramjoin.multiply(sets, 5) == want[:5, 5:]).all()


# lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(rows, items, top=20):
    docs = [(d, collections.Counter(terms(t))) for d, t in rows if terms(t)]
    count, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for doc, counts in docs:
            m = 75 + 25 * sum(counts.values()) * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m)) for t in terms(text) if counts[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=str)


def found(docs, items, **options):
    return sorted((tuple(r) for r in lexical.search(docs, items, **options).collect()), key=str)


def test_lexical_search_equals_brute_force(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    wanted = brute_search(pairs_of(documents), [(r.item_id, r.text) for r in items.collect()])
    assert found(documents, items) == wanted
    # many parts per stratum and many passes over the items give the same rows
    assert found(documents, items, part=300, item_terms=100) == wanted


def test_lexical_search_of_odd_rows(spark, odd):
    items = [(1, "same words here"), (1, "same words here"), (1, "other: TEXT, id"), (2, None), (3, "!!"), (None, "word word word"), (4, "w5x5 café w6x6"), (5, "nowhere")]
    frame = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    assert found(odd, frame, part=50) == brute_search(ODD, items)
    assert found(odd.limit(0), frame) == [] and found(odd, frame.limit(0)) == []


def test_lexical_ties_and_one_common_length(spark):
    rows = [(i, f"alpha beta {'gamma' if i % 3 else 'delta'}") for i in range(300)] + [(7, "alpha beta gamma")] * 3
    items = [(1, "gamma alpha"), (2, "delta delta beta")]
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(*frames, part=40) == brute_search(rows, items)


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Root and, per node, its siblings level by level as (left, right)."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 8, len(nodes))) for i in range(0, len(nodes), 8)]
        for run in runs:
            for at in run:
                for i in owners[at]:
                    paths[i].append(("".join(nodes[k] for k in run if k < at), "".join(nodes[k] for k in run if k > at)))
        nodes, owners = [h(*[nodes[k] for k in run]) for run in runs], [[i for k in run for i in owners[k]] for run in runs]
    return nodes[0], paths


def brute_manifest(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for row, path in zip(sorted(groups[g], key=lambda r: r[:3]), trees[g][1]):
            path, doc = path + top, row[3]
            node = row[2]
            if doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 3 == 0 and doc[4] is not None:
                node = leaf_of((*doc[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in doc[4])))
            for left, right in path:
                node = h(left, node, right)
            out.append((doc[0], row[2], trees[g][0], root, h(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


def manifest(df):
    return sorted((tuple(r) for r in merkle.proofs(df).collect()), key=str)


def fields(df):
    return [tuple(r) for r in df.select(*merkle.FIELDS).collect()]


def test_manifest_equals_brute_force(documents, odd):
    assert manifest(documents) == brute_manifest(fields(documents))
    assert manifest(odd) == brute_manifest(fields(odd))
    assert manifest(odd.limit(0)) == []


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9], [64, 65, 1], [512, 513, 3], [1100, 7, 600]])
def test_manifest_of_trees_of_all_shapes(spark, sizes):
    langs = [None, "en", "é", "zz"]
    rows = [(i, "s", langs[g], i, f"Text {i % 7}") for g, n in enumerate(sizes) for i in range(n)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").select("doc_id", "text", "lang", "source", "n_chars")
    assert manifest(df) == brute_manifest(rows)


def test_every_change_of_a_row_breaks_its_proof(spark):
    rows = [(i, "g" if i % 3 else None, merkle_leaf, None) for i, merkle_leaf in enumerate(h(str(i)) for i in range(700))]
    held = merkle.manifest(spark.createDataFrame(rows, "id long, group string, leaf string, carried string"))
    assert {r.position for r in held.filter("group is null").collect()} == set(range(234))
    from pyspark.sql import functions as F

    changed = held.select((merkle.fold(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("path")) == F.col("root")).alias("same"), (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("kept"))
    assert {tuple(r) for r in changed.collect()} == {(False, True)}
