"""Near-duplicate documents by ProbMinHash over weighted word shingles.

1. Documents with the same words are one content; its smallest id stands for it.
2. Every content gets a ProbMinHash signature: its shingles arrive as Poisson
   processes whose rate is the shingle's count, each arrival falls on a random
   register, and a shingle stops once it is later than every register's
   earliest arrival. Two signatures agree in a register with the probability
   Jaccard similarity of the contents.
3. Bands of registers are hashed. A bucket links its members to its smallest
   one; what is connected by such links is a cluster of candidates.
4. Clusters are verified exactly. A cluster of up to ``BLOCK`` contents is one
   group. In a larger one every content is first compared with the smallest
   content it shares most bands with; those that are alike form a class, and
   only the contents outside the cluster's largest class are then compared
   with all others, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fragx.llm.common import GOLDEN, WordHashes, gram_hashes, mix64, signed, stored, texts_of
from fragx.llm.graphs import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
BLOCK = 256
SALTS = 16
#: Shingles whose signatures are made together.
TOGETHER = 1_000_000


def shingles(words: list[bytes], hashes: WordHashes, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts; a shorter text is one shingle."""
    return np.unique(gram_hashes(hashes(words), min(n, len(words))), return_counts=True)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Signatures (docs x size): per register the element that arrives first.

    All elements of all documents take their next arrival together; those
    later than the last register of their document drop out.
    """
    best = np.full(docs * size, np.inf)
    who = np.zeros(docs * size, np.uint64)
    late = np.full(docs, np.inf)
    at, when, turn = np.arange(len(elements)), np.zeros(len(elements)), 0
    while len(at):
        turn += 1
        drawn = mix64(elements[at] + np.uint64(turn * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        when = when - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[at]
        early = when < late[owner[at]]
        at, when, drawn = at[early], when[early], drawn[early]
        slot = owner[at] * size + (mix64(drawn ^ GOLDEN) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, slot, when)
        won = best[slot] == when
        who[slot[won]] = elements[at[won]]
        left = np.unique(owner[at])
        late[left] = best.reshape(docs, size)[left].max(axis=1)
    return who.reshape(docs, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    key = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        key = mix64(key * GOLDEN + signature[:, r::rows][:, :bands])
    return mix64(key + np.arange(bands, dtype=np.uint64))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, content, bands) of every document that has words."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, contents, parts, counts, size = [], [], [], [], 0

            def out():
                owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                found = prob_minhash(np.concatenate(parts), np.concatenate(counts).astype(float), owner, len(parts), bands * rows)
                keys = signed(band_keys(found, bands, rows).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * bands, pa.int32()), pa.array(keys))
                block = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(contents, pa.binary()), lists], names=["doc_id", "content", "bands"])
                for x in (ids, contents, parts, counts):
                    x.clear()
                return block

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                words = text.encode("utf-8", "replace").split()
                if not words:
                    continue
                element, count = shingles(words, hashes, n)
                ids.append(doc_id)
                contents.append(xxhash.xxh3_128_digest(b" ".join(words)))
                parts.append(element)
                counts.append(count)
                size += len(element)
                if size > TOGETHER:
                    yield out()
                    size = 0
            if ids:
                yield out()

    return docs.mapInArrow(run, "doc_id long, content binary, bands array<long>")


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets with ascending elements.

    Sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i). With j ordered by
    a_j / b_j the inner maximum is the first term from i on and the second
    before, so running sums do.
    """
    common, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if (wa == wa[0]).all() and (wb == wb[0]).all():
        return len(common) / (len(a) + len(b) - len(common))
    x, y = wa[at].astype(float), wb[bt].astype(float)
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    ratio = x / y
    first = np.searchsorted(ratio, ratio, side="left")
    above = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])[first] + (wa.sum() - x.sum())  # only in a: ratio is infinite
    below = np.concatenate([[0], np.cumsum(y)])[first] + (wb.sum() - y.sum())  # only in b: ratio is 0
    return float((1 / (above / x + below / y)).sum())


class Forest:
    """Classes of the members of one group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = sorted((self.root(i), self.root(j)))
        self.parent[j] = i


def link_alike(sets: list[tuple[np.ndarray, np.ndarray]], forest: Forest, threshold: float, split: int = 0) -> None:
    """Join all pairs of at least ``threshold``; with ``split`` only pairs across that index.

    The similarity is at most each side's share of weight in common, so a
    product of matrices over the shingles that two sets share rules out most pairs.
    """
    sizes = np.array([len(e) for e, _ in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, inverse, seen = np.unique(np.concatenate([e for e, _ in sets]), return_inverse=True, return_counts=True)
    weight = np.concatenate([w / w.sum() for _, w in sets]).astype(np.float32)
    shared = seen[inverse] > 1
    column = (np.cumsum(seen > 1) - 1)[inverse[shared]]
    owner, weight = owner[shared], weight[shared]
    order = np.argsort(column, kind="stable")
    owner, weight, column = owner[order], weight[order], column[order]
    in_common = np.zeros((len(sets), len(sets)), np.float32)
    width = 8192
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        mass = np.zeros((len(sets), width), np.float32)
        mass[owner[a:b], column[a:b] - start] = weight[a:b]
        in_common += mass @ (mass > 0).astype(np.float32).T
    close = np.minimum(in_common, in_common.T) >= threshold - 1e-3
    for i, j in np.argwhere(np.triu(close, 1)):
        if (not split or i < split <= j) and forest.root(i) != forest.root(j) and probability_jaccard(*sets[i], *sets[j]) >= threshold:
            forest.link(i, j)


def _sets(texts, hashes: WordHashes, n: int):
    return [shingles(t.encode("utf-8", "replace").split(), hashes, n) for t in texts]


def _spread(keys: DataFrame) -> DataFrame:
    """``keys`` once per salt."""
    return keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """One row per document: doc_id and class_id, the smallest id of its near-duplicate class.

    Two documents are linked if the probability Jaccard similarity of their
    word shingles, weighted by count, is at least ``threshold``; classes are
    what links connect. A pair at the threshold of 0.8 shares no band of
    25 x 5 registers with a probability below 1e-4. Null texts and texts
    without words are classes of their own. Rows that share a doc_id are one
    document of that class; a null doc_id has a null class. Columns beyond
    doc_id and text are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = stored(signatures(base.filter(F.col("doc_id").isNotNull()), shingle, bands, rows))

    # contents: only those with copies are joined back, once per salt
    copies = held.groupBy("content").agg(F.min("doc_id").alias("_rep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    marked = held.withColumn("_salt", _salt("doc_id")).join(_spread(copies), ["content", "_salt"], "left")
    marked = stored(marked.select("doc_id", F.coalesce("_rep", "doc_id").alias("rep"), F.when(F.coalesce("_rep", "doc_id") == F.col("doc_id"), F.col("bands")).alias("bands")))
    reps = marked.filter(F.col("bands").isNotNull()).select("doc_id", F.posexplode("bands").alias("band", "key")).distinct()

    # buckets: members to the smallest one, counted over bands
    buckets = reps.groupBy("band", "key").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    pairs = reps.withColumn("_salt", _salt("doc_id")).join(_spread(buckets), ["band", "key", "_salt"]).filter("doc_id <> lead")
    pairs = stored(pairs.groupBy("doc_id", "lead").agg(F.count(F.lit(1)).alias("shared")))
    clusters = components(pairs, "doc_id", "lead").withColumnRenamed("node", "doc_id").withColumnRenamed("root", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    clusters = stored(clusters.join(sizes, "cluster"))
    texts = clusters.join(base, "doc_id").groupBy("doc_id", "cluster", "members").agg(F.min("text").alias("text"))
    texts = stored(texts)

    small = texts.filter(F.col("members") <= block).groupBy("cluster").applyInArrow(_group(threshold, shingle), "doc_id long, root long")
    large = texts.filter(F.col("members") > block)
    found = small
    if not large.isEmpty():
        found = found.unionByName(_large_clusters(large, pairs, threshold, shingle, block))
    classes = stored(found.distinct().filter("doc_id <> root"))
    named = marked.select("doc_id", "rep").join(classes.withColumnRenamed("doc_id", "rep"), "rep", "left")
    named = named.select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    wordless = base.filter(F.col("doc_id").isNull() | (F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")) == 0))
    return named.unionByName(wordless.select("doc_id", F.col("doc_id").alias("class_id")))


def _group(threshold: float, n: int):
    """All pairs of one small cluster: every member with the smallest id of its class."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        ids = group.column("doc_id").to_pylist()
        sets = _sets(group.column("text").to_pylist(), WordHashes(), n)
        forest = Forest(len(ids))
        link_alike(sets, forest, threshold)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "root": pa.array([ids[forest.root(i)] for i in range(len(ids))], pa.int64())})

    return run


def _large_clusters(texts: DataFrame, pairs: DataFrame, threshold: float, n: int, block: int) -> DataFrame:
    """Classes of clusters of any size: first each content against one other, then what is left against all."""
    best = pairs.groupBy("doc_id").agg(F.max_by("lead", F.struct("shared", -F.col("lead"))).alias("lead"))
    members = texts.join(best, "doc_id")
    leads = texts.select(F.col("doc_id").alias("lead"), F.col("text").alias("lead_text")).join(best.select("lead").distinct(), "lead", "left_semi")
    both = members.withColumn("_salt", _salt("doc_id")).join(_spread(leads), ["lead", "_salt"]).select("doc_id", "lead", "text", "lead_text")

    def verify(batches: Iterator[pa.RecordBatch]):
        hashes, lead, held = WordHashes(), None, None
        for batch in batches:
            keep = []
            for lead_id, text, lead_text in zip(*(batch.column(c).to_pylist() for c in ("lead", "text", "lead_text"))):
                if lead_id != lead:
                    lead, held = lead_id, _sets([lead_text], hashes, n)[0]
                keep.append(probability_jaccard(*_sets([text], hashes, n)[0], *held) >= threshold)
            yield batch.select(["doc_id", "lead"]).filter(pa.array(keep, pa.bool_()))

    links = stored(both.mapInArrow(verify, "doc_id long, lead long"))
    roots = components(links, "doc_id", "lead").withColumnRenamed("node", "doc_id")
    parts = texts.select("doc_id", "cluster", "text").join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    parts = stored(parts)
    counts = parts.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.groupBy("cluster").agg(F.max_by("root", F.struct("_n", -F.col("root"))).alias("main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    open_ones = stored(largest.filter("_all > _most"))
    # blocks: the rest of a cluster (0) and its largest class (1), dealt by a hash; only the counts are needed
    dealt = parts.join(open_ones, "cluster").withColumn("side", (F.col("root") == F.col("main")).cast("int"))
    rest, main = F.ceil((F.col("_all") - F.col("_most")) / F.lit(block)).cast("int"), F.ceil(F.col("_most") / F.lit(block)).cast("int")
    dealt = dealt.withColumn("rest", rest).withColumn("all", rest + main)
    place = F.pmod(F.xxhash64("doc_id"), F.when(F.col("side") == 0, F.col("rest")).otherwise(F.col("all") - F.col("rest"))).cast("int")
    dealt = dealt.withColumn("place", F.when(F.col("side") == 0, place).otherwise(place + F.col("rest")))
    # block i of the rest meets every block j >= i
    own = F.transform(F.sequence(F.col("place"), F.col("all") - 1), lambda j: F.struct(F.col("place").alias("i"), j.alias("j")))
    before = F.when(F.col("place") > 0, F.transform(F.sequence(F.lit(0), F.least("place", "rest") - 1), lambda i: F.struct(i.alias("i"), F.col("place").alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    meets = F.concat(F.when(F.col("place") < F.col("rest"), own).otherwise(F.array().cast("array<struct<i:int,j:int>>")), before)
    tasks = dealt.select("cluster", "doc_id", "root", "place", "text", F.explode(meets).alias("m")).select("cluster", "doc_id", "root", "place", "text", "m.i", "m.j")

    def compare(group: pa.Table) -> pa.Table:
        frame: pd.DataFrame = group.to_pandas().sort_values(["place", "doc_id"], kind="stable", ignore_index=True)
        forest = Forest(len(frame))
        first = frame.groupby("root").ngroup().to_numpy()
        start = {}
        for at, r in enumerate(first):
            forest.link(start.setdefault(r, at), at)
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        split = int((frame["place"] == i).sum()) if i != j else 0
        if not (i != j and split in (0, len(frame))):
            link_alike(_sets(frame["text"], WordHashes(), n), forest, threshold, split)
        ids = frame["doc_id"].to_numpy()
        tops = np.array([ids[forest.root(at)] for at in range(len(frame))], np.int64)
        apart = tops != ids
        return pa.table({"doc_id": pa.array(ids[apart], pa.int64()), "root": pa.array(tops[apart], pa.int64())})

    more = tasks.groupBy("cluster", "i", "j").applyInArrow(compare, "doc_id long, root long")
    edges = roots.select("doc_id", "root").unionByName(more)
    return components(edges, "doc_id", "root").withColumnRenamed("node", "doc_id")
