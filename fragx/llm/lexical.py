"""Ranked lexical search over a length-stratified index.

Documents whose length normaliser m is equal form a stratum. All documents of
a stratum give a term the same impact for the same term frequency, so postings
stand by frequency within a stratum and an impact is computed once per
(stratum, term, frequency).

1. Documents become bags of terms, written once; their number and lengths fix
   each one's m.
2. A stratum is cut into parts of about ``PART`` postings by row, so a common
   length is many groups. Each part becomes one row of the index: its
   documents, its terms and, per term, runs of documents of one frequency, the
   highest first.
3. Items are searched in blocks of bounded size. Document frequencies are
   summed over the index. A task keeps the best documents of every item; the
   highest frequencies bound what a part can give to an item, parts are visited
   by falling bound, and a part whose bound is below the item's last kept score
   isn't visited.

Scores are 64-bit integers, so they are the same in any order of summation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fragx.llm.common import stored, texts_of

#: Letters and digits of ASCII, lower-cased, and all bytes of other characters; anything else parts terms.
LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
TOP = 20
#: Postings of one part of a stratum, about; a single document is never cut.
PART = 500_000
#: Terms of the items searched in one pass, about: it bounds what is sent to the tasks.
ITEM_TERMS = 100_000
#: Parts that a task holds to order its visits, and documents from which small parts are visited together.
HELD = 64
VISIT = 4096

BAGS = "doc_id long, n long, size int, terms string, tfs array<int>"
INDEX = "m long, docs array<long>, terms string, runs array<int>, tfs array<int>, counts array<int>, places array<int>"


def terms_of(text: str) -> list[str]:
    return text.encode("utf-8", "replace").translate(LETTERS).decode().split(" ")


def bags(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n, size, terms, tfs): a row's terms in all, its distinct terms joined by spaces and their counts."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n, sizes, terms, tfs = [], [], [], []
            for text in texts_of(batch):
                held: dict[str, int] = {}
                for term in terms_of(text):
                    held[term] = held.get(term, 0) + 1
                held.pop("", None)
                n.append(sum(held.values()))
                sizes.append(len(held))
                terms.append(" ".join(held))
                tfs.append(np.fromiter(held.values(), np.int32, len(held)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sizes, pa.int32()), pa.array(terms, pa.string()), _lists(tfs)],
                names=["doc_id", "n", "size", "terms", "tfs"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BAGS)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))


def build_index(docs: DataFrame, part: int = PART) -> tuple[DataFrame, int, int]:
    """The index of all documents with a term, one row per part of a stratum; their number and their terms in all."""
    held = stored(bags(docs, "doc_id").filter("n > 0"))
    count, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(75) + F.expr(f"(25 * n * {count}L) div {max(total, 1)}L")
    held = held.withColumn("m", m)
    strata = stored(held.groupBy("m").agg(F.ceil(F.sum("size") / part).alias("parts")))
    # dealt by row, so that repeated rows part as well; the bags are stored, so a row keeps its number
    placed = held.withColumn("row", F.monotonically_increasing_id()).join(strata, "m").withColumn("part", F.pmod("row", "parts"))

    def build(group: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(group, sort_keys=[("doc_id", "ascending")], null_placement="at_start")
        group = group.take(order)
        vocabulary: dict[str, int] = {}
        ids: list[int] = []
        for terms in group.column("terms").to_pylist():
            ids.extend([vocabulary.setdefault(t, len(vocabulary)) for t in terms.split(" ")])
        tf = group.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        term, place = np.array(ids), np.repeat(np.arange(len(group)), group.column("size").to_numpy())
        by_run = np.lexsort((place, -tf, term))
        term, tf, place = term[by_run], tf[by_run], place[by_run]
        opens = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])))
        runs = np.bincount(term[opens], minlength=len(vocabulary))
        counts = np.diff(np.append(opens, len(term)))
        one = [pa.array([x], t) for x, t in (
            (group.column("m")[0].as_py(), pa.int64()), (group.column("doc_id").to_pylist(), pa.list_(pa.int64())), (" ".join(vocabulary), pa.string()),
            (runs.astype(np.int32), pa.list_(pa.int32())), (tf[opens].astype(np.int32), pa.list_(pa.int32())),
            (counts.astype(np.int32), pa.list_(pa.int32())), (place.astype(np.int32), pa.list_(pa.int32())),
        )]
        return pa.table(one, names=["m", "docs", "terms", "runs", "tfs", "counts", "places"])

    index = placed.select("m", "part", "doc_id", "size", "terms", "tfs").groupBy("m", "part").applyInArrow(build, INDEX)
    return stored(index), count, total


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(df: int, count: int) -> int:
    return math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))


def _known(row: dict, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a part's terms that are searched, and their numbers."""
    found = [(i, number[t]) for i, t in enumerate(row["terms"].split(" ")) if t in number]
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {}
        for name in batch.schema.names:
            value = batch.column(name)[i]
            row[name] = value.values if isinstance(value, pa.ListScalar) else value.as_py()
        yield row


def document_frequencies(index: DataFrame, number: dict[str, int]) -> dict[int, int]:
    """How many documents hold each searched term, summed over the index."""

    def run(batches):
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            for row in _rows(batch):
                place, which = _known(row, number)
                runs = row["runs"].to_numpy()
                ends = np.concatenate([[0], np.cumsum(row["counts"].to_numpy())])[np.concatenate([[0], np.cumsum(runs)])]
                total[which] += (ends[1:] - ends[:-1])[place]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["term", "df"])

    partial = index.select("terms", "runs", "counts").mapInArrow(run, "term long, df long")
    return {r.term: r.df for r in partial.groupBy("term").agg(F.sum("df").alias("df")).collect()}


class Part:
    """The searched postings of some neighbouring parts: per term the documents and their impacts times the term's weight."""

    def __init__(self):
        self.ids, self.null, self.bounds, self.pieces, self.size = [], [], [], {}, 0

    def add(self, row: dict, number: dict[str, int], weights: np.ndarray) -> None:
        place, which = _known(row, number)
        runs, counts = row["runs"].to_numpy(), row["counts"].to_numpy()
        first = np.concatenate([[0], np.cumsum(runs)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        impacts, places = impact(row["tfs"].to_numpy(), row["m"]), row["places"].to_numpy()
        most = np.zeros(len(weights), np.int64)
        most[which] = weights[which] * impacts[first[place]]
        self.bounds.append(most)
        for p, t in zip(place, which):
            a, b = first[p], first[p + 1]
            self.pieces.setdefault(int(t), []).append((places[ends[a] : ends[b]] + self.size, np.repeat(weights[t] * impacts[a:b], counts[a:b])))
        self.null.append(row["docs"].is_null().to_numpy(zero_copy_only=False))
        self.ids.append(row["docs"].fill_null(-(1 << 63)).to_numpy())
        self.size += len(row["docs"])

    def close(self) -> Part:
        self.ids, self.null = np.concatenate(self.ids), np.concatenate(self.null)
        self.bounds = np.array(self.bounds)
        self.pieces = {t: tuple(np.concatenate(x) for x in zip(*p)) if len(p) > 1 else p[0] for t, p in self.pieces.items()}
        return self

    def scores(self, item: list[tuple[int, int]]) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        for term, times in item:
            if term in self.pieces:
                places, impacts = self.pieces[term]
                out[places] += times * impacts if times > 1 else impacts
        return out


class Best:
    """The best documents of one item so far: scores, ids and which ids are null, best first."""

    def __init__(self, top: int):
        self.top, self.last = top, 1
        self.score, self.doc, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def offer(self, scores: np.ndarray, part: Part) -> None:
        at = np.flatnonzero(scores >= self.last)
        if not len(at):
            return
        score, doc, null = np.append(self.score, scores[at]), np.append(self.doc, part.ids[at]), np.append(self.null, part.null[at])
        order = np.lexsort((doc, ~null, -score))[: self.top]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        if len(order) == self.top:
            self.last = int(self.score[-1])


def _search_block(index: DataFrame, count: int, block: list, top: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each item of a block by task."""
    number: dict[str, int] = {}
    items = [[(number.setdefault(t, len(number)), c) for t, c in zip(b.terms.split(" "), b.tfs)] if b.size else [] for b in block]
    df = document_frequencies(index, number)
    weights = np.array([weight(df.get(t, 0), count) for t in range(len(number))], np.int64)

    def run(batches):
        best = [Best(top) for _ in items]
        full = [(i, np.array([t for t, _ in item]), np.array([c for _, c in item], np.int64)) for i, item in enumerate(items) if item]
        for parts in _held(_rows(b) for b in batches):
            for i, terms, times in full:
                reach = [int((p.bounds[:, terms] @ times).max()) for p in parts]
                for at in sorted(range(len(parts)), key=reach.__getitem__, reverse=True):
                    if reach[at] < best[i].last:
                        break
                    best[i].offer(parts[at].scores(items[i]), parts[at])
        sizes = [len(b.score) for b in best]
        arrays = [
            pa.array(np.repeat(np.arange(len(items)), sizes)), pa.array(np.concatenate([np.empty(0, np.int64), *[b.doc for b in best]]), mask=np.concatenate([np.empty(0, bool), *[b.null for b in best]])),
            pa.array(np.concatenate([np.empty(0, np.int64), *[b.score for b in best]])),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])

    def _held(rows):
        parts, part = [], Part()
        for row in (r for some in rows for r in some):
            part.add(row, number, weights)
            if part.size >= VISIT:
                parts.append(part.close())
                part = Part()
            if len(parts) == HELD:
                yield parts
                parts = []
        if part.size:
            parts.append(part.close())
        if parts:
            yield parts

    found = index.mapInArrow(run, "item long, doc_id long, score long")
    by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
    names = found.sparkSession.createDataFrame([(i, b.doc_id) for i, b in enumerate(block)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, part: int = PART, item_terms: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of every item.

    ``docs`` has doc_id and text, ``items`` item_id and text. Null texts and
    texts without a term are no documents, and such items find nothing. Items
    that are equal rows are one item; different texts of one item_id are ranked
    each on its own. Documents that repeat a doc_id are each ranked, a null
    doc_id before others of its score. Very long texts are one document of one
    part; memory grows with the largest of them. Further columns are ignored;
    an empty table gives no rows.

    Items go through the driver in blocks of about ``item_terms`` distinct
    terms, and each block is one pass over the index.
    """
    index, count, _ = build_index(docs, part)
    wanted = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    wanted = stored(bags(wanted, "item_id").filter("n > 0"))
    total = wanted.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(2 * total / item_terms)) if total > item_terms else 1
    out = None
    for b in range(blocks):
        block = wanted.filter(F.pmod(F.xxhash64("doc_id", "terms"), F.lit(blocks)) == b).collect()
        found = _search_block(index, count, block, top)
        out = found if out is None else out.unionByName(found)
    return out
