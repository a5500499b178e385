"""Passages repeated across documents, by a sparse suffix array over word fingerprints.

1. Of every window of ``words`` words the suffix whose first ``LEAD`` words
   have the smallest hash is retained (a minimiser), so equal windows retain
   equal suffixes: about one suffix in thirteen words.
2. Suffixes are put in order of their leading words; those whose neighbours
   with the same lead all stand in the same document cannot repeat elsewhere.
3. The others are extended left and right to the windows that retained them.
   Windows are sorted by content and document and compared with their
   neighbours: a run with two documents is a repeat, and its smallest document
   is where it stands first.

Fingerprints are 64-bit hashes, so sorting them puts equal texts side by side;
no pairs are made. Leads that very many documents hold are not sorted into one
task: their windows are combined on the map side and joined back.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fragx.llm.common import WordHashes, gram_hashes, signed, stored, texts_of

WORDS = 50
LEAD = 25
#: Documents with a lead from which its windows take the way for hot ones.
HOT_DOCS = 5_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def retained(hashes: np.ndarray, words: int, lead: int) -> np.ndarray:
    """For each window of ``words`` words the lead of its retained suffix: the smallest of the window's leads."""
    least, width = gram_hashes(hashes, lead), words - lead + 1
    span = 1
    while span < width:  # minima of spans from minima of shorter ones that overlap
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    return least


def suffixes(docs: DataFrame, words: int, lead: int) -> DataFrame:
    """(doc_id, lead): the retained suffixes of every document, one row per lead."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, leads = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                found = text.encode("utf-8", "replace").split()
                if len(found) >= words:
                    kept = np.unique(retained(hashes(found), words, lead))
                    ids.append(np.full(len(kept), doc_id, np.int64))
                    leads.append(kept)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(signed(np.concatenate(leads)))], names=["doc_id", "lead"])

    return docs.mapInArrow(run, "doc_id long, lead long")


def _spans(window: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows of a document that overlap or touch as one: its hash, first and last position.

    They share their fate, and a text that repeats a few words would else give
    one row of the same key per word.
    """
    order = np.lexsort((at, window))
    window, at = window[order], at[order]
    opens = np.ones(len(at), bool)
    opens[1:] = (window[1:] != window[:-1]) | (at[1:] > at[:-1] + words)
    first = np.flatnonzero(opens)
    return window[first], at[first], at[np.append(first[1:], len(at)) - 1] if len(at) else at


def windows(docs: DataFrame, words: int, lead: int) -> DataFrame:
    """(window, doc_id, start, length, hot): the windows around the suffixes listed in ``leads``, in code points."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for doc_id, text, shared, hot in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("leads"), batch.column("hot_leads")):
                places = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
                if len(places) < words:
                    continue
                hashed = hashes(text.encode("utf-8", "replace").split())
                own = retained(hashed, words, lead)
                shared = shared.values.to_numpy(zero_copy_only=False).view(np.uint64)
                kept = np.flatnonzero(np.isin(own, shared))
                window, kept, last = _spans(gram_hashes(hashed, words)[kept], kept, words)
                is_hot = np.isin(own[kept], hot.values.to_numpy(zero_copy_only=False).view(np.uint64))
                start = places[kept, 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(window)), pa.array(np.full(len(kept), doc_id, np.int64)),
                        pa.array(start.astype(np.int32)), pa.array((places[last + words - 1, 1] - start).astype(np.int32)), pa.array(is_hot),
                    ],
                    names=["window", "doc_id", "start", "length", "hot"],
                )

    return docs.mapInArrow(run, "window long, doc_id long, start int, length int, hot boolean")


def _neighbours(batches):
    """Rows sorted by window and document: those of a run with two documents, and whether an earlier one has it."""
    carry = None

    def judge(window, doc, start, length):
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(window))))
        last = np.append(first[1:], len(window)) - 1
        keep = (doc[first] != doc[last])[run]
        later = (doc != doc[first][run])[keep]
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(start[keep]), pa.array(length[keep]), pa.array(later)], names=["doc_id", "start", "length", "later"])

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("window", "doc_id", "start", "length")]
        if not len(rows[0]):
            continue
        if carry is not None:
            rows = [np.concatenate(x) for x in zip(carry, rows)]
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last run may go on
        carry = [x[cut:] for x in rows]
        if cut:
            yield judge(*(x[:cut] for x in rows))
    if carry is not None:
        yield judge(*carry)


def repeat_windows(docs: DataFrame, words: int = WORDS, lead: int = LEAD, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(doc_id, start, length, later): every window of ``words`` words that two documents hold."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isNotNull())
    found = suffixes(base, words, lead)
    leads = found.groupBy("lead").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), F.count(F.lit(1)).alias("_n"))
    leads = stored(leads.filter("_a < _b").select("lead", (F.col("_n") > hot_docs).alias("hot")))
    # at most as many leads as the document has words
    listed = found.join(leads, "lead").groupBy("doc_id").agg(
        F.collect_set("lead").alias("leads"), F.collect_set(F.when(F.col("hot"), F.col("lead"))).alias("hot_leads")
    )
    spread = windows(listed.join(base, "doc_id").select("doc_id", "text", "leads", "hot_leads"), words, lead)
    columns = "doc_id long, start int, length int, later boolean"
    cold = spread.filter("NOT hot").drop("hot").repartition("window").sortWithinPartitions("window", "doc_id", "start")
    near = cold.mapInArrow(_neighbours, columns)
    if not leads.filter("hot").head(1):
        return near
    hot = spread.filter("hot").drop("hot")
    spans = stored(hot.groupBy("window").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter("_a < _b"))
    far = hot.join(spans, "window").select("doc_id", "start", "length", (F.col("doc_id") > F.col("_a")).alias("later"))
    return near.unionByName(far)


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals that overlap or touch."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), ends[np.concatenate([cut - 1, [len(ends) - 1]])].tolist()))


SPANS = "array<struct<start:int,end:int>>"


def repeated_passages(docs: DataFrame, words: int = WORDS, lead: int = LEAD, hot_docs: int = HOT_DOCS) -> DataFrame:
    """One row per document that holds a passage of ``words`` words or more found in another document.

    ``spans`` are its repeated passages, ``later`` the parts of them that a
    document with a smaller id holds as well; code points, end exclusive,
    maximal unions of windows. Words are what ASCII white space separates and
    must be equal; the space between them need not. Null and short texts and
    null ids have no rows. Rows that share a doc_id are one document, so they
    do not repeat each other. Further columns are ignored; an empty table
    gives no rows.
    """
    rows = repeat_windows(docs, words, lead, hot_docs)
    per_doc = rows.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"), F.collect_list("later").alias("laters"))

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans, later = [], []
            for s, n, f in zip(batch.column("starts"), batch.column("lengths"), batch.column("laters")):
                start, flag = s.values.to_numpy(zero_copy_only=False), f.values.to_numpy(zero_copy_only=False).astype(bool)
                end = start + n.values.to_numpy(zero_copy_only=False)
                spans.append([{"start": a, "end": b} for a, b in _merge(start, end)])
                later.append([{"start": a, "end": b} for a, b in _merge(start[flag], end[flag])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind), pa.array(later, kind)], names=["doc_id", "spans", "later"])

    return per_doc.mapInArrow(run, f"doc_id long, spans {SPANS}, later {SPANS}")


def without(text: str, spans) -> str:
    """``text`` without the given spans."""
    out, at = [], 0
    for span in spans:
        out.append(text[at : max(at, span["start"])])
        at = max(at, span["end"])
    return "".join([*out, text[at:]])
