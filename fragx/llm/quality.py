"""Quality rules: counts of a text and a hashed n-gram log-likelihood ratio with a threshold learned from labels.

Two multinomials over hashed words and word pairs are counted: one over every
document (raw) and one over trusted documents (target). A document's score is
the sum over its words and pairs of log p_target - log p_raw, divided by their
number. The target has the raw distribution as its prior, so evidence too rare
to have been seen in it counts for nothing, and a document's own words are
taken out of both counts, so trusted documents do not vouch for themselves.
Every document at or above the threshold is kept; nothing is drawn.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fragx.llm.common import GOLDEN, Sieve, WordHashes, fresh, mix64, sieved, stored, texts_of
from fragx.operators.ordering import running_totals
from fragx.session import materialize

BUCKETS = 1 << 16
#: Strength of the prior: a bucket's target count is weighed as if it had this many occurrences at the raw rate.
PRIOR = 2.0
#: Share of the trusted documents, scored without themselves, that the threshold has to keep.
KEEP_GOOD = 0.99
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8


def features(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words."""
    pairs = mix64(hashes[:-1] * GOLDEN + hashes[1:]) if len(hashes) > 1 else hashes[:0]
    return (np.concatenate([hashes, pairs]) % np.uint64(buckets)).astype(np.int64)


def labelled_ids(labels: DataFrame, good: bool) -> DataFrame:
    """All ids labelled good and not toxic, or all labelled bad; each once."""
    wanted = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) if good else F.col("quality") == 0
    return labels.filter(wanted & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _flagged(docs: DataFrame, trusted: DataFrame, name: str) -> DataFrame:
    """``docs`` plus whether its id is trusted; the ids stay a table and Spark chooses the join by their size."""
    key = fresh(docs, "_trusted_id")
    joined = docs.join(trusted.select(F.col("doc_id").alias(key)), F.col("doc_id").cast("long") == F.col(key), "left")
    return joined.withColumn(name, F.col(key).isNotNull()).drop(key)


class Trust:
    """Which ids of ``docs`` are among the trusted ones, told in a task without the ids.

    Two bitmaps of fixed size: of the trusted ids, and of those other ids of
    ``docs`` that the first one lets through. An id that both know is open: it
    has to meet the ids in a join. Few are, until the bitmaps fill.
    """

    NO, YES, OPEN = 0, 1, 2

    def __init__(self, docs: DataFrame, trusted: DataFrame):
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null")
        self.inside = Sieve(trusted, "doc_id")
        self.outside = Sieve(sieved(ids, "doc_id", self.inside).join(trusted, "doc_id", "left_anti"), "doc_id")
        self.all_told = not self.outside.words.any()

    def __call__(self, ids: pa.Array) -> np.ndarray:
        known, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        inside = known & self.inside(values)
        return np.where(inside, np.where(self.outside(values), self.OPEN, self.YES), self.NO)


@dataclass
class Model:
    """Counts per bucket over all and over trusted documents, the trusted ids (a table, or few in order), and the threshold."""

    raw: np.ndarray
    target: np.ndarray
    trusted: np.ndarray | DataFrame | None
    threshold: float = -np.inf
    raw_size: int = 0
    target_size: int = 0

    def trusts(self, ids: list) -> np.ndarray:
        """Which of the ids are trusted; null is not. Of a table only the ids asked for come back."""
        known = np.array([i is not None for i in ids], bool)
        asked = np.array([0 if i is None else i for i in ids], np.int64)
        trusted = self.trusted
        if isinstance(trusted, DataFrame):
            trusted = np.array([r[0] for r in trusted.filter(F.col("doc_id").isin(asked.tolist())).collect()], np.int64)
        return known & np.isin(asked, trusted)

    def ids(self, spark: SparkSession) -> DataFrame:
        """The trusted ids as a table."""
        if isinstance(self.trusted, DataFrame):
            return self.trusted
        return spark.createDataFrame([(int(i),) for i in self.trusted], "doc_id long")

    def shared(self) -> Model:
        """What tasks need: numbers per bucket, no ids."""
        return replace(self, trusted=None)

    def score(self, found: np.ndarray, trusted: bool) -> float:
        """Mean log ratio of a text's buckets by what the other documents hold."""
        if not self.target_size:
            return 0.0
        at, own = np.unique(found, return_counts=True)
        mine = own if trusted else 0
        size = self.target_size - (len(found) if trusted else 0)
        rest = max(self.raw_size - len(found), 1)
        expected = size * np.maximum(self.raw[at] - own, 0) / rest
        ratio = np.log((np.maximum(self.target[at] - mine, 0) + PRIOR) / (expected + PRIOR))
        return float((own * ratio).sum() / len(found))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> Model:
    """Counts per bucket and the threshold. Raw counts cover all documents, target counts all trusted ones.

    Each task sends one row per bucket at most, so neither shuffle nor driver
    sees more than ``buckets`` rows a task; labelled ids and their scores stay
    tables. Without trusted documents the ratio is 0 everywhere: every text
    then passes.
    """
    model, marked = _counted(docs, labels, buckets)
    if model.target_size:
        # a bitmap keeps most texts without a label from being scored; those it lets through meet no labelled id
        some = docs.filter(F.col("doc_id").cast("long").isNotNull())
        model.threshold = _threshold(_scored(some, model, Sieve(marked, "doc_id")), marked)
    return model


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _counted(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> tuple[Model, DataFrame]:
    """The model without its threshold, and (doc_id, good, bad) of the labelled ids."""
    model = Model(np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), materialize(labelled_ids(labels, True)))
    both = model.trusted.withColumn("good", F.lit(1)).unionByName(labelled_ids(labels, False).withColumn("good", F.lit(0)))
    marked = materialize(both.groupBy("doc_id").agg(F.max("good").alias("good"), F.max(1 - F.col("good")).alias("bad")))
    mine, trust = _texts(docs), Trust(docs, model.trusted)
    model.raw, model.target = _counts(mine, buckets, trust)
    if not trust.all_told:
        model.target += _counts(_open(mine, trust).join(model.trusted, "doc_id"), buckets)[0]
    model.raw_size, model.target_size = int(model.raw.sum()), int(model.target.sum())
    return model, marked


def _threshold(scored: DataFrame, marked: DataFrame) -> float:
    """The cut that the scores of the labelled ids give."""
    scored = scored.filter(~F.col("base_failed")).select("doc_id", "score").distinct()
    return best_cut_of(scored.join(marked, "doc_id").groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))


def _open(docs: DataFrame, trust: Trust) -> DataFrame:
    """The rows whose ids the bitmaps leave open."""
    told = docs.sparkSession.sparkContext.broadcast(trust)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(told.value(batch.column("doc_id")) == Trust.OPEN))

    return docs.mapInArrow(run, docs.schema)


def _counts(docs: DataFrame, buckets: int, trust: Trust | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences per bucket over all texts, and over those that are surely trusted."""
    told = docs.sparkSession.sparkContext.broadcast(trust)

    def count(batches):
        both, hashes = np.zeros((2, buckets), np.int64), WordHashes()  # of other texts, of trusted ones
        for batch in batches:
            trusted = np.zeros(len(batch), np.int64) if told.value is None else (told.value(batch.column("doc_id")) == Trust.YES).astype(np.int64)
            for text, at in zip(texts_of(batch), trusted):
                words = text.encode("utf-8", "replace").split()
                if words:
                    seen = features(hashes(words), buckets)
                    if len(seen) > buckets // 8:
                        both[at] += np.bincount(seen, minlength=buckets)
                    else:
                        np.add.at(both[at], seen, 1)
        total = both.sum(axis=0)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used]), pa.array(both[1][used])], names=["bucket", "n", "trusted"])

    raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    sums = docs.select("doc_id", "text").mapInArrow(count, "bucket long, n long, trusted long").groupBy("bucket").agg(F.sum("n"), F.sum("trusted"))
    for b, n, m in sums.collect():  # ``buckets`` rows at most
        raw[b], target[b] = n, m
    return raw, target


def best_cut_of(counts: DataFrame) -> float:
    """``best_cut`` of a table (score, good, bad) with one row per score and how many of each have it; shares are compared in whole numbers."""
    counts = materialize(counts)
    goods, bads = counts.agg(F.sum("good"), F.sum("bad")).first()
    if not goods:
        return -np.inf
    below = running_totals(counts, {"_good": "good", "_bad": "bad"}, [F.col("score")])
    good, bad = goods - F.col("_good") + F.col("good"), bads - F.col("_bad") + F.col("bad")
    gain = good * max(bads, 1) - bad * goods
    best = below.filter(good / goods >= KEEP_GOOD).agg(F.min_by("score", F.struct(-gain, F.col("score")))).first()[0]
    before = counts.filter(F.col("score") < best).agg(F.max("score")).first()[0]
    return best if before is None else (before + best) / 2


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """Of the cuts that keep ``KEEP_GOOD`` of the good scores the one that keeps fewest bad scores for them.

    That is the largest difference of the two shares kept. Of equal places the
    lowest gap between two neighbouring scores wins, and the cut is its middle.
    Without bad scores below a good one the cut is the lowest good score;
    without good scores everything is kept.
    """
    if not len(good):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    above = lambda x: (len(x) - np.searchsorted(np.sort(x), at)) / max(len(x), 1)
    best = int(np.argmax(np.where(above(good) >= KEEP_GOOD, np.round(above(good) - above(bad), 12), -np.inf)))
    if not best:
        return float(at[0])
    return float((at[best - 1] + at[best]) / 2)


def repeated_words(hashes: np.ndarray, n: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``n`` words found twice or more. Windows are compared exactly, by ranks."""
    if len(hashes) <= n:
        return 0
    rank = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < n:  # n is a power of two: ranks of windows twice as long from pairs of ranks
        rank = np.unique(rank[: len(rank) - length] * (len(hashes) + 1) + rank[length:], return_inverse=True)[1].astype(np.int64)
        length *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    worded = [x for x in lines if x.strip(SPACES)]
    return len(worded) - len(set(worded))


class Judge:
    """Counts, score and verdict of single texts."""

    def __init__(self, model: Model):
        self.model, self.hashes = model, WordHashes()

    def __call__(self, text: str, trusted: bool) -> tuple:
        *counts, failed, plain, other = self.both(text)
        value = other if trusted else plain
        return *counts, failed, not failed and value >= self.model.threshold, value

    def both(self, text: str) -> tuple:
        """Counts, whether the base rules fail, and the scores of the text as an untrusted and as a trusted one."""
        words = text.encode("utf-8", "replace").split()
        n, h = len(words), self.hashes(words) if words else None
        n_repeat = repeated_words(h) if n else 0
        failed = n < 20 or 100 * n_repeat > 30 * n
        found = features(h, len(self.model.raw)) if n else None
        values = [self.model.score(found, t) if n else None for t in (False, True)]
        characters = len(text) - sum(text.count(c) for c in SPACES)
        symbols = sum(text.count(c) for c in SYMBOLS)
        return n, characters, symbols, duplicate_lines(text), n_repeat, failed, *values


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document with counts, score and verdict, from its whole text.

    A null text has no words: all counts 0, base_failed, not kept, score null.
    Repeated rows and null ids are judged like any other row. Columns beyond
    doc_id and text are ignored whatever their names; an empty table gives no rows.
    """
    return _verdicts(_scored(docs, model), model)


def _scored(docs: DataFrame, model: Model, among: Sieve | None = None) -> DataFrame:
    """Counts and score of every document, or of those whose ids (none null) the bitmap lets through."""
    context = docs.sparkSession.sparkContext
    shared, sieve = context.broadcast(model.shared()), context.broadcast(among)  # two numbers per bucket, a bitmap

    def run(batches):
        judge = Judge(shared.value)
        kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 2
        for batch in batches:
            if sieve.value is not None:
                batch = batch.filter(pa.array(sieve.value(batch.column("doc_id").to_numpy())))
            columns = list(zip(*map(judge.both, texts_of(batch)))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_plain", "_other"],
            )

    # texts stay where they are: only these few numbers meet the trusted ids
    rows = _flagged(_texts(docs).mapInArrow(run, SCHEMA.replace("kept boolean, score double", "_plain double, _other double")), model.ids(docs.sparkSession), "_trusted")
    return rows.withColumn("score", F.when(F.col("_trusted"), F.col("_other")).otherwise(F.col("_plain"))).drop("_trusted", "_plain", "_other")


def _verdicts(rows: DataFrame, model: Model) -> DataFrame:
    kept = ~F.col("base_failed") & (F.col("score") >= float(model.threshold))
    return rows.withColumn("kept", F.coalesce(kept, F.lit(False))).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns. Every text is judged once, by one Python step of a task."""
    context, trusted = docs.sparkSession.sparkContext, model.ids(docs.sparkSession)
    trust = Trust(docs, trusted)
    shared, told, threshold = context.broadcast(model.shared()), context.broadcast(trust), float(model.threshold)

    def verdict(of_open: bool):
        """Kept as an untrusted text (1), as a trusted one (2), as both (3) or not at all (0); open ids or the others, which are one of the two."""

        @F.pandas_udf("int")
        def run(ids: pd.Series, there: pd.Series, texts: pd.Series) -> pd.Series:
            judge, out = Judge(shared.value), []
            for t, state in zip(texts, np.where(there, told.value(pa.array(ids)), Trust.NO)):
                if (state == Trust.OPEN) != of_open:
                    out.append(0)
                    continue
                *_, failed, plain, other = judge.both(t or "")
                asked = {Trust.NO: 1, Trust.YES: 2, Trust.OPEN: 3}[int(state)]
                out.append(0 if failed else asked & (int(plain >= threshold) + 2 * int(other >= threshold)))
            return pd.Series(out, dtype="int32")

        ids = F.col("doc_id").cast("long")
        return run(F.coalesce(ids, F.lit(0)), ids.isNotNull(), F.col("text").cast("string"))

    kept = docs.filter(verdict(False) > 0)
    if not trust.all_told:
        said, name = fresh(docs, "_said"), fresh(docs, "_trusted")
        some = _flagged(docs.withColumn(said, verdict(True)).filter(F.col(said) > 0), trusted, name)
        kept = kept.unionAll(some.filter(F.col(said).bitwiseAND(F.when(F.col(name), 2).otherwise(1)) > 0).drop(said, name))
    return kept


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``fit`` over all documents, then ``score`` every one of them; the texts are scored once for both."""
    model, marked = _counted(docs, labels)
    rows = stored(_scored(docs, model), "zstd")
    if model.target_size:
        model.threshold = _threshold(rows.filter("doc_id is not null"), marked)
    return _verdicts(rows, model)
