"""Language identification, word first: known words by log frequency, unseen words by ever shorter n-grams."""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fragx.llm.common import shuffle_tasks, stored, texts_of

#: Words and n-grams of all languages together in the model; it is collected and broadcast.
MAX_WORDS = 200_000
MAX_GRAMS = 100_000
LONGEST_GRAM = 5
#: Added to the largest log10 penalty for what a language has never shown.
UNSEEN = 1.0
LETTERS = re.compile(r"[^\W\d_]+")
FLUSH = 200_000


def letter_words(piece: str) -> list[str]:
    """Lower-case runs of letters."""
    return [w for w in LETTERS.findall(piece.lower()) if any(map(str.isalpha, w))]


def _capped(counts: DataFrame, value: str, limit: int) -> DataFrame:
    """Per language the entries of the largest counts, about ``limit``, without sorting the entries.

    The histogram of counts gives the smallest count that fits as a whole, so no
    task sees a language. Of the entries that tie at the next count those of the
    smallest hashes fill what is left: rare entries of equal counts neither all
    go nor all stay.
    """
    shape = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("entries"))
    above = shape.withColumn("upto", F.sum("entries").over(Window.partitionBy("lang").orderBy(F.desc("n"))))
    fits = F.col("upto") <= limit
    room = F.try_divide(F.lit(limit) - (F.col("upto") - F.col("entries")), F.col("entries"))
    cut = above.groupBy("lang").agg(  # one row per language
        F.min(F.when(fits, F.col("n"))).alias("whole"), F.max(F.when(~fits, F.struct("n", room.alias("share")))).alias("part")
    )
    place = F.xxhash64(value).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    kept = (F.col("n") >= F.col("whole")) | ((F.col("n") == F.col("part.n")) & (place < F.col("part.share")))
    return counts.join(F.broadcast(cut), "lang").filter(kept).select("lang", value, "n")


def word_counts(train: DataFrame) -> DataFrame:
    """(lang, word, n) over all given documents; tasks combine before the shuffle.

    A flush looks for words in the distinct strings between white space only.
    """

    def count(batches):
        found: dict[str, Counter] = {}  # by what stands between white space: letters are searched once per flush

        def out():
            rows = []
            for lang, pieces in found.items():
                words: Counter = Counter()
                for piece, n in pieces.items():
                    for word in LETTERS.findall(piece):
                        words[word] += n
                rows += [(lang, word, n) for word, n in words.items()]
            found.clear()
            kinds = ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())
            columns = list(zip(*rows)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

        for batch in batches:
            for text, lang in zip(texts_of(batch), batch.column("lang").to_pylist()):
                found.setdefault(lang, Counter()).update(text.lower().split())
                if sum(map(len, found.values())) > FLUSH:
                    yield out()
        yield out()

    rows = train.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, gram, n) of the 1- to 5-grams of all counted words, each word between spaces.

    The table of words is small beside its n-grams, so it is dealt over all
    tasks first; tasks combine before the shuffle and hold at most what one word
    adds to ``FLUSH`` n-grams.
    """

    def count(batches):
        found: dict[str, dict[str, int]] = {}

        def out():
            langs = np.repeat(np.array(list(found), object), [len(grams) for grams in found.values()])
            grams = [g for grams in found.values() for g in grams]
            counts = [n for grams in found.values() for n in grams.values()]
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"]
            )

        held = 0
        for batch in batches:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                known, padded = found.setdefault(lang, {}), f" {word} "
                before = len(known)
                for length in range(1, LONGEST_GRAM + 1):
                    for at in range(len(padded) - length + 1):
                        gram = padded[at : at + length]
                        known[gram] = known.get(gram, 0) + n
                held += len(known) - before
                if held > FLUSH:
                    yield out()
                    held = 0
        yield out()

    dealt = words.select("lang", "word", "n").repartition(shuffle_tasks(words.sparkSession), "lang", "word")
    rows = dealt.mapInArrow(count, "lang string, gram string, n long").filter(F.col("gram") != " ")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> dict:
    """Penalties (negative log10 frequency per language) of words and n-grams.

    All training documents are counted, and the n-grams of all their words, on
    Spark. The model that goes to the tasks keeps the most frequent entries,
    about ``max_words`` and ``max_grams`` over all languages; their frequencies
    are those in the whole corpus. A word beyond that is scored by its n-grams,
    like any word that was never seen, so no language depends on the limit.
    """
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = stored(word_counts(train))
    sizes = {lang: n for lang, n in counted.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "words": {}, "word_rows": np.empty((0, 0)), "grams": {}, "gram_rows": np.empty((0, 0)), "prior": 0}
    spread = stored(gram_counts(counted))
    lengths = spread.groupBy("lang", F.length("gram").alias("length")).agg(F.sum("n").alias("n"))
    gram_sizes = {(lang, length): n for lang, length, n in lengths.collect()}  # five per language
    words = _capped(counted, "word", max(1, max_words // len(langs))).toArrow()
    grams = _capped(spread, "gram", max(1, max_grams // len(langs))).toArrow()
    at = {lang: i for i, lang in enumerate(langs)}

    def penalties(entries, total):
        lang, values, n = (column.to_pylist() for column in entries.columns)
        logs = -np.log10(np.array(n, float) / np.array([total(*entry) for entry in zip(lang, values)], float))
        index = {value: i for i, value in enumerate(dict.fromkeys(values))}
        rows = np.full((len(index), len(langs)), logs.max(initial=0) + UNSEEN, np.float32)
        rows[[index[value] for value in values], [at[x] for x in lang]] = logs
        return index, rows

    word_index, word_rows = penalties(words, lambda lang, _: sizes[lang])
    gram_index, gram_rows = penalties(grams, lambda lang, gram: gram_sizes[lang, len(gram)])
    prior = max(range(len(langs)), key=lambda i: sizes[langs[i]])
    return {"langs": langs, "words": word_index, "word_rows": word_rows, "grams": gram_index, "gram_rows": gram_rows, "prior": prior}


def evidence(word: str, words: dict[str, int], grams: dict[str, int]) -> tuple[bool, list[int]]:
    """Whether the word is known, and its row, or the rows of its longest n-grams that are known."""
    known = words.get(word)
    if known is not None:
        return True, [known]
    padded = f" {word} "
    for n in range(min(LONGEST_GRAM, len(padded)), 0, -1):
        found = [g for g in [grams.get(padded[i : i + n]) for i in range(len(padded) - n + 1)] if g is not None]
        if found:
            return False, found
    return False, []


class Scorer:
    """Penalties of texts. What stands between white space is scored once and remembered up to a bound."""

    def __init__(self, model: dict):
        self.langs, self.prior = model["langs"], model["prior"]
        self.words, self.word_rows = model["words"], model["word_rows"].astype(float)
        self.grams, self.gram_rows = model["grams"], model["gram_rows"].astype(float)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((FLUSH, len(self.langs) + 2))  # sums of penalties, words with evidence, words

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > len(self.rows):
            self.known.clear()
            if len(pieces) > len(self.rows):
                self.rows = np.zeros((len(pieces), self.rows.shape[1]))
        start = len(self.known)
        self.rows[start : start + len(pieces)] = 0
        of_word, word, of_grams, gram, counts, lettered = [], [], [], [], [], []
        for at, piece in enumerate(pieces, start):
            self.known[piece] = at
            for w in letter_words(piece):
                lettered.append(at)
                is_word, found = evidence(w, self.words, self.grams)
                if is_word:
                    of_word.append(at)
                    word += found
                elif found:
                    of_grams.append(at)
                    gram += found
                    counts.append(len(found))
        n = len(self.langs)
        np.add.at(self.rows[:, -1], lettered, 1)
        np.add.at(self.rows[:, :n], of_word, self.word_rows[word])
        if counts:
            sizes = np.array(counts)
            means = np.add.reduceat(self.gram_rows[gram], np.cumsum(sizes) - sizes) / sizes[:, None]
            np.add.at(self.rows[:, :n], of_grams, means)
        np.add.at(self.rows[:, n], of_word + of_grams, 1)

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for start in range(0, len(texts), 256):
            split = [t.split() for t in texts[start : start + 256]]
            new = list(dict.fromkeys(p for pieces in split for p in pieces if p not in self.known))
            if len(self.known) + len(new) > len(self.rows):
                self.known.clear()
                new = list(dict.fromkeys(p for pieces in split for p in pieces))
            self._learn(new)
            known = self.known
            for pieces in split:
                total = self.rows[[known[p] for p in pieces]].sum(axis=0)
                if not self.langs or not total[-1]:
                    out.append(("und", 0.0))
                elif not total[-2]:
                    out.append((self.langs[self.prior], 0.0))
                else:
                    mean = total[:-2] / total[-2]
                    likely = np.exp((mean.min() - mean) * np.log(10))
                    out.append((self.langs[int(mean.argmin())], float(1 / likely.sum())))
        return out


_SCORERS: dict[str, Scorer] = {}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """lang_pred and score of every document from its whole text alone.

    Null texts and texts without a letter give ``und`` with score 0, as does a
    model without languages. Letters without any evidence give the language
    with most training words. Ties go to the name that sorts first.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by the model's limits

    def run(batches):
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer = _SCORERS[name]
        for batch in batches:
            found = scorer(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    cols = [F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")]
    return docs.select(*cols).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out():
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and predict all of them."""
    return predict(docs, fit(docs.filter(~held_out())))
