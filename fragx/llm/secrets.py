"""Secret scan: fixed patterns, and strings in sensitive places that a primed compressor cannot shorten."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from fragx.llm.common import stored, texts_of

# Fixed values of the base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: Words after which, on the same line and within REACH characters, a string may be a secret.
SENSITIVE = re.compile(r"password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization|auth", re.I | re.A)
SENSITIVE_WORDS = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
REACH = 64
CONTEXT = 512
#: Pieces that words are made of, vowels, consonants in a row that no word has, and characters outside such pieces that make a string no name.
PIECE = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
VOWELS = re.compile(r"[aeiouy]", re.I)
CLUSTER = re.compile(r"[b-df-hj-np-tv-xz]{5}", re.I)
LOOSE = 8
#: Marginal compressed bytes per character from which a string counts as incompressible.
NOVELTY = 0.62
DICTIONARY_BYTES = 65_536
DICTIONARY_WORDS = 8_192
DEFAULT_DICTIONARY = b"password secret token key value string import return"
FLUSH = 200_000


def has_word_structure(candidate: str) -> bool:
    """Whether a string is made of pronounceable letter pieces, as names are, but for fewer than ``LOOSE`` characters.

    Separators do not count. A piece has three letters or more, a fifth of
    them vowels at least, and no long run of consonants.
    """
    loose = sum(c not in "+/_.=-" for c in candidate)
    for m in PIECE.finditer(candidate):
        piece = m[0]
        if len(piece) >= 3 and 5 * len(VOWELS.findall(piece)) >= len(piece) and not CLUSTER.search(piece):
            loose -= len(piece)
    return loose < LOOSE


def may_be_secret(word: str) -> bool:
    """Whether a word holds a candidate without word structure."""
    return len(word) >= 16 and any(not has_word_structure(m[0]) for m in CANDIDATE.finditer(word))


def identifier_dictionary(docs: DataFrame, max_words: int = DICTIONARY_WORDS, max_bytes: int = DICTIONARY_BYTES) -> bytes:
    """The commonest identifiers and words of all documents, commonest last, as raw dictionary content.

    Every document is counted; tasks combine first. At most ``max_words`` rows
    reach the driver: the words of the largest counts, all of a count or none.
    """

    def count(batches):
        found: dict = {}

        def out():
            block = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return block

        for batch in batches:
            for text in texts_of(batch):
                for word in text.split():
                    if 3 <= len(word) <= 40:
                        found[word] = found.get(word, 0) + 1
                if len(found) > FLUSH:
                    yield out()
        yield out()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    counted = stored(rows.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"))
    # the smallest count to keep, from the histogram of counts: an ordered limit would gather the best of every task
    shape = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    least = shape.withColumn("upto", F.sum("words").over(Window.orderBy(F.desc("n")))).filter(F.col("upto") <= max_words).agg(F.min("n")).first()[0]
    kept = [] if least is None else counted.filter(F.col("n") >= least).collect()
    top = sorted(kept, key=lambda r: (-r["n"], r["word"]))
    content = b"\n".join(r["word"].encode() for r in reversed(top))[-max_bytes:]
    return content or DEFAULT_DICTIONARY


class Novelty:
    """Marginal compressed size of a string after its context, with a primed dictionary.

    Words of the dictionary that may be secrets themselves are left out however
    common they are, so a leaked string does not make its own copies look known.
    """

    def __init__(self, dictionary: bytes):
        words = [w for w in dictionary.split(b"\n") if not may_be_secret(w.decode("utf-8", "replace"))]
        dictionary = b"\n".join(words) or DEFAULT_DICTIONARY
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=6, dict_data=data, write_content_size=False, write_checksum=False)

    def __call__(self, context: str, candidate: str) -> float:
        before = context.encode("utf-8", "replace")
        size = len(self.compressor.compress(before + candidate.encode())) - len(self.compressor.compress(before))
        return size / len(candidate)


def context_of(text: str, start: int, end: int) -> str:
    """Up to ``CONTEXT`` characters on either side, without further copies of a candidate that has no word structure.

    Copies become spaces of their length, also those that the edge would cut.
    """
    candidate, size = text[start:end], end - start
    before, after = text[max(0, start - CONTEXT - size) : start], text[end : end + CONTEXT + size]
    if not has_word_structure(candidate):
        before, after = before.replace(candidate, " " * size), after.replace(candidate, " " * size)
    return before[-CONTEXT:] + after[:CONTEXT]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed patterns, in code points."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, taken: list, novelty: Novelty, threshold: float) -> list[tuple[int, int, int]]:
    """Incompressible strings after a sensitive word, outside the spans already found."""
    lowered = text.lower()
    if not any(w in lowered for w in SENSITIVE_WORDS):
        return []
    found: dict = {}
    for word in SENSITIVE.finditer(text):
        stop = text.find("\n", word.end())
        stop = len(text) if stop < 0 else stop
        for m in CANDIDATE.finditer(text, word.end(), stop):
            if m.start() > word.end() + REACH:
                break
            if m.start() in found or any(s < m.end() and m.start() < e for s, _, e in taken):
                continue
            if novelty(context_of(text, m.start(), m.end()), m[0]) >= threshold:
                found[m.start()] = (m.start(), 3, m.end())
    return list(found.values())


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def scan(docs: DataFrame, dictionary: bytes, threshold: float = NOVELTY) -> DataFrame:
    """One row per document: counts and all spans of its whole text, code points, end exclusive.

    A null text is empty and has no span; its digest is that of the empty
    string. Repeated rows, null ids and further columns do not matter.
    """

    def run(batches):
        novelty = Novelty(dictionary)
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                base = base_spans(text)
                more = novel_spans(text, base, novelty, threshold)
                kinds = [k for _, k, _ in base]
                digest = hashlib.sha256(render(base).encode()).hexdigest()
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), digest, render(base + more)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def find_secrets(docs: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    return scan(docs, identifier_dictionary(docs), threshold)


def mask(text: str, dictionary_novelty: Novelty, threshold: float = NOVELTY) -> str:
    """``text`` with the secret part of every span replaced by ``<kind>``; of an assignment the name stays."""
    base = base_spans(text)
    spans = sorted(base + novel_spans(text, base, dictionary_novelty, threshold))
    out, at = [], 0
    for start, kind, end in spans:
        if kind == 0:
            start = ASSIGN.match(text, start).start(2)
        start = max(start, at)
        if end > start:
            out += [text[at:start], f"<{KINDS[kind]}>"]
            at = end
    return "".join([*out, text[at:]]) if out else text
