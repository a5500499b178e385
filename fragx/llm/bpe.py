"""Byte-level BPE for a corpus: the merges replayed over all distinct words at once.

A block of distinct words is one array of symbols with links to the next and
previous live symbol. An inverted index holds, for every pair of symbols that
can merge, the positions where it stands. Merges are applied in rank order,
each at all its positions, and only the touched neighbours enter the index
anew. Texts are then looked up word by word.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, functions as F

from fragx.llm.common import texts_of

#: Distinct words a task remembers; beyond it the memory starts anew, which costs time only.
REMEMBERED = 800_000
#: Characters of text whose new words are merged together.
BLOCK = 12_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many words together by replaying merges over an inverted index of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.numbers = np.array(range(max(ranks.values()) + 1), object)  # one int object per id, whoever remembers it
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every split of a token into two tokens is a pair that merges into it
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # tokens that can meet a neighbour in a pair of a lower rank than their own
        lower = {t for k, r in pairs.items() for t in (k >> 32, k & 0xFFFFFFFF) if r < t}
        self.one_by_one = np.zeros(max(ranks.values()) + 1, bool)
        self.one_by_one[list(lower)] = True

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token each pair merges into, -1 for none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is None and word:
                rest.append(i)
            else:
                out[i] = [whole] if word else []
        if not rest:
            return out
        lengths = np.array([len(words[i]) for i in rest])
        ends = np.cumsum(lengths)
        symbol = self.single[np.frombuffer(b"".join(words[i] for i in rest), np.uint8)]
        owner = np.repeat(np.arange(len(rest)), lengths)
        n = len(symbol)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = n  # n and -1: no neighbour
        before[ends - lengths] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        pair_rank = np.full(n, -1, np.int64)  # what the pair that begins here merges into

        def enter(left: np.ndarray) -> None:
            """Put the pairs that begin at ``left`` into the index, by the rank they merge at."""
            rank = pair_rank[left] = self._rank(symbol[left], symbol[following[left]])
            keep = rank >= 0
            left, rank = left[keep], rank[keep]
            if not len(left):
                return
            if len(left) > 1:
                order = np.argsort(rank, kind="stable")
                left, rank = left[order], rank[order]
                cuts = (np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()
            else:
                cuts = []
            for start, end in zip([0, *cuts], [*cuts, len(left)]):
                r = int(rank[start])
                if r in index:
                    index[r].append(left[start:end])
                else:
                    index[r] = [left[start:end]]
                    heapq.heappush(queue, r)

        enter(np.flatnonzero(following < n))
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank)
            left = np.unique(np.concatenate(places)) if len(places) > 1 else np.sort(places[0])
            left = left[pair_rank[left] == rank]
            if not len(left):
                continue
            if len(left) > 1:
                if self.one_by_one[rank]:
                    # only the leftmost of a word: the pair it makes may rank lower than the next place
                    first = np.ones(len(left), bool)
                    first[1:] = owner[left[1:]] != owner[left[:-1]]
                else:
                    # of places that overlap (aaa) every other one, from the left
                    chained = np.zeros(len(left), bool)
                    chained[1:] = following[left[:-1]] == left[1:]
                    at = np.arange(len(left))
                    first = (at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 0
                if not first.all():
                    if self.one_by_one[rank]:
                        index[rank] = [left[~first]]
                        heapq.heappush(queue, rank)
                    left = left[first]
            right = following[left]
            after = following[right]
            symbol[left] = rank
            alive[right] = False
            pair_rank[right] = -1
            pair_rank[left] = -1
            following[left] = after
            has_after = after < n
            before[after[has_after]] = left[has_after]
            previous = before[left]
            enter(np.unique(np.concatenate([left[has_after], previous[previous >= 0]])))
        live = np.flatnonzero(alive)
        counts = np.bincount(owner[live], minlength=len(rest))
        ids = self.numbers[symbol[live]].tolist()
        at = 0
        for i, c in zip(rest, counts.tolist()):
            out[i] = ids[at : at + c]
            at += c
        return out


class CorpusEncoder:
    """Texts to ids. Words are split once per distinct run between spaces and merged once per distinct word."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.replay, self.pattern, self.remembered = MergeReplay(ranks), regex.compile(pattern), remembered
        self.runs: dict[str, tuple | None] = {}
        self.words: dict[str, tuple] = {}

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        for word, ids in zip(new, self.replay([w.encode("utf-8", "replace") for w in new])):
            self.words[word] = tuple(ids)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text, as if each match of the pattern were encoded by itself.

        A run is what stands between two spaces, with the space before it. If
        no run begins or ends with white space, no match of the pattern spans
        two runs, so runs are looked up; other texts are matched as a whole.
        """
        if len(self.runs) + len(self.words) > self.remembered:
            self.runs.clear()
            self.words.clear()
        runs, split, heads = self.runs, [], []
        new: dict[str, list[str] | None] = {}
        for text in texts:
            head, *tail = text.split(" ")
            split.append((head, tail))
            heads.append(self.pattern.findall(head))
            for piece in tail:
                if piece not in runs and piece not in new:
                    odd = not piece or piece[0].isspace() or piece[-1].isspace()
                    new[piece] = None if odd else self.pattern.findall(" " + piece)
        self._learn(w for words in [*new.values(), *heads] if words for w in words)
        known = self.words
        for piece, words in new.items():
            runs[piece] = None if words is None else tuple(i for w in words for i in known[w])
        out = []
        for text, (head, tail), words in zip(texts, split, heads):
            parts = [runs[p] for p in tail]
            if None in parts or (tail and (not head or head[-1].isspace())):
                words, parts = self.pattern.findall(text), []
                self._learn(words)
            out.append([*chain.from_iterable(map(known.__getitem__, words)), *chain.from_iterable(parts)])
        return out


_ENCODERS: dict[str, CorpusEncoder] = {}


def encoder_of(path: str, pattern: str) -> CorpusEncoder:
    """The worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CorpusEncoder(read_ranks(path), pattern)
    return _ENCODERS[path]


def blocks(batch: pa.RecordBatch, characters: int = BLOCK):
    """Slices of a batch with about so many characters of text each; a longer text is a slice by itself."""
    start = size = 0
    for i, length in enumerate(pa.compute.utf8_length(batch.column("text")).to_pylist()):
        if size and size + (length or 0) > characters:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids again, and return the count and digests of both.

    A null text is empty: 0 ids, digests of the empty string. Any id, repeated
    rows and further columns pass; an empty table gives no rows. Each task
    reads the rank file, whose path all workers must know.
    """

    def run(batches):
        encoder = encoder_of(ranks_path, pattern)
        ranks = encoder.replay.ranks
        token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            token[r] = t
        decimal = [str(i) for i in range(len(token))]
        for batch in batches:
            for part in blocks(batch):
                ids = encoder.encode(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(" ".join([decimal[i] for i in x]).encode()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(b"".join([token[i] for i in x])).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*cols).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
