"""Packing of tokenised documents into sequences: shortest pack first over the histogram of lengths.

Documents are cut at multiples of the sequence length; what is left over is
one piece. Only the histogram of piece lengths, bounded by the sequence
length, reaches the driver: lengths are placed longest first into the pack
with most room, as counts of packing patterns. Pieces then get a rank within
their length and find their pattern, sequence and offset by that rank.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fragx.llm.bpe import blocks
from fragx.llm.common import stored, texts_of

LENGTH = 2048
END_ID = 1
#: Distinct runs that a worker remembers from task to task; beyond it the memory starts anew.
REMEMBERED = 250_000
#: Rows of one length that one task ranks, about.
RANK_ROWS = 200_000
RUNS_A_CALL = 2000


class RunTokenizer:
    """Texts to little-endian 32-bit ids with a tokenizer file; each distinct run between spaces is encoded once.

    A text is looked up run by run if no run begins or ends with white space,
    since byte-level pre-tokenization then never joins two runs; any other
    text is encoded as a whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([str(self.tokenizer.id_to_token(i)).startswith("Ġ") for i in range(size)])
        self.runs: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        plain = []
        for run in new:
            if not run or run[0].isspace() or run[-1].isspace():
                self.runs[run] = None
            else:
                plain.append(run)
        calls = [plain[i : i + RUNS_A_CALL] for i in range(0, len(plain), RUNS_A_CALL)]
        for runs, encoded in zip(calls, self.tokenizer.encode_batch_fast([" " + " ".join(c) for c in calls], add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            starts = np.flatnonzero(self.opens[ids])  # runs hold no space, so only their first token opens with one
            if len(starts) != len(runs):
                for run in runs:
                    self.runs[run] = self._whole(" " + run)
                continue
            held = ids.tobytes()
            edges = [*(starts * 4).tolist(), len(held)]
            for run, a, b in zip(runs, edges, edges[1:]):
                self.runs[run] = held[a:b]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.runs) > self.remembered:
            self.runs.clear()
        split = [text.split(" ") for text in texts]
        runs = self.runs
        self._learn(list(dict.fromkeys(r for parts in split for r in parts[1:] if r not in runs)))
        out = []
        for text, parts in zip(texts, split):
            head, tail = parts[0], [runs[r] for r in parts[1:]]
            if None in tail or (tail and (not head or head[-1].isspace())):
                out.append(self._whole(text))
            else:
                out.append(b"".join([self._whole(head) if head else b"", *tail]))
        return out


_TOKENIZERS: dict[str, RunTokenizer] = {}


def tokenizer_of(path: str) -> RunTokenizer:
    """The worker's tokenizer, kept from task to task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = RunTokenizer(path)
    return _TOKENIZERS[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``length`` ids of every whole text with its end id; a null text is its end id alone."""

    def run(batches):
        tokenizer, end = tokenizer_of(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in blocks(batch, 4_000_000):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenizer(texts_of(part))):
                    ids += end
                    total = len(ids) // 4
                    for at in range(0, total, length):
                        piece = ids[4 * at : 4 * (at + length)]
                        rows.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), total))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and their counts. Longest lengths come first; each goes where most room is left."""
    by_room: dict[int, dict[tuple[int, ...], int]] = {}

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if count:
            packs = by_room.setdefault(room, {})
            packs[pattern] = packs.get(pattern, 0) + count

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max(by_room, default=-1)
            if room < size:
                fit = length // size
                put((size,) * fit, length - fit * size, left // fit)
                put((size,) * (left % fit), length - left % fit * size, 1 if left % fit else 0)
                break
            pattern, count = by_room[room].popitem()
            if not by_room[room]:
                del by_room[room]
            used = min(count, left)
            put(pattern, room, count - used)
            put((*pattern, size), room - size, used)
            left -= used
    return [(pattern, count) for _, packs in sorted(by_room.items()) for pattern, count in sorted(packs.items())]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of ranks of each length, and the first sequence and the offset of the slot that they fill."""
    rows, used, sequence = [], {}, 0
    for pattern, count in patterns:
        at = 0
        for size in pattern:
            first = used.get(size, 0)
            rows.append((size, first, sequence, at))
            used[size] = first + count
            at += size
        sequence += count
    rows.sort()
    return dict(zip(("length", "first", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T))


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and its place there; sequences fill from 0 without gaps.

    A null text is empty and gives its end id. Repeated rows are packed like
    any other; null ids stay null. Columns beyond doc_id and text are ignored;
    an empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, length, end_id))
    total = pieces.count()
    buckets = max(8, total // RANK_ROWS)
    # ranks within a length: every length is split over buckets by a hash, so a common length is many small windows
    spread = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = spread.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32")
    ranked = spread.withColumn("_r", F.row_number().over(within) - 1).join(offsets, ["length", "_b"])
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # ``length`` rows at most
    slots = docs.sparkSession.sparkContext.broadcast(_slots(shortest_pack_first(histogram, length)))

    def place(batches):
        slot = slots.value
        # lengths and ranks as one ascending key; a length has fewer than 2**48 pieces
        keys = (slot["length"] << 48) | slot["first"]
        for batch in batches:
            sizes = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (sizes << 48) | rank, side="right") - 1
            sequence = slot["sequence"][at] + rank - slot["first"][at]
            kept = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(slot["offset"][at])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    rank = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_r") + F.col("_before")).cast("long").alias("_rank"))
    return rank.mapInArrow(place, PIECES + ", sequence_id long, offset long")
