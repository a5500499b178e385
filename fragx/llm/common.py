"""What the operators of this package share: tables, word hashes, and frames written once to the shared folder."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fragx.session import ensure_checkpoint_dir

WORD_CACHE = 300_000
#: Bits of the filter that keeps rows without a partner out of a shuffle; when it is full, it lets all through.
BITS = 1 << 24
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` written once to the folder all executors share and read back.

    Later uses neither repeat the work nor see another cut of it, and a lost
    executor costs nothing. The files go with the folder.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixing of unsigned 64-bit values: equal inputs only give equal outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words (bytes between ASCII white space), remembered up to a bound."""

    def __init__(self, limit: int = WORD_CACHE):
        self.limit, self.known = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            found = [known[w] for w in words]
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            found = [known[w] for w in words]
        return np.array(found, np.uint64)


_rng = np.random.default_rng(20240229)
#: A random number per byte, and an odd base: a word's hash is the sum of its bytes' numbers times powers of the base.
BYTES, BASE = _rng.integers(1, 1 << 63, 256, np.uint64), np.uint64(0x9E6C63D0876A9A47)


def token_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between spaces, without a step per word."""
    letters = np.frombuffer(data, np.uint8)
    inside = letters != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(letters))
    offset = place - np.maximum.accumulate(np.where(first, place, 0))
    powers = np.cumprod(np.full(int(offset.max()) + 1, BASE))
    return mix64(np.add.reduceat(np.where(inside, BYTES[letters] * powers[offset], np.uint64(0)), starts))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` words, from the words' hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    size = len(words) - n + 1
    out = np.zeros(size, np.uint64)
    # doubling: a run of n words is made of runs whose lengths are powers of two
    run, length, at, left = words, 1, 0, n
    while left:
        if left & 1:
            out = mix64(out * GOLDEN + run[at : at + size] + np.uint64(length))
            at += length
        left >>= 1
        if left:
            run = mix64(run[: len(run) - length] * GOLDEN + run[length:] + np.uint64(length))
            length *= 2
    return out


def window_sums(words: np.ndarray, n: int) -> np.ndarray:
    """For every run of ``n`` words the sum of their hashes times powers of a base: cheaper than ``gram_hashes``, to be mixed at the end."""
    size = len(words) - n + 1
    out, run, length, at, power = np.zeros(size, np.uint64), words, 1, 0, int(BASE)
    while True:
        if n & 1:
            out = out * np.uint64(power) + run[at : at + size]
            at += length
        n >>= 1
        if not n:
            return out
        run = run[: len(run) - length] * np.uint64(power) + run[length:]
        length, power = 2 * length, power * power % (1 << 64)


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, from minima of shorter spans that overlap."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values = np.minimum(values[: len(values) - step], values[step:])
        span += step
    return values


def texts_of(batch, name: str = "text") -> list[str]:
    """A column of texts; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hash_sample(df: DataFrame, columns: list[str], wanted: int, total: int) -> DataFrame:
    """About ``wanted`` of ``total`` distinct rows, the same ones each time; all rows if there are no more.

    Rows whose hash is below a bound: no task sorts or gathers more than its
    own share, unlike an ordered limit, of which every task sends its best.
    """
    if total <= wanted:
        return df
    place = F.xxhash64(*columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    return df.filter(place < F.lit(int((1 << 63) * (wanted / total))))


class Sieve:
    """A bitmap of fixed size that holds all values of a column: what it doesn't know isn't there."""

    def __init__(self, values: DataFrame, column: str):
        spot = values.select(F.col(column).bitwiseAND(F.lit(BITS - 1)).alias("spot"))
        words = spot.groupBy(F.expr("shiftright(spot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits"))
        self.words, found = np.zeros(BITS // 64, np.int64), words.toArrow()
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy()

    def __call__(self, values: np.ndarray) -> np.ndarray:
        spot = values & (64 * len(self.words) - 1)
        return (self.words[spot >> 6] >> (spot & 63)) & 1 == 1


def sieved(df: DataFrame, column: str, values: DataFrame | Sieve) -> DataFrame:
    """``df`` without most rows whose ``column`` isn't among the values."""
    sieve = df.sparkSession.sparkContext.broadcast(values if isinstance(values, Sieve) else Sieve(values, column))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(sieve.value(batch.column(column).to_numpy())))

    return df.mapInArrow(run, df.schema)
