"""Coordinates moved to another assembly through a table of aligned blocks."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fragx.functions.common import floor_div
from fragx.operators.intervals import interval_overlap_join, mean_length, point_in_interval_join

BLOCK_COLUMNS = ["src_contig", "src_start", "src_end", "tgt_contig", "tgt_start", "strand", "block"]


class _Sweep:
    """The first block at each place of one bucket; blocks come by start."""

    def __init__(self):
        self.heap, self.at, self.pieces = [], None, []

    def add(self, start: int, end: int, key: tuple, row: dict) -> None:
        self.reach(start)
        # a block that an earlier one outlasts is nowhere the first
        if not (self.heap and self.heap[0][0] < key and self.heap[0][1] >= end):
            heappush(self.heap, (key, end, row))

    def reach(self, to: int | None) -> None:
        """Pieces up to ``to``, or to the end."""
        while self.heap and (to is None or self.at < to):
            key, end, row = self.heap[0]
            if end <= self.at:
                heappop(self.heap)
                continue
            stop = end if to is None else min(end, to)
            if self.pieces and self.pieces[-1][2] is row and self.pieces[-1][1] == self.at:
                self.pieces[-1][1] = stop
            else:
                self.pieces.append([self.at, stop, row])
            self.at = stop
        self.at = to


def first_blocks(chain: DataFrame, width: Column | None = None) -> DataFrame:
    """Disjoint pieces (src_contig, _ps, _pe, ``_first``) of the source, each with the first block that holds it.

    However many blocks overlap, a place is in one piece. Blocks are cut at buckets of ``width``, by default their mean
    length, and a task sweeps a bucket by start; it holds the blocks of one bucket that may still be the first somewhere.
    """
    width = mean_length((chain, "src_start", "src_end")) if width is None else width
    used = chain.select(*BLOCK_COLUMNS).filter(F.col("src_end") > F.col("src_start"))
    cut = used.select("*", F.explode(F.sequence(floor_div("src_start", width), floor_div(F.col("src_end") - 1, width))).alias("_bucket"), width.alias("_width"))
    low = F.greatest(F.col("src_start"), F.col("_bucket") * F.col("_width")).cast("long")
    high = F.least(F.col("src_end"), (F.col("_bucket") + 1) * F.col("_width")).cast("long")
    rows = cut.select("src_contig", "_bucket", low.alias("_ps"), high.alias("_pe"), "block", F.struct(*BLOCK_COLUMNS[1:]).alias("_first"))
    types = dict(rows.dtypes)
    schema = f"src_contig {types['src_contig']}, _ps long, _pe long, _first {types['_first']}"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sweep, n = None, None, 0
        for batch in batches:
            done = []
            for contig, bucket, start, end, block, row in zip(*[batch.column(c).to_pylist() for c in ("src_contig", "_bucket", "_ps", "_pe", "block", "_first")]):
                if (contig, bucket) != place:
                    if sweep is not None:
                        sweep.reach(None)
                        done += [(place[0], *piece) for piece in sweep.pieces]
                    place, sweep = (contig, bucket), _Sweep()
                n += 1
                sweep.add(start, end, (block is None, block, n), row)
            kind = batch.schema.field("_first").type
            if done:
                yield _pieces(done, batch.schema.field("src_contig").type, kind)
        if sweep is not None:
            sweep.reach(None)
            yield _pieces([(place[0], *piece) for piece in sweep.pieces], batch.schema.field("src_contig").type, batch.schema.field("_first").type)

    return rows.repartition("src_contig", "_bucket").sortWithinPartitions("src_contig", "_bucket", "_ps", "block").mapInArrow(walk, schema)


def _pieces(done: list[tuple], contig: pa.DataType, first: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*done))
    kinds = [contig, pa.int64(), pa.int64(), first]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["src_contig", "_ps", "_pe", "_first"])


def lift_points(
    points: DataFrame, chain: DataFrame, key: str, contig: str = "contig", pos: str = "pos"
) -> DataFrame:
    """Target of every point, from its first block; null when no block holds it. ``key`` identifies a point.

    A point meets one piece at most (``first_blocks``), so points are neither multiplied by blocks nor grouped.
    """
    width = mean_length((chain, "src_start", "src_end"))
    pieces = first_blocks(chain, width).withColumnRenamed("src_contig", contig)
    met = point_in_interval_join(points, pieces, [contig], pos, "_ps", "_pe", width, "left", hot_rows=None)
    offset, back = F.col(pos) - F.col("_first.src_start"), F.col("_first.src_end") - 1 - F.col(pos)
    target = F.col("_first.tgt_start") + F.when(F.col("_first.strand") == "+", offset).otherwise(back)
    return met.select(*[F.col(c) for c in points.columns], F.col("_first.tgt_contig").alias("tgt_contig"), target.alias("tgt_pos"), F.col("_first.strand").alias("strand"))


def lift_ranges(
    ranges: DataFrame, chain: DataFrame, key: str, contig: str = "contig", start: str = "st", end: str = "en"
) -> DataFrame:
    """A range maps only when every base maps; adds ``lifted``, ``tgt_min`` and ``tgt_max``.

    Ranges meet the disjoint pieces of ``first_blocks`` in an overlap join and are
    compared by clipped lengths, so a row stands for a piece, not for a base or a block.
    """
    spans = ranges.select(key, F.col(contig).alias("_contig"), F.col(start).cast("long").alias("_rs"), F.col(end).cast("long").alias("_re"))
    width = mean_length((chain, "src_start", "src_end"))
    pieces = first_blocks(chain, width).withColumnRenamed("src_contig", "_contig")
    rows = interval_overlap_join(spans, pieces, ["_contig"], ("_rs", "_re"), ("_ps", "_pe"), width, hot_rows=None, clip=True)
    rows = rows.select(key, "clip_start", "clip_end", "_first.*")
    forward = F.col("strand") == "+"
    low = F.col("tgt_start") + F.when(forward, F.col("clip_start") - F.col("src_start")).otherwise(F.col("src_end") - F.col("clip_end"))
    found = rows.groupBy(key).agg(
        F.sum(F.col("clip_end") - F.col("clip_start")).alias("_n"), F.min(low).alias("_lo"),
        F.max(low + F.col("clip_end") - F.col("clip_start") - 1).alias("_hi"),
    )
    whole = F.coalesce(F.col("_n") == F.col(end) - F.col(start), F.lit(False))
    return ranges.join(found, key, "left").select(
        *ranges.columns, whole.alias("lifted"),
        F.when(whole, F.col("_lo")).alias("tgt_min"), F.when(whole, F.col("_hi")).alias("tgt_max"),
    )
