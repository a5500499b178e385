"""Slices of a reference genome for many sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fragx.functions.common import ascii_cut, floor_div
from fragx.operators.skew import DEFAULT_HOT_ROWS, salted_join

CHUNK, OVERLAP = 10_000, 1_000


def chunk_genome(
    genome: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP, contig: str = "contig", seq: str = "seq"
) -> DataFrame:
    """Contigs cut into overlapping chunks (contig, chunk_id, chunk_start, chunk_seq).

    A window that starts in a chunk and is no longer than ``overlap`` lies inside it.
    """
    starts = F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.octet_length(F.col(seq)) - 1) / chunk).cast("long"))
    ).alias("chunk_id")
    cut = genome.filter(F.octet_length(F.col(seq)) > 0).select(contig, seq, starts)
    return cut.select(
        F.col(contig).alias("contig"), "chunk_id", (F.col("chunk_id") * chunk).alias("chunk_start"),
        ascii_cut(seq, (F.col("chunk_id") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("chunk_seq"),
    )


def chunks_of_lines(lines: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of ``chunk_genome`` from sequence lines (contig, offset, bases); no row is longer than a chunk.

    A line goes to the one or two chunks that show a part of it, and a chunk
    gathers at most ``chunk + overlap`` bases.
    """
    end = F.col("offset") + F.length("bases")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("offset") - (chunk + overlap) + 1) / F.lit(chunk)).cast("long"))
    parts = lines.select("contig", "offset", "bases", F.explode(F.sequence(first, floor_div(end - 1, chunk))).alias("chunk_id"))
    start = F.col("chunk_id") * chunk
    lo, hi = F.greatest(F.col("offset"), start), F.least(end, start + chunk + overlap)
    piece = F.substring(F.col("bases"), (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int"))
    packed = parts.groupBy("contig", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("offset", piece.alias("t")))).alias("_p"))
    # the last chunk of a contig may show only what the one before it overlaps; it then has no start of its own
    text = F.array_join(F.transform("_p", lambda p: p["t"]), "")
    return packed.select("contig", "chunk_id", (F.col("chunk_id") * chunk).alias("chunk_start"), text.alias("chunk_seq"))


def spell(
    spans: DataFrame, chunks: DataFrame, contig: str, start: str, size: str, name: str, chunk: int = CHUNK
) -> DataFrame:
    """``spans`` (contig, start, size; distinct) plus their reference text, put together from as many chunks as they touch.

    Meant for the few spans longer than the overlap of chunks. A span beyond the contig is cut at its end.
    """
    ids = F.sequence(floor_div(start, chunk), floor_div(F.col(start) + F.col(size) - 1, chunk))
    pieces = spans.select(contig, start, size, F.explode(ids).alias("chunk_id")).join(
        chunks.select(F.col("contig").alias(contig), "chunk_id", "chunk_start", "chunk_seq"), [contig, "chunk_id"]
    )
    first = F.greatest(F.col(start), F.col("chunk_start"))
    last = F.least(F.col(start) + F.col(size), F.col("chunk_start") + chunk)
    text = ascii_cut("chunk_seq", (first - F.col("chunk_start") + 1).cast("int"), (last - first).cast("int"))
    parts = pieces.groupBy(contig, start, size).agg(F.array_sort(F.collect_list(F.struct("chunk_id", text.alias("t")))).alias("_p"))
    return parts.select(contig, start, size, F.array_join(F.transform("_p", lambda p: p["t"]), "").alias(name))


def ref_window(
    sites: DataFrame,
    chunks: DataFrame,
    before: int,
    after: int,
    pos: str = "pos",
    contig: str = "contig",
    name: str = "window",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    whole_only: bool = True,
    hot_rows: int | None = DEFAULT_HOT_ROWS,
) -> DataFrame:
    """Reference bases ``[pos - before, pos + after)`` upper-cased.

    A window longer than ``overlap`` is put together from several chunks.
    With ``whole_only`` sites whose window leaves the contig drop out, else it is cut at the ends.
    """
    start = F.col(pos) - before
    clipped = F.greatest(start, F.lit(0))
    left = sites.withColumn("chunk_id", floor_div(clipped, chunk))
    if whole_only:
        left = left.filter(start >= 0)
    if before + after > overlap:
        wide = left.select(F.col(contig).alias("_wc"), clipped.alias("_ws"), (F.col(pos) + after - clipped).alias("_wn")).distinct()
        spelled = spell(wide, chunks, "_wc", "_ws", "_wn", name, chunk)
        same = (F.col(contig) == F.col("_wc")) & (clipped == F.col("_ws")) & (F.col(pos) + after - clipped == F.col("_wn"))
        out = left.join(spelled, same).select(*sites.columns, F.upper(name).alias(name))
        return out.filter(F.length(name) == before + after) if whole_only else out
    right = chunks.withColumnRenamed("contig", contig)
    joined = salted_join(left, right, [contig, "chunk_id"], None, "inner", hot_rows)
    text = F.upper(
        ascii_cut(
            "chunk_seq", (clipped - F.col("chunk_start") + 1).cast("int"),
            (F.col(pos) + after - clipped).cast("int"),
        )
    )
    out = joined.withColumn(name, text).select(*sites.columns, name)
    return out.filter(F.length(name) == before + after) if whole_only else out
