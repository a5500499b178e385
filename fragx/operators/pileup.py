"""Per-position counts of aligned bases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fragx import constants as K
from fragx.functions import reads as R
from fragx.functions.common import ascii_cut, floor_div
from fragx.operators.genome import CHUNK, OVERLAP
from fragx.operators.intervals import READ_WIDTH
from fragx.operators.reads import with_steps
from fragx.operators.skew import DEFAULT_HOT_ROWS, salted_join
from fragx.operators.walks import CELLS, GAP, NO_BASE, UPPER, _Cigars, _flat, _packed, _ramp, _unpacked

SYMBOLS = ["A", "C", "G", "T", "I", "D", "O"]


def delta_rows(
    reads: DataFrame, chunks: DataFrame, by: list[str], min_bq: int = 0, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """What reads say about positions beyond "as the reference": ``by``, chunk_id, pos and

    * ``base``, ``gone``, ``skip``: +1 where a stretch of bases, deleted or skipped positions starts, -1 behind its end;
    * ``less``: bases that are not counted as the reference (other ones, and those below ``min_bq``);
    * ``s``, ``t``, ``c``, ``n``: symbol and text of another base or of an indel, what it adds to the
      counts and to the texts; null for the rows above.

    Stretches are cut at chunks, so each chunk starts at depth 0. One row per
    CIGAR operation meets its chunk, and a stretch leaves two rows and one per
    base that differs, however long it is. A deletion longer than ``overlap``
    has its length as text.
    """
    carried = list(dict.fromkeys([*by, "pos", "seq", *(["qual"] if min_bq else [])]))
    read = reads.filter(F.col("cigar").isNotNull() & F.col("seq").isNotNull())
    located = with_steps(read, carried)
    begins = F.filter("_ops", lambda o: o["op"].isin("M", "=", "X", "D"))
    one = located.select(*carried, F.array_min(F.transform(begins, lambda o: o["r"])).alias("_first"), F.explode("_ops").alias("_o"))
    op, size, start = F.col("_o.op"), F.col("_o.len"), (F.col("pos") + F.col("_o.r")).cast("long")
    block, indel = op.isin("M", "=", "X", "D", "N"), op.isin("I", "D") & (F.col("_first") < F.col("_o.r"))
    none = F.array().cast("array<struct<id:bigint,event:boolean>>")
    ids = F.sequence(floor_div(start, chunk), floor_div(start + size - 1, chunk))
    # an indel belongs to the base before it
    own = F.array(F.struct(floor_div(start - 1, chunk).alias("id"), F.lit(True).alias("event")))
    pieces = F.concat(
        F.when(block & (size > 0), F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(False).alias("event")))).otherwise(none),
        F.when(indel & (size > 0), own).otherwise(none),
    )
    one = one.filter(op.isin("M", "=", "X", "D", "N", "I")).select(*carried, op.alias("_op"), size.alias("_n"), start.alias("_s"), F.col("_o.q").alias("_q"), F.explode(pieces).alias("_p"))
    event, moved = F.col("_p.event"), F.col("_op").isin("M", "=", "X")
    lo = F.when(event, F.col("_s") - 1).otherwise(F.greatest(F.col("_s"), F.col("_p.id") * chunk))
    hi = F.when(event, F.col("_s")).otherwise(F.least(F.col("_s") + F.col("_n"), (F.col("_p.id") + 1) * chunk))
    skipped = (F.col("_q") + lo - F.col("_s")).cast("int")
    before = F.when(F.col("_q") > 0, F.substring(F.col("seq"), F.col("_q"), F.lit(1))).otherwise("")
    bases = (
        F.when(event & (F.col("_op") == "I"), F.concat(before, F.substring(F.col("seq"), F.col("_q") + 1, F.col("_n"))))
        .when(moved & ~event, F.substring(F.col("seq"), skipped + 1, (hi - lo).cast("int")))
    )
    kind = F.when(event, F.when(F.col("_op") == "I", "I").otherwise("D")).when(moved, "M").otherwise(F.when(F.col("_op") == "D", "gone").otherwise("skip"))
    quals = [F.when(moved & ~event, F.slice(F.col("qual"), skipped + 1, (hi - lo).cast("int"))).alias("_quals")] if min_bq else []
    cut = one.select(*by, F.col("_p.id").alias("chunk_id"), kind.alias("_kind"), F.col("_n"), lo.alias("_lo"), (hi - lo).cast("int").alias("_len"), F.upper(bases).alias("_bases"), F.when(event, F.upper(before)).alias("_before"), *quals)
    met = salted_join(cut, chunks, ["contig", "chunk_id"], hot_rows=None)
    at = (F.col("_lo") - F.col("chunk_start") + 1).cast("int")
    wanted = F.when(F.col("_kind") == "D", F.when(F.col("_n") < overlap, F.col("_n") + 1).otherwise(1)).otherwise(F.col("_len"))
    placed = met.select(*by, "chunk_id", "_kind", "_n", "_lo", "_bases", "_before", *(["_quals"] if min_bq else []), F.upper(ascii_cut("chunk_seq", at, wanted)).alias("_ref"))
    placed = placed.filter(F.col("_ref") != "").withColumn("_len", F.length("_ref"))  # nothing beyond the contig
    is_m = F.col("_kind") == "M"
    low = F.exists("_quals", lambda q: q < min_bq) if min_bq else F.lit(False)
    differs = is_m & (low | (F.col("_bases") != F.col("_ref")))
    spots = F.sequence(F.lit(-2), F.when(differs, F.col("_len") - 1).otherwise(-1))
    rows = placed.select("*", F.explode(spots).alias("_i"))
    mine, theirs = F.substring(F.col("_bases"), F.col("_i") + 1, F.lit(1)), F.substring(F.col("_ref"), F.col("_i") + 1, F.lit(1))
    poor = (F.get(F.col("_quals"), F.col("_i")) < min_bq) if min_bq else F.lit(False)
    rows = rows.filter((F.col("_i") < 0) | poor | (mine != theirs))
    opens, closes, base = F.col("_i") == -2, F.col("_i") == -1, F.col("_i") >= 0
    is_event, anchor = F.col("_kind").isin("I", "D"), F.col("_before")
    move = F.when(opens, 1).when(closes, -1).otherwise(0)
    place = F.when(base, F.col("_lo") + F.col("_i")).when(is_event | opens, F.col("_lo")).otherwise(F.col("_lo") + F.col("_len"))
    deleted = F.concat(F.lit("-"), F.when(F.col("_n") < overlap, F.col("_ref")).otherwise(F.col("_n").cast("string")))
    text = F.when(base & ~poor, mine).when(is_event & opens, F.when(F.col("_kind") == "I", F.concat(F.lit("+"), F.col("_bases"))).otherwise(deleted)).when(is_event, anchor)
    symbol = F.when(base & ~poor, F.when(mine.isin("A", "C", "G", "T"), mine).otherwise("O")).when(is_event & opens, F.col("_kind")).when(is_event, anchor)
    return rows.select(
        *by, "chunk_id", place.cast("long").alias("pos"),
        *[F.when(F.col("_kind") == k, move).otherwise(0).alias(name) for k, name in (("M", "base"), ("gone", "gone"), ("skip", "skip"))],
        F.when(base, 1).otherwise(0).alias("less"), symbol.alias("s"), text.alias("t"),
        F.when((base & ~poor) | (is_event & opens), 1).otherwise(0).alias("c"), F.when((base & ~poor) | (is_event & opens), 1).when(is_event, -1).otherwise(0).alias("n"),
    )


def pileup_counts(
    reads: DataFrame, chunks: DataFrame, keys: list[str] | None = None, min_mapq: int = 5, min_bq: int = 0,
    flag_mask: int = 2316, chunk: int = CHUNK, overlap: int = OVERLAP, proper_pairs: bool = True,
) -> DataFrame:
    """Counts per position: ``a c g t ins del other``, ``depth``, ``ref_base`` and ``alt_bases`` (text -> count).

    A read with an indel after a base counts that base and the indel, so it
    enters the depth twice; in ``alt_bases`` it stands only as ``+`` or ``-``
    followed by its base and sequence. Deleted and skipped positions and
    unclear bases are "other". ``chunks`` come from ``chunk_genome`` with the
    same ``chunk`` and ``overlap``; a deletion longer than ``overlap`` is spelled
    over several of them. ``proper_pairs`` leaves out paired reads that are not properly paired.

    Reads are cut to chunks in Arrow batches and shuffled once, two bits a plain letter and without qualities; a task walks
    its chunks in order and holds the counts of one chunk (and key), its indels and their texts. No base becomes a row.
    """
    by = [*(keys or []), "contig"]
    kept = reads.filter(R.passes_flag_mask("flag", flag_mask) & (F.col("mapq") >= min_mapq))
    if proper_pairs:
        kept = kept.filter(F.col("flag").bitwiseAND(K.FLAG_PAIRED | K.FLAG_PROPER_PAIR) != K.FLAG_PAIRED)
    kept = kept.filter(F.col("cigar").isNotNull() & F.col("seq").isNotNull() & F.col("pos").isNotNull())
    plain = kept.select(*by, F.col("pos").cast("long").alias("pos"), "cigar", "seq", *(["qual"] if min_bq else []))
    types = dict(plain.dtypes)
    keyed = ", ".join(f"`{c}` {types[c]}" for c in by)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cigars = _Cigars()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            step = max(1, table.num_rows * CELLS // max(CELLS, batch.nbytes))
            for at in range(0, table.num_rows, step):
                yield from _chunk_rows(table.slice(at, step), by, chunk, overlap, min_bq, cigars).to_batches()

    pieces = plain.mapInArrow(cut, f"{keyed}, chunk_id long, _order int, _kind int, _at long, _size long, _before int, _text binary")
    framed = chunks.select("contig", F.col("chunk_id").cast("long").alias("chunk_id"), F.lit(True).alias("_chunk"), F.col("chunk_start").cast("long").alias("_at"), F.col("chunk_seq").alias("_seq"))
    rows = framed.unionByName(pieces.withColumn("_chunk", F.lit(False)), allowMissingColumns=True)
    area = ["contig", "chunk_id"]
    in_order = rows.repartition(*area).sortWithinPartitions(*area, F.desc("_chunk"), *(keys or []), "_order")
    numbers = ", ".join(f"`{n}` long" for n in [*NAMES, "depth"])
    schema = f"{keyed}, pos long, ref_base string, {numbers}, alt_bases map<string,bigint>, _sizes array<int>"

    def walk(batches: Iterator[pa.RecordBatch], long: bool) -> Iterator[pa.RecordBatch]:
        seqs: list[str] = []
        place, key, here = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if here is not None and seqs:
                for text in seqs:
                    for table in here.positions(text, len(seqs), dict(zip(by, key)), types, long):
                        yield from table.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            new = np.zeros(batch.num_rows, dtype=bool)
            for name in [*area, "_chunk", *(keys or [])]:
                codes = column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            edges = np.flatnonzero(np.r_[True, new[1:], True])
            is_chunk = column("_chunk").to_numpy(zero_copy_only=False)
            kinds, sizes = (column(n).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("_kind", "_size"))
            data, at = _flat(column("_text"))
            text, text_at = _unpacked(data, at, np.where(kinds == 0, sizes, 0))
            whole = (kinds, column("_at").to_numpy(zero_copy_only=False), sizes, column("_before").fill_null(0).to_numpy(zero_copy_only=False), text_at)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                spot = tuple(column(n)[a].as_py() for n in area)
                if is_chunk[a]:
                    if spot != place:
                        yield from done()
                        place, key, here, seqs = spot, None, None, []
                    seqs += column("_seq").slice(a, b - a).to_pylist()
                    continue
                mine = tuple(column(n)[a].as_py() for n in by)
                if spot != place or mine != key or here is None:
                    yield from done()
                    seqs = seqs if spot == place else []
                    place, key, here = spot, mine, _Chunk(spot[1] * chunk, chunk, overlap)
                if seqs:
                    here.add(*(x[a : b + (x is text_at)] for x in whole), text, long)
        yield from done()

    plainly = in_order.mapInArrow(lambda batches: walk(batches, False), schema).drop("_sizes")
    # a deletion longer than the overlap is spelled from all chunks it touches; only its position goes there
    far = in_order.mapInArrow(lambda batches: walk(batches, True), schema).withColumn("_id", F.monotonically_increasing_id())
    return plainly.unionByName(_spell_long(far, chunks, chunk).select(*plainly.columns))


NAMES = ["a", "c", "g", "t", "ins", "del", "other"]
#: Stands for a base that is too poor to count.
POOR = 1


def _chunk_rows(reads: pa.Table, by: list[str], chunk: int, overlap: int, min_bq: int, cigars: _Cigars) -> pa.Table:
    """One row per read, chunk and stretch between skips, per chunk and skip, and per indel; long deletions come first."""
    reads = reads.combine_chunks()
    column = lambda name: reads[name].combine_chunks() if isinstance(reads[name], pa.ChunkedArray) else reads[name]
    row, ops, erow, events, krow, skips = cigars.of(column("cigar"))
    pos = column("pos").to_numpy(zero_copy_only=False)
    letters, starts = _flat(column("seq"))
    long = starts[1:] - starts[:-1]
    gone, n, r, q, segment = ops.T
    owner, of = np.repeat(row, n), np.repeat(q, n) + _ramp(n)
    dead = np.repeat(gone == 1, n)
    have = ~dead & (of < long[owner])
    text = np.full(len(of), NO_BASE, np.uint8)
    text[have] = UPPER[letters[starts[owner[have]] + of[have]]]
    text[dead] = GAP
    if min_bq:
        quals = column("qual")
        values, listed = quals.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(quals.value_lengths().fill_null(0))
        known = have & (of < listed[owner])
        text[np.flatnonzero(known)[values[(np.cumsum(listed) - listed)[owner[known]] + of[known]] < min_bq]] = POOR
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])]) if len(row) else np.zeros(0, np.int64)
    at = (np.cumsum(n) - n)[head]
    lo = pos[row[head]] + r[head]
    hi = lo + (np.add.reduceat(n, head) if len(head) else 0)
    klo = pos[krow] + skips[:, 2]
    lo, hi, at, of_read = np.r_[lo, klo], np.r_[hi, klo + skips[:, 1]], np.r_[at, np.zeros(len(krow), np.int64)], np.r_[row[head], krow]
    many = (hi - 1) // chunk - lo // chunk + 1
    piece = np.repeat(np.arange(len(lo)), many)
    ids = (lo // chunk)[piece] + _ramp(many)
    left = np.maximum(lo[piece], ids * chunk)
    sizes = np.minimum(hi[piece], (ids + 1) * chunk) - left
    skip = piece >= len(head)
    shown = np.where(skip, 0, sizes)
    source = np.repeat(at[piece] + left - lo[piece], shown) + _ramp(shown)
    edel, esize, er, eq, _ = events.T
    place = pos[erow] + er
    seq = column("seq").to_pylist() if len(erow) else []
    told = [seq[i][max(s - 1, 0) : s if d else s + k].upper().encode("latin-1", "replace") for d, i, s, k in zip(edel.tolist(), erow.tolist(), eq.tolist(), esize.tolist())]
    far = (edel == 1) & (esize >= overlap)
    number = lambda *parts: pa.array(np.concatenate(parts))
    rows = number(of_read[piece], erow)
    return pa.table({
        **{name: column(name).take(rows) for name in by},
        "chunk_id": number(ids, (place - 1) // chunk), "_order": number(np.full(len(piece), 2, np.int32), np.where(far, 1, 2).astype(np.int32)),
        "_kind": number(np.where(skip, 3, 0).astype(np.int32), (1 + edel).astype(np.int32)), "_at": number(left, place),
        "_size": number(sizes, esize), "_before": number(np.zeros(len(piece), np.int32), (eq > 0).astype(np.int32)),
        "_text": pa.concat_arrays([_packed(text[source], shown), pa.array(told, pa.binary())]),
    })


class _Chunk:
    """Counts of one chunk by place and letter, and its indels."""

    def __init__(self, start: int, reach: int, overlap: int):
        self.start, self.reach, self.overlap, self.some_long, self.told = start, reach, overlap, False, False
        self.letters, self.lut = bytearray(b"ACGT"), np.full(256, -1, dtype=np.int64)
        self.lut[list(self.letters)] = range(4)
        self.n = np.zeros((4, reach), dtype=np.int64)
        self.skip = np.zeros(reach + 1, dtype=np.int64)
        self.anchors = np.zeros((4, reach), dtype=np.int64)
        self.events: dict[tuple, int] = {}

    def add(self, kind: np.ndarray, at: np.ndarray, size: np.ndarray, before: np.ndarray, text_at: np.ndarray, text: np.ndarray, long: bool) -> None:
        if long and not self.told:  # long deletions come first
            self.some_long = bool(((kind == 2) & (size >= self.overlap)).any())
        self.told = True
        if long and not self.some_long:
            return
        base = np.flatnonzero(kind == 0)
        if len(base):
            spot = np.repeat(at[base] - self.start, size[base]) + _ramp(size[base])
            letter = text[np.repeat(text_at[base], size[base]) + _ramp(size[base])]
            spot, letter = spot[letter != POOR], letter[letter != POOR]
            code = self.lut[letter]
            if len(code) and code.min() < 0:
                for new in np.unique(letter[code < 0]).tolist():
                    self.lut[new] = len(self.letters)
                    self.letters.append(new)
                self.n = np.pad(self.n, ((0, len(self.letters) - len(self.n)), (0, 0)))
                code = self.lut[letter]
            self.n += np.bincount(code * self.reach + spot, minlength=self.n.size).reshape(self.n.shape)
        gap = np.flatnonzero(kind == 3)
        np.add.at(self.skip, at[gap] - self.start, 1)
        np.add.at(self.skip, at[gap] - self.start + size[gap], -1)
        for i in np.flatnonzero((kind == 1) | (kind == 2)).tolist():
            told = text[text_at[i] : text_at[i + 1]].tobytes()
            place = int(at[i]) - 1 - self.start
            event = (place, int(kind[i]), told if kind[i] == 1 else b"", int(size[i]) if kind[i] == 2 else 0)
            self.events[event] = self.events.get(event, 0) + 1
            code = self.lut[told[0]] if before[i] and told else -1
            if 0 <= code < 4:  # what an indel takes from the text of its base
                self.anchors[code, place] += 1

    def positions(self, seq: str, times: int, key: dict, types: dict, long: bool) -> Iterator[pa.Table]:
        """Counts and texts of the covered positions: those with a long deletion if ``long``, else the others."""
        if long and not self.some_long:
            return
        ref = UPPER[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
        here = min(self.reach, len(ref))
        n, skip = self.n[:, :here] * times, np.cumsum(self.skip)[:here] * times
        events = [(*e, m * times) for e, m in self.events.items() if 0 <= e[0] < here]
        ins, gone = np.zeros(here, dtype=np.int64), np.zeros(here, dtype=np.int64)
        far: dict[int, list[int]] = {}
        texts, where, counted = [], [], []
        for place, kind, told, size, m in events:
            (ins if kind == 1 else gone)[place] += m
            if kind == 1:
                texts.append("+" + told.decode("latin-1"))
            elif size < self.overlap:
                texts.append("-" + ref[place : place + size + 1].tobytes().decode("latin-1"))
            else:
                far.setdefault(place, []).append(size)
                texts.append(f"-{size}")
            where.append(place)
            counted.append(m)
        other = n[4:].sum(axis=0) + skip
        columns = [*n[:4], ins, gone, other]
        depth = sum(columns)
        wanted = depth > 0
        is_far = np.zeros(here, dtype=bool)
        is_far[list(far)] = True
        wanted &= is_far if long else ~is_far
        spots = np.flatnonzero(wanted)
        if not len(spots):
            return
        net = n.copy()
        net[:4] -= self.anchors[:, :here] * times
        code, spot = np.nonzero(net * wanted > 0)
        names = ["*" if c == GAP else "" if c == NO_BASE else chr(c) for c in self.letters]
        gap = np.flatnonzero(wanted & (skip > 0))
        place, counts = np.array(where, dtype=np.int64), np.array(counted, dtype=np.int64)
        mine = np.flatnonzero(wanted[place]) if len(place) else place
        at, text = np.r_[spot, gap, place[mine]], np.r_[code, np.full(len(gap), len(names)), len(names) + 1 + mine]
        value = np.r_[net[code, spot], skip[gap], counts[mine]]
        order = np.argsort(at, kind="stable")
        line = np.searchsorted(spots, at[order])
        edges = np.r_[0, np.cumsum(np.bincount(line, minlength=len(spots)))].astype(np.int32)
        alts = pa.MapArray.from_arrays(pa.array(edges), pa.array([*names, ">", *texts], pa.string()).take(pa.array(text[order])), pa.array(value[order]))
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
        yield pa.table({
            **{k: pa.array([v], kinds.get(types[k])).take(pa.array(np.zeros(len(spots), np.int64))) for k, v in key.items()},
            "pos": pa.array(spots + self.start), "ref_base": pa.array([chr(c) for c in range(256)]).take(pa.array(ref[spots].astype(np.int64))),
            **{name: pa.array(c[spots]) for name, c in zip(NAMES, columns)}, "depth": pa.array(depth[spots]), "alt_bases": alts,
            "_sizes": pa.array([far.get(int(p)) for p in spots] if long else [None] * len(spots), pa.list_(pa.int32())),
        })


def _spell_long(far: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """Positions with their deletions in ``_sizes`` spelled by the reference instead of named by their length."""
    row = F.struct(*[c for c in far.columns if c != "_id"]).alias("_row")
    one = far.select("_id", row, "contig", "pos", F.explode("_sizes").alias("_n"))
    parts = one.select("*", F.explode(F.sequence(floor_div("pos", chunk), floor_div(F.col("pos") + F.col("_n"), chunk))).alias("chunk_id"))
    met = parts.join(chunks.select("contig", "chunk_id", "chunk_start", "chunk_seq"), ["contig", "chunk_id"])
    first = F.greatest(F.col("pos"), F.col("chunk_start"))
    last = F.least(F.col("pos") + F.col("_n") + 1, F.col("chunk_start") + chunk)
    text = ascii_cut("chunk_seq", (first - F.col("chunk_start") + 1).cast("int"), (last - first).cast("int"))
    spelled = met.groupBy("_id", "_n").agg(F.first("_row").alias("_row"), F.array_sort(F.collect_set(F.struct("chunk_id", text.alias("t")))).alias("_p"))
    named = spelled.select("_id", "_row", F.concat(F.lit("-"), F.col("_n").cast("string")).alias("_k"), F.concat(F.lit("-"), F.upper(F.array_join(F.transform("_p", lambda p: p["t"]), ""))).alias("_t"))
    whole = named.groupBy("_id").agg(F.first("_row").alias("_row"), F.map_from_entries(F.collect_list(F.struct("_k", "_t"))).alias("_texts"))
    alts = F.map_from_entries(F.transform(F.map_entries("_row.alt_bases"), lambda e: F.struct(F.coalesce(F.try_element_at("_texts", e["key"]), e["key"]).alias("key"), e["value"].alias("value"))))
    return whole.select(*[F.col(f"_row.{c}").alias(c) for c in far.columns if c not in ("_id", "_sizes", "alt_bases")], alts.alias("alt_bases"))


def candidate_sites(
    pileup: DataFrame, min_depth: int = 4, snp_af: float = 0.08, indel_af: float = 0.08
) -> DataFrame:
    """Positions whose most frequent symbol is not the reference, or with a frequent enough other symbol.

    "Other" counts in the depth but is no candidate. Equal top counts favour the reference.
    """
    ref = F.col("ref_base")
    ref_count = F.lit(0).cast("long")
    rivals, shares = [], F.lit(False)
    for symbol, name in zip(SYMBOLS, ["a", "c", "g", "t", "ins", "del"]):
        n = F.col(name)
        ref_count = F.when(ref == symbol, n).otherwise(ref_count)
        rival = F.when(ref == symbol, F.lit(0).cast("long")).otherwise(n)
        rivals.append(rival)
        shares = shares | ((rival > 0) & (rival / F.col("depth") >= (indel_af if symbol in "ID" else snp_af)))
    top = F.greatest(*rivals)
    return pileup.filter(
        ref.isin("A", "C", "G", "T") & (F.col("depth") >= min_depth) & ((top > ref_count) | shares)
    )


def base_coverage(
    sites: DataFrame, reads: DataFrame, key: str, site: str = "locus", keys: list[str] | None = None,
    min_bq: int = 15, flag_mask: int = 1796, hot_rows: int | None = DEFAULT_HOT_ROWS, width: int = READ_WIDTH,
) -> DataFrame:
    """A, C, G, T counts at listed sites for bases of quality ``min_bq`` or better.

    Sites become one sorted array per bucket of ``width`` positions. A read's
    CIGAR is walked once: each aligned stretch, cut at buckets, carries only its
    own bases and qualities to the bucket's array and looks up what lies inside,
    so reads are neither expanded to all bases nor copied once per site. Sites
    without reads count 0.
    """
    by = list(keys or [])
    kept = reads.filter(R.passes_flag_mask("flag", flag_mask) & F.col("cigar").isNotNull() & F.col("seq").isNotNull())
    carried = list(dict.fromkeys([*by, "contig", "pos", "seq", "qual"]))
    one = with_steps(kept, carried).select(*carried, F.explode(F.filter("_ops", lambda o: o["op"].isin("M", "=", "X") & (o["len"] > 0))).alias("_o"))
    start = (F.col("pos") + F.col("_o.r")).cast("long")
    end = start + F.col("_o.len")
    one = one.select(*carried, start.alias("_s"), end.alias("_t"), F.col("_o.q").alias("_q"), F.explode(F.sequence(floor_div(start, width), floor_div(end - 1, width))).alias("_bucket"))
    lo, hi = F.greatest(F.col("_s"), F.col("_bucket") * width), F.least(F.col("_t"), (F.col("_bucket") + 1) * width)
    at, size = (F.col("_q") + lo - F.col("_s") + 1).cast("int"), (hi - lo).cast("int")
    cut = one.select(
        *[F.col(k).alias(f"_k_{k}") for k in by], F.col("contig"), "_bucket", lo.alias("_lo"), hi.alias("_hi"),
        F.upper(F.substring(F.col("seq"), at, size)).alias("_bases"), F.slice(F.col("qual"), at, size).alias("_quals"),
    )
    places = sites.select(F.col("contig"), F.col(site).cast("long").alias("_site")).groupBy("contig", floor_div("_site", width).alias("_bucket"))
    arrays = places.agg(F.array_sort(F.collect_set("_site")).alias("_sites"))
    met = salted_join(cut, arrays, ["contig", "_bucket"], None, "inner", hot_rows)
    inside = F.filter("_sites", lambda x: (x >= F.col("_lo")) & (x < F.col("_hi")))
    hits = met.select(*[f"_k_{k}" for k in by], "contig", "_lo", "_bases", "_quals", F.explode(inside).alias("_site"))
    nth = (F.col("_site") - F.col("_lo")).cast("int")
    letter = F.substring(F.col("_bases"), nth + 1, F.lit(1))
    picked = hits.filter(F.get(F.col("_quals"), nth) >= min_bq).select(*[f"_k_{k}" for k in by], "contig", "_site", letter.alias("_b"))
    counts = picked.groupBy(*[f"_k_{k}" for k in by], "contig", "_site").agg(
        *[F.sum(F.when(F.col("_b") == b, 1).otherwise(0)).cast("long").alias(f"_n{b.lower()}") for b in "ACGT"]
    )
    counts = counts.withColumnRenamed("contig", "_contig")
    same = (F.col("contig") == F.col("_contig")) & (F.col(site) == F.col("_site"))
    found = sites.join(counts, same, "inner" if by else "left")
    numbers = [F.coalesce(f"_n{c}", F.lit(0)).cast("long").alias(c) for c in "acgt"]
    if by:
        return found.select(*[F.col(f"_k_{k}").alias(k) for k in by], key, *numbers)
    return found.select(*sites.columns, *numbers)
