"""Read stacks around sites: consensus per fragment, column profiles, model-ready rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fragx import constants as K
from fragx.functions import reads as R, sequence as S
from fragx.operators.genome import CHUNK, OVERLAP, ref_window
from fragx.operators.intervals import READ_WIDTH, interval_overlap_join, point_in_interval_join
from fragx.operators.reads import expand_alignment, ref_span, with_steps
from fragx.operators.skew import DEFAULT_HOT_ROWS


def site_windows(
    sites: DataFrame, chunks: DataFrame, before: int, after: int, pos: str = "locus", chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Sites with window ``[ws, we)`` and its sanitised reference; sites without a whole window drop out."""
    framed = ref_window(sites, chunks, before, after, pos=pos, name="ref_seq", chunk=chunk, overlap=overlap)
    return (
        framed.withColumn("ref_seq", S.sanitize_bases("ref_seq"))
        .withColumn("ws", F.col(pos) - before)
        .withColumn("we", F.col(pos) + after)
    )


def reads_around_sites(
    windows: DataFrame, reads: DataFrame, columns: list[str], width: int = READ_WIDTH,
    hot_rows: int | None = DEFAULT_HOT_ROWS, keys: list[str] | None = None,
) -> DataFrame:
    """Every site window with the reads that overlap it; ``columns`` of the read are carried along.

    ``keys`` (the sample) stand on both sides, and a window meets only reads of its own.
    """
    by = [*(keys or []), "contig"]
    carried = list(dict.fromkeys([*columns, "pos", "cigar"]))
    spans = reads.filter(~R.has_flag("flag", K.FLAG_UNMAPPED)).select(
        *by, *carried, (F.col("pos") + ref_span("cigar")).alias("_re")
    )
    return interval_overlap_join(windows, spans, by, ("ws", "we"), ("pos", "_re"), width, hot_rows).drop("_re")


def stack_rows(pairs: DataFrame, site: list[str], joint: bool = True, fragment: str = "qname", ord: str = "rid") -> DataFrame:
    """Aligned bases and indels of every (site, read) pair, clipped to the window.

    ``offset`` counts from the window start. ``fragment`` is the read name when
    mates are joined, else the read itself.
    """
    name = F.col(fragment) if joint else F.concat(F.lit("read"), F.col(ord).cast("string"))
    keep = [*site, "ws", "we", "_fragment", "_ord", "_forward", "_mapq"]
    tagged = (
        pairs.withColumn("_fragment", name).withColumn("_ord", F.col(ord))
        .withColumn("_forward", R.is_forward("flag")).withColumn("_mapq", F.col("mapq"))
    )
    rows = expand_alignment(tagged, keep, window=("ws", "we"), ref="ref_seq")
    return rows.select(
        *site, F.col("_fragment").alias("fragment"), F.col("_ord").alias("ord"), F.col("_forward").alias("forward"),
        F.col("_mapq").alias("mapq"), (F.col("we") - F.col("ws")).cast("int").alias("size"), "kind",
        (F.col("ref_pos") - F.col("ws")).cast("int").alias("offset"), "base", "bq", "event",
    )


def fragment_consensus(rows: DataFrame, site: list[str], min_bq: int = 0) -> DataFrame:
    """One base per (site, fragment, offset): the higher quality wins, the later read on ties.

    An unclear first base gives way to any later one. ``strand`` is 0 forward,
    1 reverse, 2 both mates; ``mapq`` the larger one. Offsets no read covers have no row.
    """
    bases = rows.filter(F.col("kind").isin("base", "del_base") & (F.col("bq") >= min_bq))
    value = F.struct("base", "bq")
    clear_first = F.struct(F.col("base") != "N", F.col("bq"), F.col("ord"))
    merged = bases.groupBy(*site, "fragment", "offset", "size").agg(
        F.count(F.lit(1)).alias("_n"), F.max_by(value, clear_first).alias("_clear"),
        F.max_by(value, F.col("ord")).alias("_last"), F.max("mapq").alias("mapq"),
        F.min_by("forward", "ord").alias("_fw"), F.min("ord").alias("ord"),
    )
    # The last read may bring an unclear base that wins on quality; an earlier unclear base never stays.
    unclear = (F.col("_last.base") == "N") & (F.col("_last.bq") >= F.col("_clear.bq"))
    chosen = F.when(unclear | (F.col("_clear.base") == "N"), F.col("_last")).otherwise(F.col("_clear"))
    strand = F.when(F.col("_n") > 1, 2).when(F.col("_fw"), 0).otherwise(1)
    return merged.withColumn("_c", chosen).select(
        *site, "fragment", "offset", "size", F.col("_c.base").alias("base"), F.col("_c.bq").alias("bq"), "mapq",
        strand.alias("strand"), "ord",
    )


def fragment_events(rows: DataFrame, site: list[str]) -> DataFrame:
    """Insertions and deletions of every fragment: kind, window index, sequence, quality."""
    return rows.filter(F.col("kind").isin("ins", "del")).select(
        *site, "fragment", "ord", "size", "kind", F.col("offset").alias("idx"), F.col("event").alias("seq"), "bq"
    )


def _named(reads: DataFrame, joint: bool, fragment: str, ord: str) -> DataFrame:
    name = F.col(fragment) if joint else F.concat(F.lit("read"), F.col(ord).cast("string"))
    kept = reads.filter(~R.has_flag("flag", K.FLAG_UNMAPPED) & F.col("cigar").isNotNull() & F.col("seq").isNotNull())
    return kept.withColumn("_fragment", name).withColumn("_ord", F.col(ord))


def site_events(
    windows: DataFrame, reads: DataFrame, site: list[str], kinds: tuple[str, ...] = ("ins", "del"), joint: bool = True,
    fragment: str = "qname", ord: str = "rid", keys: list[str] | None = None, width: int = READ_WIDTH,
) -> DataFrame:
    """``fragment_events`` of windows and reads, without a row per base: an indel is a point that meets its windows.

    A window shows an indel whose read has a base in it before the indel, an insertion as far as it fits.
    """
    by = [*(keys or []), "contig"]
    carried = list(dict.fromkeys([*by, "_fragment", "_ord", "pos", "seq", "qual"]))

    def reached(o):
        before = F.filter("_ops", lambda x: x["op"].isin("M", "=", "X", "D") & (x["r"] < o["r"]))
        return F.array_max(F.transform(before, lambda x: x["r"] + x["len"]))

    ops = [op for op, kind in (("I", "ins"), ("D", "del")) if kind in kinds]
    steps = F.filter("_ops", lambda o: o["op"].isin(*ops) & (o["len"] > 0))
    with_end = F.transform(steps, lambda o: F.struct(o["op"].alias("op"), o["len"].alias("len"), o["r"].alias("r"), o["q"].alias("q"), reached(o).alias("end")))
    one = with_steps(_named(reads, joint, fragment, ord), carried).select(*carried, F.explode(with_end).alias("_o")).filter("_o.end is not null")
    inserted, q, n = F.col("_o.op") == "I", F.col("_o.q"), F.col("_o.len")
    points = one.select(
        *[F.col(k).alias(f"_p_{k}") for k in by], "_fragment", "_ord", F.when(inserted, "ins").otherwise("del").alias("kind"), n.alias("_n"),
        (F.col("pos") + F.col("_o.r")).cast("long").alias("_rp"), (F.col("pos") + F.col("_o.end")).cast("long").alias("_prev"),
        F.when(inserted, F.substring(F.col("seq"), q + 1, n)).alias("_text"),
        F.when(inserted, F.slice(F.col("qual"), q + 1, n)).otherwise(F.array(F.coalesce(F.get(F.col("qual"), q), F.lit(0)))).alias("_quals"),
    )
    points = points.select(*[F.col(f"_p_{k}").alias(k) for k in by], *[c for c in points.columns if not c.startswith("_p_")])
    framed = windows.select(*by, *[F.col(c).alias(f"_w_{c}") for c in site], "ws", "we", "ref_seq")
    met = point_in_interval_join(points, framed, by, "_rp", "ws", "we", width, hot_rows=None).filter(F.col("_prev") > F.col("ws"))
    idx, shown = (F.col("_rp") - F.col("ws")).cast("int"), F.least(F.col("_n"), (F.col("we") - F.col("_rp")).cast("int"))
    is_ins = F.col("kind") == "ins"
    quals = F.slice(F.col("_quals"), F.lit(1), shown)
    mean = F.try_divide(F.aggregate(quals, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.size(quals))
    text = F.when(is_ins, F.substring(F.col("_text"), F.lit(1), shown)).otherwise(F.substring(F.col("ref_seq"), idx + 1, shown))
    return met.select(
        *[F.col(f"_w_{c}").alias(c) for c in site], F.col("_fragment").alias("fragment"), F.col("_ord").alias("ord"),
        (F.col("we") - F.col("ws")).cast("int").alias("size"), "kind", idx.alias("idx"), text.alias("seq"),
        F.when(is_ins, mean).otherwise(F.get(F.col("_quals"), F.lit(0)).cast("double")).alias("bq"),
    )


def touched_cores(
    windows: DataFrame, reads: DataFrame, site: list[str], center: Column, half_core: int = 32, joint: bool = True,
    fragment: str = "qname", ord: str = "rid", keys: list[str] | None = None, width: int = READ_WIDTH,
) -> DataFrame:
    """``touches_core`` of windows and reads, without a row per base and without a distinct over pairs.

    An aligned stretch knows how far the earlier ones of its fragment reach, so only the first one in a core stands for it.
    """
    by = [*(keys or []), "contig"]
    carried = list(dict.fromkeys([*by, "_fragment", "pos"]))
    steps = F.filter("_ops", lambda o: o["op"].isin("M", "=", "X") & (o["len"] > 0))
    one = with_steps(_named(reads, joint, fragment, ord), carried).select(*carried, F.explode(steps).alias("_o"))
    start = (F.col("pos") + F.col("_o.r")).cast("long")
    earlier = Window.partitionBy(*by, "_fragment").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    stretches = one.select(*by, "_fragment", start.alias("_s"), (start + F.col("_o.len")).cast("long").alias("_e"))
    stretches = stretches.select("*", F.max("_e").over(earlier).alias("_before"))
    core = F.col("ws") + center
    cores = windows.withColumn("_cs", F.greatest(F.col("ws"), core - half_core)).withColumn("_ce", F.least(F.col("we"), core + half_core))
    cores = cores.select(*by, *[F.col(c).alias(f"_w_{c}") for c in site], "_cs", "_ce")
    met = interval_overlap_join(cores, stretches, by, ("_cs", "_ce"), ("_s", "_e"), width, hot_rows=None)
    first = met.filter(F.col("_before").isNull() | (F.col("_before") <= F.col("_cs")))
    return first.select(*[F.col(f"_w_{c}").alias(c) for c in site], F.col("_fragment").alias("fragment"))


def fragment_consensus_simple(
    pairs: DataFrame, site: list[str], half_window: int = 256, half_core: int = 32, fragment: str = "qname",
    ord: str = "rid", max_reads: int | None = None,
) -> DataFrame:
    """Window text per fragment: only aligned bases, later reads overwrite, gaps inside a fragment of several reads are ``x``.

    Fragments of 20 to 600 bases count, with all their reads or the first
    ``max_reads`` of each where the caller says so; a fragment stays when it shows anything within the core around the centre.
    """
    ok = pairs.filter(R.fragment_length_ok("tlen"))
    nth = F.row_number().over(Window.partitionBy(*site, fragment).orderBy(ord))
    two = ok.withColumn("_nth", nth)
    if max_reads is not None:
        two = two.filter(F.col("_nth") <= max_reads)
    rows = expand_alignment(two, [*site, "ws", fragment, "_nth"], window=("ws", "we")).filter("kind = 'base'")
    per_base = rows.groupBy(*site, fragment, (F.col("ref_pos") - F.col("ws")).cast("int").alias("offset")).agg(
        F.max_by("base", "_nth").alias("base")
    )
    mates = two.groupBy(*site, fragment).agg(F.max("_nth").alias("_n"))
    packed = per_base.groupBy(*site, fragment).agg(
        F.map_from_entries(F.collect_list(F.struct("offset", "base"))).alias("_m"), F.min("offset").alias("_lo"),
        F.max("offset").alias("_hi"),
    ).join(mates, [*site, fragment])
    gap = lambda i: F.when((F.col("_n") >= 2) & (i > F.col("_lo")) & (i < F.col("_hi")), "x").otherwise(".")
    text = F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(2 * half_window - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), gap(i))
        ),
        "",
    )
    core = F.substring("text", half_window - half_core + 1, 2 * half_core)
    return packed.select(*site, F.col(fragment).alias("fragment"), text.alias("text")).filter(core.rlike(r"[^.]"))


def touches_core(rows: DataFrame, site: list[str], center: Column, half_core: int = 32) -> DataFrame:
    """Fragments with at least one base within ``half_core`` of the centre offset."""
    near = (F.col("offset") >= center - half_core) & (F.col("offset") < center + half_core)
    return rows.filter((F.col("kind") == "base") & near).select(*site, "fragment").distinct()


def cap_depth(
    rows: DataFrame, site: list[str], limit: int | None, order: str = "ord", seed: int | None = None, fragment: str = "fragment"
) -> DataFrame:
    """Rows with the rank of their fragment in its site; with ``limit`` only those of so many fragments.

    Fragments come in order of appearance, or with ``seed`` in a repeatable random order.

    The rank window is cut to ``limit`` rows per site and task before the
    shuffle (Spark's window group limit), so a very deep site stays small.
    """
    heads = rows.groupBy(*site, fragment).agg(F.min(order).alias("_o"))
    key = F.col("_o") if seed is None else F.xxhash64(F.col(fragment), F.lit(seed))
    ranked = heads.withColumn(
        "row", F.row_number().over(Window.partitionBy(*site).orderBy(key, F.col("_o"), F.col(fragment)))
    )
    if limit is not None:
        ranked = ranked.filter(F.col("row") <= limit)
    return rows.join(ranked.drop("_o"), [*site, fragment])


def base_profile5(consensus: DataFrame, windows: DataFrame, site: list[str]) -> DataFrame:
    """Counts of N, A, C, G, T per column, the reference row included."""
    reference = windows.select(
        *site, F.posexplode(F.split("ref_seq", "")).alias("offset", "base")
    ).filter(F.col("base") != "")
    rows = consensus.select(*site, "offset", "base").unionByName(reference)
    return rows.groupBy(*site, "offset").agg(
        *[F.sum(F.when(F.col("base") == b, 1).otherwise(0)).cast("long").alias(f"n_{b.lower()}") for b in K.PROFILE5]
    )


def _stranded(symbol: Column, lower: Column) -> Column:
    """Upper-case symbol for forward, lower-case for reverse, both for strand 2."""
    return (
        F.when(F.col("strand") == 0, F.array(symbol)).when(F.col("strand") == 1, F.array(lower))
        .when(F.col("strand") == 2, F.array(symbol, lower))
    )


def indel_symbols(anchored: DataFrame, site: list[str], carry: list[str] | None = None) -> DataFrame:
    """Symbols (``site``, offset, symbol) of indels that know their strand: a start flag, their bases, an end flag."""
    flag = F.when(F.col("kind") == "ins", "I").otherwise("D")
    mark = F.when(F.col("kind") == "ins", "+").otherwise("-")
    start, end = F.concat(flag, F.lit("S")), F.concat(flag, F.lit("E"))
    letters = F.transform(
        F.sequence(F.lit(1), F.length("seq")),
        lambda i: F.struct(
            (F.col("idx") + i - 1).alias("offset"),
            F.concat(F.substring(F.col("seq"), i, F.lit(1)), mark).alias("up"),
            F.concat(F.lower(F.substring(F.col("seq"), i, F.lit(1))), mark).alias("low"),
        ),
    )

    def one(offset, symbol):
        return F.struct(offset.alias("offset"), symbol.alias("up"), F.lower(symbol).alias("low"))

    marks = F.concat(
        F.array(one(F.col("idx") - 1, start), one(F.col("idx") - 1 + F.length("seq"), end)), letters
    )
    kept = [*site, *(carry or [])]
    rows = anchored.filter(F.length("seq") > 0).select(*kept, "size", "strand", F.explode(marks).alias("_x")).filter(
        F.col("_x.offset") < F.col("size")
    )
    return rows.select(
        *kept, F.col("_x.offset").alias("offset"),
        F.explode(_stranded(F.col("_x.up"), F.col("_x.low"))).alias("symbol"),
    )


def base_profile(
    consensus: DataFrame, events: DataFrame, site: list[str], types: list[str] | None = None
) -> DataFrame:
    """Strand-aware symbol counts (site, offset, symbol, n) for the chosen types.

    An indel takes the strand of its fragment at the base before it: a start
    flag there, an end flag after its last base, and its bases column by column.
    Events on an uncovered column have no strand and are dropped.
    """
    types = types or K.PROFILE38
    bases = consensus.filter(~F.col("base").isin(".", "-")).select(
        *site, "offset", F.explode(_stranded(F.col("base"), F.lower("base"))).alias("symbol")
    )
    at = consensus.select(*site, "fragment", F.col("offset").alias("_anchor"), "strand")
    anchored = events.withColumn("_anchor", F.col("idx") - 1).filter(
        (F.col("_anchor") >= 0) & (F.col("idx") <= F.col("size"))
    ).join(at, [*site, "fragment", "_anchor"])
    indels = indel_symbols(anchored, site)
    return (
        bases.unionByName(indels).filter(F.col("symbol").isin(*types))
        .groupBy(*site, "offset", "symbol").agg(F.count(F.lit(1)).alias("n"))
    )


def profile_arrays(profile: DataFrame, site: list[str], size: int, types: list[str]) -> DataFrame:
    """Dense ``profile``: one array of type counts / 100 per column; bounded by size x types per site."""
    columns = [F.sum(F.when(F.col("symbol") == t, F.col("n"))) for t in types]
    per_offset = profile.groupBy(*site, "offset").agg(
        F.array(*[F.coalesce(c, F.lit(0)).cast("double") / 100 for c in columns]).alias("_row")
    )
    packed = per_offset.groupBy(*site).agg(
        F.map_from_entries(F.collect_list(F.struct("offset", "_row"))).alias("_m")
    )
    empty = F.array_repeat(F.lit(0.0), len(types))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), empty)
    )
    return packed.select(*site, dense.alias("profile"))


def site_examples(
    consensus: DataFrame, events: DataFrame, windows: DataFrame, site: list[str], size: int, max_seqs: int | None = None,
    max_len: int | None = None, types: list[str] | None = None, seed: int | None = None, pad: bool = True,
    vocab: dict[str, int] | None = None,
) -> DataFrame:
    """Model-ready row per site: token, insertion-token, strand and quality rows, and the profile.

    Row 0 is the reference with zero strand and quality. All fragments follow in
    order of appearance. Only where the caller gives ``max_seqs`` are there so
    many at most (the first, or a seeded choice), and then ``pad`` fills up to
    that number with pad tokens and strand 3. Columns longer than ``max_len``
    are cut to the middle.
    """
    vocab = vocab or S.vocabulary()
    capped = cap_depth(consensus, site, max_seqs, seed=seed)
    cells = capped.groupBy(*site, "fragment", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("offset", F.struct("base", "bq", "mapq", "strand")))).alias("_m")
    )
    inserted = events.filter("kind = 'ins'").groupBy(*site, "fragment").agg(
        F.array_sort(F.collect_list(F.struct("idx", "seq"))).alias("_ins")
    )
    joined = cells.join(inserted, [*site, "fragment"], "left")
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    at = lambda field, default: F.transform(
        axis, lambda i: F.coalesce(F.try_element_at("_m", i)[field], F.lit(default))
    )
    text = F.array_join(at("base", "."), "")
    track = S.insertion_track(
        F.coalesce(F.col("_ins"), F.array().cast("array<struct<idx:int,seq:string>>")), size
    )
    quality = F.zip_with(
        at("bq", 0.0), at("mapq", 0), lambda b, m: F.array(b.cast("double") / 100, m.cast("double") / 100)
    )
    fragments = joined.select(
        *site, "row", S.encode_chars(text, vocab).alias("tokens"), S.encode_chars(track, vocab).alias("ins_tokens"),
        at("strand", 3).alias("strands"), quality.alias("qualities"),
    )
    reference = windows.select(
        *site, F.lit(0).alias("row"), S.encode_chars("ref_seq", vocab).alias("tokens"),
        S.encode_chars("ref_seq", vocab).alias("ins_tokens"),
        F.array_repeat(F.lit(0), size).alias("strands"),
        F.array_repeat(F.array(F.lit(0.0), F.lit(0.0)), size).alias("qualities"),
    )
    fields = ["tokens", "ins_tokens", "strands", "qualities"]
    if max_len is not None:
        fragments = fragments.select(*site, "row", *[S.center_crop(c, max_len, True).alias(c) for c in fields])
        reference = reference.select(*site, "row", *[S.center_crop(c, max_len, True).alias(c) for c in fields])
    stacked = reference.join(fragments.select(*site).distinct(), site, "left_semi").unionByName(fragments)
    packed = stacked.groupBy(*site).agg(F.array_sort(F.collect_list(F.struct("row", *fields))).alias("_rows"))
    shown = min(size, max_len) if max_len is not None else size
    fill = {
        "tokens": F.array_repeat(F.lit(vocab["<pad>"]), shown), "ins_tokens": F.array_repeat(F.lit(vocab["<pad>"]), shown),
        "strands": F.array_repeat(F.lit(3), shown),
        "qualities": F.array_repeat(F.array(F.lit(0.0), F.lit(0.0)), shown),
    }

    def column(name):
        values = F.transform("_rows", lambda r: r[name])
        if pad and max_seqs is not None:
            short = F.lit(max_seqs + 1) - F.size("_rows")
            values = F.concat(values, F.array_repeat(fill[name], short))
        return values.alias(name)

    types = types or K.PROFILE38
    profile = profile_arrays(base_profile(consensus, events, site, types), site, size, types)
    if max_len is not None:
        profile = profile.select(*site, S.center_crop("profile", max_len, True).alias("profile"))
    return packed.select(*site, (F.size("_rows") - 1).alias("depth"), *[column(n) for n in fields]).join(
        profile, site, "left"
    )

