"""Operators over aligned reads: filtering, pairing, duplicates, alignment expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fragx import constants as K
from fragx.functions import reads as R
from fragx.operators.ordering import row_numbers
from fragx.operators.skew import DEFAULT_HOT_ROWS
from fragx.session import materialize


def qc_reads(reads: DataFrame, min_mapq: int = 30, flag="flag", mapq="mapq") -> DataFrame:
    return reads.filter(R.passes_qc(flag, mapq, min_mapq))


def usable_reads(reads: DataFrame, **options) -> DataFrame:
    """Reads without a reject reason."""
    return reads.filter(R.reject_reason(**options).isNull())


def reject_counts(reads: DataFrame, keys: list[str] | None = None, **options) -> DataFrame:
    """Histogram of reject reasons."""
    reason = R.reject_reason(**options).alias("reason")
    return (
        reads.select(*(keys or []), reason)
        .filter(F.col("reason").isNotNull())
        .groupBy(*(keys or []), "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def pair_mates(
    reads: DataFrame,
    keys: list[str],
    qname: str = "qname",
    pos: str = "pos",
    ord: str = "rid",
    flag: str = "flag",
    qlen: str = "qlen",
    hot_rows: int | None = DEFAULT_HOT_ROWS,
) -> DataFrame:
    """Pairs of reads with one name become fragments ``[pos5, pos3)`` with a strand.

    Reads of a name are ranked by (pos, ord) and paired two by two: 1 with 2, 3
    with 4, and so on; an odd one at the end stays alone. One shuffle by name
    and a sort that can spill, so no name is an array. Names of more than
    ``hot_rows`` reads are ranked over range-partitioned slices instead of in
    one task; None leaves that out. Null names are one name. The right end is
    the right mate's start plus its query length.
    """
    slim = reads.select(
        *[F.col(k) for k in keys],
        R.base_name(qname).alias("_name"),
        F.struct(
            F.col(pos).cast("long").alias("pos"), F.col(ord).alias("ord"), F.col(flag).alias("flag"),
            F.col(qlen).cast("long").alias("qlen"),
        ).alias("_read"),
    )
    group = [*keys, "_name"]
    hot = _hot_names(slim, group, hot_rows) if hot_rows is not None else None
    if hot is None:
        return _fragments(_next_to_each_other(slim, group), keys)
    common = _same_keys(slim, hot, group, "left_anti")
    return _fragments(_next_to_each_other(common, group).unionByName(_ranked_pairs(_same_keys(slim, hot, group, "left_semi"), group)), keys)


def _same_keys(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join on keys of which null is a value."""
    renamed = keyed.select(*[F.col(k).alias(f"_h_{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{i}"))
    return rows.join(renamed, same, how)


#: Hashed names that are counted first: only names in full places are counted one by one.
NAME_PLACES = 1 << 16


def _hot_names(slim: DataFrame, group: list[str], hot_rows: int) -> DataFrame | None:
    """Names of more than ``hot_rows`` reads, or None. Counts of hashed names combine on the map side to a fixed number of rows."""
    place = F.pmod(F.xxhash64(*group), F.lit(NAME_PLACES)).alias("_place")
    named = slim.select(*group, place)
    full = materialize(named.groupBy("_place").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select("_place"))
    if full.isEmpty():
        return None
    counted = named.join(full, "_place", "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counted.filter(F.col("_n") > hot_rows).select(*group))
    return None if hot.isEmpty() else hot


def _next_to_each_other(slim: DataFrame, group: list[str]) -> DataFrame:
    """Each odd read of a name with the one after it."""
    order = Window.partitionBy(*group).orderBy("_read.pos", "_read.ord")
    seen = slim.select("*", F.row_number().over(order).alias("_nth"), F.lead("_read").over(order).alias("_second"))
    return seen.filter((F.col("_nth") % 2 == 1) & F.col("_second").isNotNull()).select(*group, F.col("_read").alias("_first"), "_second")


def _ranked_pairs(slim: DataFrame, group: list[str]) -> DataFrame:
    """The same for names of any size: ranks over slices, then groups of two rows."""
    filled = slim.select(F.struct(*group).alias("_group"), "_read")
    ranked = row_numbers(filled, [F.col("_read.pos"), F.col("_read.ord")], ["_group"], "_nth")
    two = ranked.groupBy("_group", F.floor((F.col("_nth") - 1) / 2).alias("_pair")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("_nth", "_read")).alias("_a"), F.max(F.struct("_nth", "_read")).alias("_b")
    )
    return two.filter("_n = 2").select("_group.*", F.col("_a._read").alias("_first"), F.col("_b._read").alias("_second"))


def _fragments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    strand = R.strand_of_pair("_first.flag", "_second.flag")
    # The forward mate gives the left end, the other one the right end. In both accepted flag
    # pairs exactly one mate is forward.
    first_forward = R.is_forward("_first.flag")
    left = F.when(first_forward, F.col("_first.pos")).otherwise(F.col("_second.pos"))
    right = F.when(first_forward, F.col("_second.pos") + F.col("_second.qlen")).otherwise(
        F.col("_first.pos") + F.col("_first.qlen")
    )
    return (
        pairs.select(*keys, left.alias("pos5"), right.alias("pos3"), strand.alias("strand"))
        .filter(F.col("strand").isNotNull() & (F.col("pos5") < F.col("pos3")))
    )


def mark_duplicates(
    reads: DataFrame, keys: list[str], score: str, rid: str = "rid", name: str = "is_duplicate"
) -> DataFrame:
    """Flag all but the best read of every group of copies.

    ``keys`` name a group: the sample, the contig, ``five_prime`` and the
    strand (see ``duplicate_keys``); ``score`` is the sum of base qualities. The
    winner of a group comes from one combined aggregate, and reads meet the
    winners on group and id, so a huge group of copies stays spread out and
    reads of other files that share an id are not mixed up.
    """
    winners = reads.groupBy(*keys).agg(
        F.max_by(F.col(rid), F.struct(F.col(score), -F.col(rid))).alias("_best")
    )
    renamed = winners.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "_best")
    match = F.col(rid) == F.col("_best")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    return reads.join(renamed, match, "left").select(*reads.columns, F.col("_best").isNull().alias(name))


def mark_duplicate_templates(
    reads: DataFrame, keys: list[str], qname: str = "qname", rid: str = "rid", contig: str = "contig", flag: str = "flag",
    name: str = "is_duplicate", min_bq: int = 15, **columns,
) -> DataFrame:
    """Flag copies of templates by both of their ends, and lone reads by their one end.

    An end is (contig, clipped 5' position, strand). Two primary mapped reads of
    one name are a pair, whatever contigs they lie on; pairs with the same two
    ends are copies, and the one with the largest sum of base qualities of
    ``min_bq`` or better stays, of equal ones that with the smallest ``rid``.
    Any other primary mapped read is a lone one: it is a copy if a pair has
    such an end, or else if a better lone read has it. Both reads of a pair
    share its flag. Secondary, supplementary and unmapped reads are never
    flagged and take no part. ``keys`` name a sample or library, in which
    ``rid`` is unique; null is a value of ``keys`` and of a name.

    Winners come from combined aggregates and meet their reads on ids, so a
    huge group of copies, or a name of very many reads, stays spread out.
    """
    primary = reads.filter(~R.has_flag(flag, K.FLAG_UNMAPPED | K.FLAG_SECONDARY | K.FLAG_SUPPLEMENTARY))
    keyed = duplicate_keys(primary, flag=flag, min_bq=min_bq, **columns)
    end = F.struct(F.col(contig).alias("contig"), F.col("five_prime").alias("at"), F.col("reverse").alias("reverse"))
    # ends and pairs are read by several branches, so they are computed once and stored
    slim = materialize(keyed.select(*keys, F.col(qname).alias("_name"), end.alias("_end"), F.col(rid).alias("_rid"), F.col("quality_sum").alias("_score")))
    by_name = slim.groupBy(*keys, "_name").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("_end", "_rid")).alias("_a"), F.max(F.struct("_end", "_rid")).alias("_b"), F.sum("_score").alias("_score")
    )
    pairs = by_name.filter(F.col("_name").isNotNull() & (F.col("_n") == 2))
    pairs = pairs.select(*keys, "_name", F.col("_a._end").alias("_low"), F.col("_b._end").alias("_high"), F.col("_a._rid").alias("_rid_a"), F.col("_b._rid").alias("_rid_b"), "_score")
    pairs = materialize(pairs)
    first_rid = F.least("_rid_a", "_rid_b")
    best_pairs = pairs.groupBy(*keys, "_low", "_high").agg(F.max_by(F.col("_name"), F.struct(F.col("_score"), -first_rid)).alias("_name"))
    worse_pairs = _same_keys(pairs, best_pairs, [*keys, "_name"], "left_anti")
    # lone reads: those of names that are no pair
    lone = _same_keys(slim, pairs, [*keys, "_name"], "left_anti")
    ends = pairs.select(*keys, F.explode(F.array("_low", "_high")).alias("_end"), F.lit(None).cast(slim.schema["_rid"].dataType).alias("_rid"), F.lit(None).cast("long").alias("_score"))
    both = lone.select(*keys, "_end", "_rid", "_score").unionByName(ends)
    best_lone = both.groupBy(*keys, "_end").agg(
        F.max(F.col("_rid").isNull()).alias("_paired"), F.max_by(F.col("_rid"), F.when(F.col("_rid").isNotNull(), F.struct(F.col("_score"), -F.col("_rid")))).alias("_rid")
    )
    worse_lone = _same_keys(lone, best_lone.filter(~F.col("_paired")), [*keys, "_rid"], "left_anti")
    copies = worse_pairs.select(*keys, F.explode(F.array("_rid_a", "_rid_b")).alias("_rid")).unionByName(worse_lone.select(*keys, "_rid"))
    renamed = copies.select(*[F.col(k).alias(f"_d_{k}") for k in keys], F.col("_rid").alias("_copy"))
    match = F.col(rid) == F.col("_copy")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_d_{k}"))
    return reads.join(renamed, match, "left").select(*reads.columns, F.col("_copy").isNotNull().alias(name))


def duplicate_keys(
    reads: DataFrame, pos: str = "pos", cigar: str = "cigar", flag: str = "flag", qual: str | None = "qual", min_bq: int = 15
) -> DataFrame:
    """``reads`` plus what duplicates share and what the best of them is chosen by.

    ``five_prime``: the 5' end with its clipped bases put back; ``reverse``;
    ``quality_sum``: the sum of base qualities of ``min_bq`` or better.
    """
    reverse = R.has_flag(flag, 16)
    lead = F.coalesce(F.regexp_extract(cigar, r"^((?:\d+[SH])+)", 1), F.lit(""))
    tail = F.coalesce(F.regexp_extract(cigar, r"((?:\d+[SH])+)$", 1), F.lit(""))
    clipped = lambda ops: F.aggregate(
        F.regexp_extract_all(ops, F.lit(r"(\d+)"), F.lit(1)), F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long")
    )
    end = F.when(reverse, F.col(pos) + ref_span(cigar) + clipped(tail) - 1).otherwise(F.col(pos) - clipped(lead))
    out = reads.withColumn("five_prime", end.cast("long")).withColumn("reverse", reverse)
    if qual is None:
        return out
    total = F.aggregate(F.filter(qual, lambda q: q >= min_bq), F.lit(0).cast("long"), lambda acc, q: acc + q.cast("long"))
    return out.withColumn("quality_sum", F.coalesce(total, F.lit(0).cast("long")))


def fix_mate_info(
    reads: DataFrame, keys: list[str], pos: str = "pos", contig: str = "contig", flag: str = "flag",
    end: str = "end", rid: str = "rid",
) -> DataFrame:
    """Mate contig, position, strand and signed template length from the partner read.

    ``keys`` name a template, its sample included; ids need only differ within it. Templates that do not have exactly two reads stay without mate.
    """
    read = F.struct(
        F.col(pos).cast("long").alias("pos"), F.col(rid).alias("rid"), F.col(contig).alias("contig"),
        R.has_flag(flag, 16).alias("reverse"), F.col(end).cast("long").alias("end"),
    )
    pairs = (
        reads.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(read).alias("_a"), F.max(read).alias("_b"))
        .filter(F.col("_n") == 2)
    )
    span = F.when(
        F.col("_a.contig") == F.col("_b.contig"),
        F.greatest(F.col("_a.end"), F.col("_b.end")) - F.least(F.col("_a.pos"), F.col("_b.pos")),
    ).otherwise(F.lit(0).cast("long"))

    def side(me: str, mate: str, sign: int) -> Column:
        return F.struct(
            F.col(f"{me}.rid").alias("rid"), F.col(f"{mate}.contig").alias("mate_contig"),
            F.col(f"{mate}.pos").alias("mate_pos"), F.col(f"{mate}.reverse").alias("mate_reverse"),
            (span * sign).alias("template_len"),
        )

    mates = pairs.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.explode(F.array(side("_a", "_b", 1), side("_b", "_a", -1))).alias("_m"))
    match = F.col(rid) == F.col("_m.rid")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    found = ["mate_contig", "mate_pos", "mate_reverse", "template_len"]
    return reads.join(mates, match, "left").select(*reads.columns, *[F.col(f"_m.{c}").alias(c) for c in found])


def ref_span(cigar: Column | str) -> Column:
    """Reference bases an alignment covers (M, =, X, D and N operations)."""
    parts = F.regexp_extract_all(F.col(cigar) if isinstance(cigar, str) else cigar, F.lit(r"(\d+)[M=XDN]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long"))


def with_steps(reads: DataFrame, keep: list[str], cigar: str = "cigar") -> DataFrame:
    """``keep`` plus ``_ops``: per CIGAR operation op, len, and its offsets r on the reference and q on the read.

    M = X move both axes, I S the read, D N the reference. The text is parsed
    once per read, and an offset is the sum of the lengths before it.
    """
    parsed = reads.select(*keep, R.parse_cigar(cigar).alias("_cigar"))

    def lengths(kinds: str) -> Column:
        return F.transform("_cigar", lambda o: F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))

    def before(column: str, i: Column) -> Column:
        return F.aggregate(F.slice(F.col(column), F.lit(1), i), F.lit(0), lambda acc, n: acc + n)

    moved = parsed.select(*keep, "_cigar", lengths("M=XDN").alias("_on_ref"), lengths("M=XIS").alias("_on_read"))
    step = F.transform(
        "_cigar", lambda o, i: F.struct(o["op"].alias("op"), o["len"].alias("len"), before("_on_ref", i).alias("r"), before("_on_read", i).alias("q"))
    )
    return moved.select(*keep, step.alias("_ops"))


def expand_alignment(
    reads: DataFrame,
    keep: list[str],
    pos: str = "pos",
    cigar: str = "cigar",
    seq: str = "seq",
    qual: str = "qual",
    window: tuple[str, str] | None = None,
    ref: str | None = None,
    skips: bool = False,
) -> DataFrame:
    """Rows of events per read: bases, deleted bases, and the indels themselves.

    Output: ``keep`` plus ``kind`` (base, del_base, ins, del), ``ref_pos``, ``base``,
    ``bq`` and ``event`` (inserted or deleted sequence, else null). A deleted base
    has base ``-`` and the quality of the next query base, or 0 at the end. Indel
    rows sit at the reference position where they start, ``base`` is the read's
    base before the event, and the quality is the mean of the inserted bases or
    that of the next base. ``skips`` adds skip rows for the positions of N operations.

    ``window`` names two columns with the window ``[start, end)`` of the row;
    events are clipped to it by the rules of the per-site stack: an indel needs
    a base of the read kept before it, an insertion is cut to the part of the
    window that is left, a deletion to the window. ``ref`` names a column with
    the reference sequence of the window, used to spell deletions (else N).
    Everything is built from native array functions.
    """
    lo, hi = (F.col(window[0]), F.col(window[1])) if window else (None, None)
    extra = list(window or ()) + ([ref] if ref else [])
    carried = list(dict.fromkeys([*keep, pos, seq, qual, *extra]))
    base = reads.filter(F.col(cigar).isNotNull() & F.col(seq).isNotNull())
    if window:
        base = base.filter(F.col(pos) < hi)
    located = with_steps(base, carried, cigar)
    # First reference position at which this read keeps a base (or deleted base) inside the window.
    advancing = F.filter(F.col("_ops"), lambda o: o["op"].isin("M", "=", "X", "D"))
    if window:
        advancing = F.filter(
            advancing,
            lambda o: (F.col(pos) + o["r"] + o["len"] > lo) & (F.col(pos) + o["r"] < hi),
        )
    first_kept = F.array_min(
        F.transform(advancing, lambda o: F.greatest(F.col(pos) + o["r"], lo) if window else F.col(pos) + o["r"])
    )
    one = located.select(*carried, first_kept.alias("_first"), F.explode("_ops").alias("_o")).filter(
        F.col("_o.op").isin("M", "=", "X", "D", "I", *(["N"] if skips else []))
    )
    one = one.select(
        *carried, "_first", F.col("_o.op").alias("_op"), F.col("_o.len").alias("_len"),
        (F.col(pos) + F.col("_o.r")).cast("long").alias("_rp"), F.col("_o.q").alias("_q"),
    )
    s, e = F.col("_rp"), F.col("_rp") + F.col("_len")
    if window:
        s, e = F.greatest(s, lo), F.least(e, hi)
    anchored = F.col("_first").isNotNull() & (F.col("_first") < F.col("_rp"))
    event_len = F.least(F.col("_len"), (hi - F.col("_rp")).cast("int")) if window else F.col("_len")
    has_event = F.col("_op").isin("I", "D") & anchored & (event_len > 0)
    # Positions of the operation, and one more entry for the event itself; the generator and the
    # projection after it run in generated code, so no per-base lambda is interpreted.
    nothing = F.array().cast("array<bigint>")
    spots = F.concat(
        F.when((F.col("_op") != "I") & (e > s), F.sequence(s, e - 1)).otherwise(nothing),
        F.when(has_event, F.array(F.lit(-1).cast("long"))).otherwise(nothing),
    )
    rows = one.select("*", event_len.alias("_n"), F.explode(spots).alias("_p"))
    event = F.col("_p") < 0
    inserted, deleted, skipped = F.col("_op") == "I", F.col("_op") == "D", F.col("_op") == "N"
    at = (F.col("_q") + F.col("_p") - F.col("_rp")).cast("int")
    next_quality = F.coalesce(F.get(F.col(qual), F.col("_q")), F.lit(0)).cast("double")
    ins_quality = F.slice(F.col(qual), F.col("_q") + 1, F.greatest(F.col("_n"), F.lit(0)))
    ins_mean = F.try_divide(
        F.aggregate(ins_quality, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.size(ins_quality)
    )
    if ref and window:
        del_seq = F.substring(F.col(ref), (F.col("_rp") - lo + 1).cast("int"), F.col("_n"))
    else:
        del_seq = F.repeat(F.lit("N"), F.greatest(F.col("_n"), F.lit(0)))
    return rows.select(
        *keep,
        F.when(event, F.when(inserted, "ins").otherwise("del"))
        .when(deleted, "del_base").when(skipped, "skip").otherwise("base").alias("kind"),
        F.when(event, F.col("_rp")).otherwise(F.col("_p")).alias("ref_pos"),
        F.when(event, F.substring(F.col(seq), F.col("_q"), F.lit(1)))
        .when(deleted, "-").when(skipped, ">")
        .otherwise(F.substring(F.col(seq), at + 1, F.lit(1))).alias("base"),
        F.when(event & inserted, ins_mean).when(event | deleted | skipped, next_quality)
        .otherwise(F.get(F.col(qual), at).cast("double")).alias("bq"),
        F.when(event & inserted, F.substring(F.col(seq), F.col("_q") + 1, F.col("_n")))
        .when(event, del_seq).alias("event"),
    )
