"""Sequence, region-label and token expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fragx.functions.common import col, floor_div, literal_map

# Ambiguity codes and the base each one falls back to.
AMBIGUOUS, FALLBACK = "RYSWKMBDHV", "ACGAGACAAA"

# Token vocabulary of nucleotide sequences.
PREPEND_TOKENS = ["<cls>", "<pad>", "<eos>", "<unk>"]
FRAGMENT_TOKENS = ["A", "C", "G", "T", "U", "N", ".", "-", "x"]
APPEND_TOKENS = ["<mask>"]


def rev_comp(seq: Column | str) -> Column:
    return F.translate(F.reverse(col(seq)), "ACGT", "TGCA")


def region_to_string(contig, start, end) -> Column:
    """Half-open 0-based region to the closed 1-based text form."""
    contig, start, end = col(contig), col(start), col(end)
    return (
        F.when(start.isNull() & end.isNull(), contig)
        .when(start.isNull(), F.concat(contig, F.lit(":1-"), end.cast("string")))
        .when(
            end.isNotNull(),
            F.concat(contig, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string")),
        )
    )


def string_to_region(region: Column | str) -> Column:
    """Text region to struct(contig, start, end); absent parts are null."""
    region = col(region)
    pattern = r"^(chr[^:]+)(?::(\d+)?(?:-(\d+))?)?$"

    def part(i):
        return F.nullif(F.regexp_extract(region, pattern, i), F.lit(""))

    return F.struct(
        part(1).alias("contig"),
        (part(2).cast("long") - 1).alias("start"),
        part(3).cast("long").alias("end"),
    )


def bin_start(pos: Column | str, width: int) -> Column:
    return floor_div(pos, width) * F.lit(width).cast("long")


def bin_label(contig, pos, width: int) -> Column:
    """``contig:start-end`` of the bin that holds a position; the end is not truncated."""
    start = bin_start(pos, width)
    return F.concat(col(contig), F.lit(":"), start.cast("string"), F.lit("-"), (start + width).cast("string"))


def sanitize_bases(seq: Column | str) -> Column:
    """Ambiguity codes become their first base, unknown letters N; case is kept."""
    fixed = F.translate(
        col(seq), AMBIGUOUS + AMBIGUOUS.lower(), FALLBACK + FALLBACK.lower()
    )
    fixed = F.regexp_replace(fixed, r"[^ACGTUNacgtun.\-*#a-z]", "N")
    return F.regexp_replace(fixed, r"[b-z&&[^cgtun]]", "n")


def parse_indel_token(token: Column | str) -> Column:
    """``A+2CG`` to ``ACG``; null when the stated length is wrong."""
    token = col(token)
    pattern = r"^(.)[+\-](\d+)(\D*)$"
    seq = F.regexp_extract(token, pattern, 3)
    stated = F.regexp_extract(token, pattern, 2)
    ok = token.rlike(pattern) & (F.try_to_number(F.nullif(stated, F.lit("")), F.lit("999999999")) == F.length(seq))
    return F.when(ok, F.concat(F.substring(token, 1, 1), seq))


def center_crop(value: Column | str, max_len: int, is_array: bool = False) -> Column:
    """The middle ``max_len`` characters or elements; shorter values stay as they are."""
    value = col(value)
    size = F.size(value) if is_array else F.length(value)
    start = (F.floor((size - max_len) / 2) + 1).cast("int")
    cut = F.slice(value, F.greatest(start, F.lit(1)), max_len) if is_array else F.substring(
        value, F.greatest(start, F.lit(1)), F.lit(max_len)
    )
    return F.when(size > max_len, cut).otherwise(value)


def vocabulary(standard: list[str] | None = None) -> dict[str, int]:
    """Token ids: specials, standard tokens, null tokens up to a multiple of 8, mask."""
    tokens = PREPEND_TOKENS + list(standard or FRAGMENT_TOKENS)
    fill = -len(tokens) % 8
    tokens = tokens + [f"<null_{i + 1}>" for i in range(fill)] + APPEND_TOKENS
    return {token: i for i, token in enumerate(tokens)}


def encode_chars(
    text: Column | str,
    vocab: dict[str, int] | None = None,
    bos: bool = False,
    eos: bool = False,
    max_length: int | None = None,
    pad: bool = False,
) -> Column:
    """One token id per character, with the start, end, cut and padding rules."""
    vocab = vocab or vocabulary()
    chars = F.filter(F.split(col(text), ""), lambda c: F.trim(c) != "")
    table = literal_map(vocab)
    ids = F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(vocab["<unk>"])))
    if bos:
        ids = F.concat(F.array(F.lit(vocab["<cls>"])), ids)
    if eos:
        ids = F.concat(ids, F.array(F.lit(vocab["<eos>"])))
    if max_length is not None:
        ids = F.slice(ids, 1, max_length)
        if pad:
            short = F.greatest(F.lit(max_length) - F.size(ids), F.lit(0))
            ids = F.concat(ids, F.array_repeat(F.lit(vocab["<pad>"]), short))
    return ids


def decode_tokens(ids: Column | str, vocab: dict[str, int] | None = None) -> Column:
    """Token ids back to text; special tokens print as a gap."""
    vocab = vocab or vocabulary()
    letters = literal_map({i: (t if len(t) == 1 else ".") for t, i in vocab.items()})
    return F.array_join(F.transform(col(ids), lambda i: F.coalesce(F.try_element_at(letters, i), F.lit("."))), "")


def insertion_track(insertions: Column | str, length: Column | int) -> Column:
    """Insertions ``array<struct<idx,seq>>`` written over a row of dots, clipped to its length."""
    size = length if isinstance(length, Column) else F.lit(length)
    return F.aggregate(
        col(insertions),
        F.repeat(F.lit("."), size),
        lambda track, ins: F.substring(
            F.concat(
                F.substring(track, F.lit(1), ins["idx"].cast("int")),
                ins["seq"],
                F.substring(track, (ins["idx"] + F.length(ins["seq"]) + 1).cast("int"), size),
            ),
            F.lit(1),
            size,
        ),
    )


def masked_mean(mask: Column | str, values: Column | str, eps: float = 1e-10) -> Column:
    """Sum of masked values over the mask total plus ``eps``."""
    zero = F.lit(0.0)

    def total(c):
        return F.aggregate(c, zero, lambda acc, x: acc + x)

    weighted = F.zip_with(col(mask), col(values), lambda m, v: m.cast("double") * v.cast("double"))
    return total(weighted) / (total(F.transform(col(mask), lambda m: m.cast("double"))) + F.lit(eps))


def pick_indel_alt(predicted: Column | str, observed: Column | str, n: int = 1) -> Column:
    """Observed alleles that extend a prediction first (in prediction order), then the others, up to n."""
    observed = col(observed)
    predicted = F.coalesce(col(predicted), F.array().cast("array<string>"))
    hits = F.transform(
        predicted, lambda p: F.try_element_at(F.filter(observed, lambda o: o.startswith(p)), F.lit(1))
    )
    matched = F.array_distinct(F.filter(hits, lambda h: h.isNotNull()))
    return F.slice(F.concat(matched, F.array_except(observed, matched)), 1, n)
