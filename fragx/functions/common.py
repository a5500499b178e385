"""Small helpers shared by the expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round6(c: Column | str) -> Column:
    """Six decimals, with negative zero folded into zero."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def floor_div(c: Column | str, width: int | Column) -> Column:
    """Integer floor division for positions (long), also for negative values."""
    value = col(c).cast("long")
    divisor = width if isinstance(width, Column) else F.lit(int(width))
    return F.floor((value - F.pmod(value, divisor)) / divisor).cast("long")


def literal_map(mapping: dict) -> Column:
    """A small constant map as an expression."""
    parts = []
    for key, value in mapping.items():
        parts += [F.lit(key), F.lit(value)]
    return F.create_map(*parts)


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ascii_cut(text: Column | str, at: Column, size: Column) -> Column:
    """``substring`` of ASCII text (genome letters), ``at`` from 1, by byte place: characters would be counted from the start, row by row."""
    return F.substring((F.col(text) if isinstance(text, str) else text).cast("binary"), at, size).cast("string")
