"""Scalar expressions over epoch milliseconds and values; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(ts: Column) -> Column:
    """Epoch milliseconds (floor) of a timestamp with or without zone; sessions run in UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def parse_time(text: Column) -> Column:
    """Epoch milliseconds of ``yyyy-MM-dd[ HH:mm:ss[.SSS]]`` in UTC, null if it is none of these."""
    forms = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.unix_millis(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms]))


def format_time(t: Column, pattern: str = "yyyy-MM-dd HH:mm:ss.SSS") -> Column:
    return F.date_format(F.timestamp_millis(t), pattern)


def bucket(t: Column, start: int, width: int) -> Column:
    """Number of the bucket of ``width`` from ``start``; rows before ``start`` must be filtered out."""
    return F.call_function("div", t - F.lit(start), F.lit(width))


def pixel_id(v: Column, low: Column, high: Column, height: int) -> Column:
    """Pixel row of a value on a scale of ``height`` rows, truncated; a constant scale has row 0 only."""
    part = F.try_divide(F.lit(height - 1) * (v - low), high - low)
    return F.greatest(F.lit(0), F.least(F.lit(height - 1), F.coalesce(part, F.lit(0.0)).cast("int")))


def on_line(t0: Column, v0: Column, t1: Column, v1: Column, at: Column, low: Column, high: Column) -> Column:
    """Value at time ``at`` of the line from (t0, v0) to (t1, v1), within the view."""
    slope = F.coalesce(F.try_divide(v1 - v0, (t1 - t0).cast("double")), F.lit(0.0))
    return F.least(F.greatest(v0 + slope * (at - t0), low), high)


def range_text(low: Column, high: Column) -> Column:
    return F.concat(F.lit("["), low.cast("string"), F.lit(".."), high.cast("string"), F.lit("]"))


def memory_bytes(points: Column, per_point: int = 16) -> Column:
    """Bytes that so many points take as packed numbers."""
    return points * F.lit(per_point)


# predicates on half-open intervals [a, b)


def contains(start: Column, end: Column, x: Column) -> Column:
    return (start <= x) & (x < end)


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (b > c) & (d > a)


def encloses(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a <= c) & (b >= d)


def adjacent(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a == d) | (b == c)


def coverage(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Share of [c, d) that [a, b) covers, for overlapping intervals."""
    missing = F.greatest(d - b, F.lit(0)) + F.greatest(a - c, F.lit(0))
    return 1 - missing / (d - c)
