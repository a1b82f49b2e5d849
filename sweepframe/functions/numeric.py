"""Numeric column functions: finite tests, single-precision steps, safe fractions, times and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(*columns: Column | str) -> Column:
    """True if every column is a finite number; NaN compares as large and equal to itself in Spark, so it is tested by name."""
    out = F.lit(True)
    for c in columns:
        c = F.col(c) if isinstance(c, str) else c
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def f32(value: Column) -> Column:
    """One single-precision rounding; a sum, product or quotient of two floats in double precision, cast back, is the float result."""
    return value.cast("float")


def cell(value: Column, origin: float, size: float) -> Column:
    """Grid cell of a float coordinate, computed in single precision as detectors do: floor((value - origin) / size)."""
    return F.floor(f32(f32(value.cast("double") - F.lit(float(origin))).cast("double") / F.lit(float(size)))).cast("int")


def fraction(part: Column, whole: Column, empty: float | None = None) -> Column:
    """part / whole, and `empty` where whole is 0: 1.0 for fidelity, 0.0 for coverage, None for report columns."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty).cast("double"))


def stamp_ns(seconds: Column, nanoseconds: Column) -> Column:
    return seconds.cast("long") * F.lit(1_000_000_000) + nanoseconds.cast("long")


def ns_to_us(ns: Column) -> Column:
    """Floor to microseconds, below zero too; in integers, as a double can't hold today's nanoseconds."""
    return F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))


def parse_timestamp_ns(text: Column) -> Column:
    """'YYYY-MM-DD hh:mm:ss.fffffffff' as exact nanoseconds; null if it is no such time. Needs UTC as the session time zone."""
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\.(\d{9})$"
    whole = F.try_to_timestamp(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.unix_seconds(whole) * F.lit(1_000_000_000) + F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).cast("long")


def decimal_seconds_ns(text: Column) -> Column:
    return (text.cast("decimal(20,9)") * F.lit(1_000_000_000).cast("decimal(10,0)")).cast("long")


def acquisition_id(frame: Column, seconds: Column, nanoseconds: Column) -> Column:
    return F.concat(F.trim(frame), F.lit("@"), seconds.cast("string"), F.lit("."), F.lpad(nanoseconds.cast("string"), 9, "0"))


def frame_id(drive: Column, index: Column) -> Column:
    return F.concat(drive, F.lit("/"), F.lpad(index.cast("string"), 10, "0"))


def require(condition: Column, message: str, value: Column) -> Column:
    """value where the condition holds; the job fails with the message elsewhere."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def gib(nbytes: Column) -> Column:
    return nbytes / F.lit(1073741824.0)
