"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own columns of an event table beside its properties.
SUBJECT, INDEX = "subject_id", "event_index"
MICROS_PER_DAY = 86_400_000_000


def empty_to_null(c: Column) -> Column:
    """An empty string is no value."""
    return F.nullif(c, F.lit(""))


def micros_between(earlier: Column, later: Column) -> Column:
    """Microseconds from one zone-free timestamp to another, exact before 1970 too."""
    return F.timestamp_diff("MICROSECOND", earlier, later)


def whole(dividend: Column, divisor: int) -> Column:
    """The quotient of integers, cut off towards zero."""
    return F.call_function("div", dividend, F.lit(divisor).cast("bigint"))


def next_power_of_two(c: Column) -> Column:
    """The least power of two that is not below a positive whole number."""
    return F.when(c <= 1, F.lit(1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(c - 1))))


def hash_part(c: Column, parts: int) -> Column:
    """A number from 0 to parts - 1 for a value, which any engine that has md5 can compute."""
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(parts)).cast("int")
