"""Block sizes 3 * 2**n, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockprint.constants import BLOCK_SIZES, MIN_BLOCK_SIZE


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid(size: Column | str) -> Column:
    s = col(size).cast("long")
    third = F.floor(s / 3).cast("long")
    return (s > 0) & (s % MIN_BLOCK_SIZE == 0) & (F.bit_count(third) == 1) & (third <= 1 << (BLOCK_SIZES - 1))


def is_log_valid(log: Column | str) -> Column:
    return col(log).between(0, BLOCK_SIZES - 1)


def from_log(log: Column | str) -> Column:
    """3 * 2**log, or null where log is not valid."""
    n = F.when(is_log_valid(log), col(log)).cast("int")
    return F.when(n.isNotNull(), F.call_function("shiftleft", F.lit(3).cast("long"), n))


def log_of(size: Column | str) -> Column:
    """n of a valid block size; null for others."""
    s = col(size).cast("long")
    return F.when(is_valid(s), F.bit_count(F.floor(s / 3).cast("long") - 1)).cast("int")


def is_near(a: Column | str, b: Column | str) -> Column:
    return F.abs(col(a) - col(b)) <= 1


def is_near_eq(a: Column | str, b: Column | str) -> Column:
    return col(a) == col(b)


def is_near_lt(a: Column | str, b: Column | str) -> Column:
    return col(b) - col(a) == 1


def is_near_gt(a: Column | str, b: Column | str) -> Column:
    return col(a) - col(b) == 1


def relation(a: Column | str, b: Column | str) -> Column:
    """NearLt, NearEq, NearGt or Far, of two log block sizes."""
    d = col(a) - col(b)
    return F.when(d == -1, "NearLt").when(d == 0, "NearEq").when(d == 1, "NearGt").when(d.isNotNull(), "Far")


def compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1."""
    return F.signum(col(a) - col(b)).cast("int")


def preferred_input_size(log: Column | str) -> Column:
    """The largest input for which a log block size is a first guess: 192 * 2**log."""
    return F.call_function("shiftleft", F.lit(192).cast("long"), col(log).cast("int"))


def log_for_input_size(size: Column | str, start: Column | str | int = 0) -> Column:
    """The smallest log block size, from start on, whose preferred input size holds size bytes."""
    s = col(size).cast("long")
    first = F.when(s <= 192, F.lit(0)).otherwise(F.length(F.bin(F.floor((s - 1) / 192).cast("long"))))
    return F.greatest(F.lit(start) if isinstance(start, int) else col(start), first).cast("int")


def is_small_input(size: Column | str) -> Column:
    """Whether a digest of so few bytes is of little use."""
    return col(size) < 4097
