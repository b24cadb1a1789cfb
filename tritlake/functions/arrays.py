"""Distances and order statistics over arrays of integers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once: inside a lambda an expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x * y).cast("long")))


def sad(a: Column, b: Column) -> Column:
    """Sum of absolute differences."""
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")))


def squares(a: Column, b: Column) -> Column:
    """Sum of squared differences."""
    return total(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("long")))


def chi_square(a: Column, b: Column) -> Column:
    """-sum of (x-y)^2 / (x+y) over the cells that are not both zero, nine digits."""
    part = F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0)))
    return F.round(-F.aggregate(part, F.lit(0.0), lambda s, x: s + x), 9)


def order_stat(a: Column, place: Column | int) -> Column:
    """The value at a place (from 0) of the sorted array; never interpolated."""
    return F.get(F.sort_array(a), F.lit(place) if isinstance(place, int) else place)


def div(a: Column, b: Column) -> Column:
    """Integer quotient, truncated towards zero."""
    a, b = a.cast("long"), b.cast("long")
    q = ((F.abs(a) - F.pmod(F.abs(a), F.abs(b))) / F.abs(b)).cast("long")
    return F.when((a < 0) != (b < 0), -q).otherwise(q)


def packed_bits(bits: Column) -> Column:
    """Bits (0 or 1, least first) as one long."""
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x.cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
