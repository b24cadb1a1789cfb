"""Transforms and shape features of an image: Walsh-Hadamard, Haar bands, derivative signs, packed trits, colour planes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import div, let, total
from .grid import Grid, percentile_bounds


def walsh(a: Column, size: int) -> Column:
    """Walsh-Hadamard transform of an array of `size` (a power of two) by butterflies; of a row-major square also the two-dimensional one."""
    step = 1
    while step < size:
        a = let(a, _butterflies(step))
        step *= 2
    return a


def _butterflies(s: int) -> Callable[[Column], Column]:
    return lambda v: F.transform(v, lambda x, i: F.when(i.bitwiseAND(F.lit(s)) == 0, x + F.get(v, i + s)).otherwise(F.get(v, i - s) - x))


def haar_bands(g: Grid, px: Column, first: int, last: int) -> Column:
    """Sums of absolute values over the rows first to last - 1: the coarsest means, then the differences of levels 1, 2 and 3.

    A row is padded with zeros to a power of two. Means are halved towards zero; sums are cut at 32767.
    """
    width = 1 << (g.w - 1).bit_length()
    rows = F.transform(F.sequence(F.lit(first), F.lit(last - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.when(x < g.w, F.get(px, y * g.w + x)).otherwise(0)))
    halves = lambda rows, n, fn: F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), F.lit(n // 2 - 1)), lambda i: fn(F.get(r, i * 2), F.get(r, i * 2 + 1))))
    size = lambda rows: F.least(F.lit(32767), F.aggregate(rows, F.lit(0).cast("long"), lambda s, r: s + total(F.transform(r, lambda v: F.abs(v))))).cast("int")
    mean, gap = lambda a, b: div(a + b, F.lit(2)).cast("int"), lambda a, b: a - b
    one = lambda r1: let(halves(r1, width, mean), lambda r2: let(halves(r2, width // 2, mean), lambda r3: F.array(size(halves(r3, width // 4, mean)), size(halves(r1, width, gap)), size(halves(r2, width // 2, gap)), size(halves(r3, width // 4, gap)))))
    return let(rows, one)


def jets(g: Grid, t: Column, cells: int) -> Column:
    """Bins region * 7 + kind of surface of the inner cells, from signs of derivatives of the ternary plane.

    Kinds: flat 0, slope 1, peak 2, pit 3, saddle 4, ridge 5, valley 6.
    """

    def one(v: Column, i: Column, x: Column, y: Column) -> Column:
        at = lambda dy, dx: F.get(t, i + dy * g.w + dx)
        fx, fy = at(0, 1) - at(0, -1), at(1, 0) - at(-1, 0)
        fxx, fyy = at(0, 1) - v * 2 + at(0, -1), at(1, 0) - v * 2 + at(-1, 0)
        fxy = at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)
        det, trace = fxx * fyy - fxy * fxy, fxx + fyy
        curved = F.when(det > 0, F.when(trace < 0, 2).otherwise(3)).when(det < 0, 4).otherwise(F.when(trace < 0, 5).otherwise(6))
        kind = F.when(F.abs(fxx) + F.abs(fyy) + F.abs(fxy) > 0, curved).when(F.abs(fx) + F.abs(fy) > 0, 1).otherwise(0)
        region = (div(y * cells, F.lit(g.h)) * cells + div(x * cells, F.lit(g.w))).cast("int")
        return F.when((x > 0) & (x < g.w - 1) & (y > 0) & (y < g.h - 1), region * 7 + kind)

    return F.filter(g._map(t, one), lambda b: b.isNotNull())


def packed_trits(t: Column) -> Column:
    """Four trits a byte, the first in the lowest two bits: 1 as 01, 0 as 10, -1 as 11. Trits beyond a multiple of four are left out."""
    code = lambda v: F.when(v == 1, 1).when(v == 0, 2).otherwise(3)
    each = lambda k: code(F.get(t, k * 4)) + code(F.get(t, k * 4 + 1)) * 4 + code(F.get(t, k * 4 + 2)) * 16 + code(F.get(t, k * 4 + 3)) * 64
    return F.transform(F.sequence(F.lit(0), div(F.size(t), F.lit(4)).cast("int") - 1), each)


def unpacked_trits(b: Column) -> Column:
    trit = lambda v: F.when(v == 1, 1).when(v == 3, -1).otherwise(0)
    return F.flatten(F.transform(b, lambda v: F.array(*(trit(F.shiftright(v, 2 * k).bitwiseAND(F.lit(3))) for k in range(4)))))


def ternary_per_plane(px: Column, low: tuple[int, int] = (1, 3), high: tuple[int, int] = (2, 3), planes: int = 3) -> Column:
    """Ternary by the percentiles of each plane of interleaved planes."""
    plane = lambda c: F.filter(px, lambda v, i: i % planes == c)
    bounds = [percentile_bounds(plane(c), low, high) for c in range(planes)]
    both = F.array(*(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")) for lo, hi in bounds))
    return let(both, lambda b: F.transform(px, lambda v, i: F.when(v > F.get(b, i % planes)["hi"], 1).when(v < F.get(b, i % planes)["lo"], -1).otherwise(0)))


def counts_of(bins: Column) -> Column:
    """Map bin -> how often, of an array of bins."""
    return let(bins, lambda a: F.map_from_entries(F.transform(F.array_distinct(a), lambda k: F.struct(k.alias("k"), F.size(F.filter(a, lambda b: b == k)).cast("long").alias("n")))))


def sums_of(cells: Column) -> Column:
    """Map bin -> sum of v, at most 32767, of an array of structs (bin, v)."""
    own = lambda a, k: F.least(F.lit(32767).cast("long"), total(F.transform(F.filter(a, lambda c: c["bin"] == k), lambda c: c["v"])))
    return let(cells, lambda a: F.map_from_entries(F.transform(F.array_distinct(F.transform(a, lambda c: c["bin"])), lambda k: F.struct(k.alias("k"), own(a, k).alias("n")))))


def map_l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two maps of counts; what is missing is 0."""
    zero = F.lit(0).cast("long")
    return total(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.abs(F.coalesce(x, zero) - F.coalesce(y, zero)))))
