"""Row-major images as arrays: quantizers, gradients, codes and per-image features for a grid of any size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import div, let, order_stat, total

#: Default thresholds of the ternary quantizer: above `HI` is 1, below `LO` is -1.
LO, HI = 85, 170
#: Code of a block of three zeros; also that of no transition.
ZERO_CODE = 13


def sign(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def clamp(x: Column, most: int) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x)).cast("int")


# Quantizers: array<int> of 0..255 -> array<int>


def ternary(px: Column, lo: Column | int = LO, hi: Column | int = HI) -> Column:
    if isinstance(lo, int) and isinstance(hi, int):
        return F.transform(px, lambda p: F.when(p > hi, 1).when(p < lo, -1).otherwise(0))
    lo, hi = (F.lit(v) if isinstance(v, int) else v for v in (lo, hi))
    bounds = F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    return let(bounds, lambda b: F.transform(px, lambda p: F.when(p > b["hi"], 1).when(p < b["lo"], -1).otherwise(0)))


def percentile_bounds(px: Column, low: tuple[int, int] = (1, 3), high: tuple[int, int] = (2, 3)) -> tuple[Column, Column]:
    """Order statistics at the places n*low and n*high; if equal, both move one apart, within 0..255."""
    n = F.size(px)
    lo, hi = (order_stat(px, div(n * a, F.lit(b)).cast("int")) for a, b in (low, high))
    return F.when(lo == hi, F.greatest(lo - 1, F.lit(0))).otherwise(lo), F.when(lo == hi, F.least(hi + 1, F.lit(255))).otherwise(hi)


def ternary_percentile(px: Column, low: tuple[int, int] = (1, 3), high: tuple[int, int] = (2, 3)) -> Column:
    return ternary(px, *percentile_bounds(px, low, high))


def ternary_hist_percentile(px: Column, low: int = 33, high: int = 67) -> Column:
    """Least value whose cumulated count exceeds n*pct/100; an upper bound not above the lower is one more than it."""
    n = F.size(px)
    lo, hi = (order_stat(px, div(n * p, F.lit(100)).cast("int")) for p in (low, high))
    return ternary(px, lo, F.when(hi <= lo, lo + 1).otherwise(hi))


def ternary_nonzero_percentile(px: Column, low: int = 33, high: int = 67) -> Column:
    """Over the non-zero pixels: least value whose cumulated count reaches nz*pct/100.

    85 and 170 with ten or fewer of them, or when the bounds do not part. The search does not tell a bound of just 85 (or
    170) from one that is still open: it then takes the value after 85, while at 170 the search has ended.
    """
    some = F.filter(px, lambda p: p > 0)
    nz = F.size(some)

    def bound(pct: int, open_at: int) -> Column:
        place = F.greatest(div(nz * pct, F.lit(100)), F.lit(1)) - 1
        found = F.when(div(nz * pct, F.lit(100)) < 1, F.lit(1)).otherwise(order_stat(some, place.cast("int")))
        return F.when(found == open_at, found + 1).otherwise(found) if open_at == LO else found

    lo, hi = bound(low, LO), bound(high, HI)
    bad = (nz <= 10) | (lo >= hi)
    return ternary(px, F.when(bad, LO).otherwise(lo), F.when(bad, HI).otherwise(hi))


def median_split(px: Column) -> Column:
    med = order_stat(px, div(F.size(px), F.lit(2)).cast("int"))
    return ternary(px, med, med)


def binary(px: Column, at: int = 128) -> Column:
    return F.transform(px, lambda p: F.when(p >= at, 1).otherwise(-1))


def pentary(px: Column, bounds: tuple[int, int, int, int] = (64, 128, 192, 224)) -> Column:
    a, b, c, d = bounds
    return F.transform(px, lambda p: F.when(p >= d, 2).when(p >= c, 1).when(p >= b, 0).when(p >= a, -1).otherwise(-2))


def pentary_adaptive(px: Column) -> Column:
    a, b, c, d = (order_stat(px, div(F.size(px) * k, F.lit(5)).cast("int")) for k in (1, 2, 3, 4))
    levels = F.array(a, b, c, d)
    return let(levels, lambda q: F.transform(px, lambda p: F.when(p > q[3], 2).when(p > q[2], 1).when(p > q[1], 0).when(p > q[0], -1).otherwise(-2)))


def balanced_digits(px: Column) -> Column:
    """81 levels as four balanced ternary digits, most significant first: array of struct<d3,d2,d1,d0>."""

    def digits(p: Column) -> Column:
        bin_ = div(p * 81, F.lit(256))
        d = [(div(bin_, F.lit(w)) % 3 - 1).cast("int").alias(f"d{k}") for k, w in ((3, 27), (2, 9), (1, 3), (0, 1))]
        return F.struct(*d)

    return F.transform(px, digits)


@dataclass(frozen=True)
class Grid:
    """An image of `h` rows and `w` columns."""

    w: int = 28
    h: int = 28

    @property
    def n(self) -> int:
        return self.w * self.h

    @property
    def strips(self) -> int:
        """Blocks of three in a row; columns that are left over belong to none."""
        return self.w // 3

    def _map(self, a: Column, fn: Callable[[Column, Column, Column, Column], Column]) -> Column:
        """fn(value, index, x, y) for each cell."""
        return F.transform(a, lambda v, i: fn(v, i, i % self.w, div(i, F.lit(self.w)).cast("int")))

    # Gradients and quantizers that look at neighbours

    def step_h(self, a: Column) -> Column:
        """Difference to the right neighbour, 0 in the last column."""
        return self._map(a, lambda v, i, x, y: F.when(x == self.w - 1, 0).otherwise(F.get(a, i + 1) - v))

    def step_v(self, a: Column) -> Column:
        """Difference to the neighbour below, 0 in the last row."""
        return self._map(a, lambda v, i, x, y: F.when(y == self.h - 1, 0).otherwise(F.get(a, i + self.w) - v))

    def gradients(self, t: Column, most: int = 1) -> tuple[Column, Column]:
        c = lambda a: F.transform(a, lambda v: clamp(v, most))
        return c(self.step_h(t)), c(self.step_v(t))

    def edge_mask(self, px: Column, least: int = 30) -> Column:
        mag = F.zip_with(self.step_h(px), self.step_v(px), lambda a, b: F.abs(a) + F.abs(b))
        return F.zip_with(ternary(px), mag, lambda t, m: F.when(m < least, 0).otherwise(t))

    def gradient_direction(self, px: Column, least: int = 20) -> Column:
        def one(gx: Column, gy: Column) -> Column:
            ax, ay = F.abs(gx), F.abs(gy)
            up = lambda c: F.when(c, 1).otherwise(-1)
            return F.when(ax + ay < least, 0).when(ax > ay * 2, up(gx > 0)).when(ay > ax * 2, up(gy > 0)).otherwise(up((gx > 0) == (gy > 0)))

        return F.zip_with(self.step_h(px), self.step_v(px), one)

    def gradient_magnitude(self, px: Column) -> Column:
        mag = F.zip_with(self.step_h(px), self.step_v(px), lambda a, b: F.least(F.lit(255), F.abs(a) + F.abs(b)))
        return let(mag, ternary_percentile)

    def local_contrast(self, px: Column, reach: int = 2, least: int = 15) -> Column:
        """Against the integer mean of the surrounding square, cut at the borders."""
        offsets = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]

        def one(v: Column, i: Column, x: Column, y: Column) -> Column:
            near = F.filter(
                F.array(*(F.when((x + dx >= 0) & (x + dx < self.w) & (y + dy >= 0) & (y + dy < self.h), F.get(px, i + dy * self.w + dx)) for dy, dx in offsets)), lambda p: p.isNotNull()
            )
            return v - let(near, lambda a: div(total(a), F.size(a)))

        return F.transform(self._map(px, one), lambda r: F.when(r > least, 1).when(r < -least, -1).otherwise(0))

    # Codes

    def block_codes(self, t: Column, base: int = 3, length: int = 3) -> Column:
        """Codes of strips of `length` symbols, `length` apart, row by row; symbols lie around zero."""
        per_row, half = self.w // length, base // 2

        def code(k: Column) -> Column:
            at = div(k, F.lit(per_row)).cast("int") * self.w + (k % per_row) * length
            out = F.lit(0)
            for j in range(length):
                out = out * base + F.get(t, at + j) + half
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(self.h * per_row - 1)), code)

    def transitions(self, codes: Column) -> tuple[Column, Column]:
        """Codes of the changes to the next strip in the row, and to the strip below."""
        s = self.strips
        right = F.transform(F.sequence(F.lit(0), F.lit(self.h * (s - 1) - 1)), lambda k: transition(*(F.get(codes, div(k, F.lit(s - 1)).cast("int") * s + k % (s - 1) + j) for j in (0, 1))))
        below = F.transform(F.sequence(F.lit(0), F.lit((self.h - 1) * s - 1)), lambda k: transition(F.get(codes, k), F.get(codes, k + s)))
        return right, below

    def joint_codes(self, px: Column, hg: Column, vg: Column, kind: str = "d") -> Column:
        """One byte per strip from the codes of three channels and, for kinds b and d, two bits for a change from left and above."""
        s = self.strips
        right, below = self.transitions(px) if s > 1 else (F.array().cast("array<int>"), self.transitions(px)[1])

        def one(p: Column, k: Column, right: Column, below: Column) -> Column:
            a, b = F.get(hg, k), F.get(vg, k)
            if kind == "c":
                first = lambda c: div(c, F.lit(9)).cast("int")
                return ((first(p) * 9 + first(a) * 3 + first(b)).bitwiseOR(F.shiftleft(p.bitwiseAND(F.lit(7)), 5))).bitwiseAND(F.lit(255))
            col, row = k % s, div(k, F.lit(s)).cast("int")
            left = F.when(col > 0, F.get(right, row * (s - 1) + col - 1)).otherwise(ZERO_CODE)
            above = F.when(row > 0, F.get(below, (row - 1) * s + col)).otherwise(ZERO_CODE)
            bits = [(level(c, kind), 2 * j) for j, c in enumerate((p, a, b))] + [(F.when(c != ZERO_CODE, 1).otherwise(0), 6 + j) for j, c in enumerate((left, above))]
            out = F.lit(0)
            for v, shift in bits:
                out = out.bitwiseOR(F.shiftleft(v, shift))
            return out

        return let(F.struct(right.alias("right"), below.alias("below")), lambda m: F.transform(px, lambda p, k: one(p, k, m["right"], m["below"])))

    # Features

    def divergence(self, hg: Column, vg: Column) -> Column:
        """Backward differences of the two gradients, summed; 0 outside."""
        return self._map(hg, lambda v, i, x, y: v - F.when(x > 0, F.get(hg, i - 1)).otherwise(0) + F.get(vg, i) - F.when(y > 0, F.get(vg, i - self.w)).otherwise(0))

    def curl(self, hg: Column, vg: Column) -> Column:
        """Forward differences; the neighbour outside counts 0."""
        return self._map(vg, lambda v, i, x, y: F.when(x < self.w - 1, F.get(vg, i + 1)).otherwise(0) - v - (F.when(y < self.h - 1, F.get(hg, i + self.w)).otherwise(0) - F.get(hg, i)))

    def negative_part(self, d: Column) -> tuple[Column, Column]:
        """(sum of the negative cells, at least -32767; their mean row, or -1 without any)."""
        rows = F.filter(self._map(d, lambda v, i, x, y: F.when(v < 0, y)), lambda y: y.isNotNull())
        low = total(F.filter(d, lambda v: v < 0))
        return F.greatest(F.lit(-32767), low).cast("int"), F.when(F.size(rows) > 0, div(total(rows), F.size(rows))).otherwise(-1).cast("int")

    def region_sums(self, d: Column, rows: int, cols: int) -> Column:
        """Sums of the negative cells in each region of a rows x cols grid (integer scaling, so regions may differ)."""
        region = self._map(d, lambda v, i, x, y: F.struct(v.alias("v"), (div(y * rows, F.lit(self.h)) * cols + div(x * cols, F.lit(self.w))).cast("int").alias("r")))
        return let(region, lambda a: F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda k: total(F.transform(F.filter(a, lambda c: (c["r"] == k) & (c["v"] < 0)), lambda c: c["v"])).cast("int")))

    def profile(self, t: Column) -> Column:
        """Positive cells in each row."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.h - 1)), lambda y: F.size(F.filter(F.slice(t, y * self.w + 1, F.lit(self.w)), lambda v: v > 0)))

    def euler(self, t: Column) -> Column:
        """(single corners - triple corners + 2 diagonal pairs) div 4 over all 2x2 squares."""

        def square(v: Column, i: Column, x: Column, y: Column) -> Column:
            a, b, c, d = (F.when(F.get(t, i + o) > 0, 1).otherwise(0) for o in (0, 1, self.w, self.w + 1))
            s = a + b + c + d
            value = F.when(s == 1, 1).when(s == 3, -1).when((s == 2) & (a == d), 2).otherwise(0)
            return F.when((x < self.w - 1) & (y < self.h - 1), value).otherwise(0)

        return clamp(div(total(self._map(t, square)), F.lit(4)), 127)

    def chirality(self, t: Column) -> Column:
        """Left minus right positive cells for each pair of rows."""
        side = self._map(t, lambda v, i, x, y: F.when(v > 0, F.when(x < self.w // 2, 1).otherwise(-1)).otherwise(0))
        return let(side, lambda a: F.transform(F.sequence(F.lit(0), F.lit(self.h // 2 - 1)), lambda p: total(F.slice(a, p * 2 * self.w + 1, F.lit(2 * self.w))).cast("int")))

    def symmetry(self, px: Column) -> Column:
        """Sum of |left - mirrored right|."""
        mirror = self._map(px, lambda v, i, x, y: F.when(x < self.w // 2, F.abs(v - F.get(px, y * self.w + (self.w - 1) - x))).otherwise(0))
        return total(mirror)

    def contrast(self, px: Column, least: int = 30) -> Column:
        """Neighbours that differ by more than `least`: to the right, below, and diagonally."""

        def count(o: int, dx: int, dy: int) -> Column:
            far = self._map(px, lambda v, i, x, y: F.when((x < self.w - dx) & (y < self.h - dy) & (F.abs(v - F.get(px, i + o)) > least), 1).otherwise(0))
            return total(far).cast("int")

        return F.array(count(1, 1, 0), count(self.w, 0, 1), count(self.w + 1, 1, 1))

    def local_pattern(self, px: Column, cells: int = 4) -> Column:
        """Bins (cell * 4 + kind) of the inner pixels' eight-neighbour patterns: uniform, few, many or middling bits."""
        ring = (-self.w - 1, -self.w, -self.w + 1, 1, self.w + 1, self.w, self.w - 1, -1)

        def one(v: Column, i: Column, x: Column, y: Column) -> Column:
            n = F.lit(0)
            for o in ring:
                n = n + F.when(F.get(px, i + o) >= v, 1).otherwise(0)
            kind = F.when((n == 0) | (n == 8), 0).when(n <= 2, 1).when(n >= 6, 2).otherwise(3)
            cell = (div(y * cells, F.lit(self.h)) * cells + div(x * cells, F.lit(self.w))).cast("int")
            return F.when((x > 0) & (x < self.w - 1) & (y > 0) & (y < self.h - 1), cell * 4 + kind)

        return F.filter(self._map(px, one), lambda b: b.isNotNull())

    def cell_energy(self, px: Column, cells: int = 4) -> Column:
        """(cell * 2 + direction, sum of |differences|) as an array of structs for each pixel and direction."""

        def one(a: Column, direction: int) -> Column:
            return self._map(a, lambda v, i, x, y: F.struct(((div(y * cells, F.lit(self.h)) * cells + div(x * cells, F.lit(self.w))) * 2 + direction).cast("int").alias("bin"), F.abs(v).alias("v")))

        return F.concat(one(self.step_h(px), 0), one(self.step_v(px), 1))

    def orientation(self, hg: Column, vg: Column, cells: int = 4) -> Column:
        """Bins (cell * 4 + kind) of cells with a gradient: horizontal, vertical, same sign, opposite sign."""

        def one(a: Column, i: Column, x: Column, y: Column) -> Column:
            b = F.get(vg, i)
            kind = F.when((a != 0) & (b == 0), 0).when((a == 0) & (b != 0), 1).when((a == b) & (a != 0), 2).when(a != 0, 3)
            return (div(y * cells, F.lit(self.h)) * cells + div(x * cells, F.lit(self.w))).cast("int") * 4 + kind

        return F.filter(self._map(hg, one), lambda k: k.isNotNull())

    def gradient_map(self, hg: Column, vg: Column) -> Column:
        """Bins (h+1)*15 + (v+1)*5 + (divergence within +-2, + 2) of all cells."""
        return let(self.divergence(hg, vg), lambda d: F.transform(hg, lambda a, i: (a + 1) * 15 + (F.get(vg, i) + 1) * 5 + clamp(F.get(d, i), 2) + 2))

    def state_steps(self, hg: Column, vg: Column) -> Column:
        """Bins state * 8 + next state, to the right and below; a state is the kind of gradient of a cell."""
        state = F.zip_with(
            hg, vg, lambda a, b: F.when((a == 0) & (b == 0), 0).when(b == 0, F.when(a > 0, 1).otherwise(2)).when(a == 0, F.when(b > 0, 3).otherwise(4)).when(a == b, 5).otherwise(6)
        )

        def steps(a: Column) -> Column:
            right = self._map(a, lambda v, i, x, y: F.when(x < self.w - 1, v * 8 + F.get(a, i + 1)))
            below = self._map(a, lambda v, i, x, y: F.when(y < self.h - 1, v * 8 + F.get(a, i + self.w)))
            return F.filter(F.concat(right, below), lambda b: b.isNotNull())

        return let(state, steps)

    # Resampling

    def translate(self, px: Column, dx: int, dy: int) -> Column:
        """Moved right by dx and down by dy; cells that come from outside are 0."""
        return self._map(px, lambda v, i, x, y: F.when((x - dx >= 0) & (x - dx < self.w) & (y - dy >= 0) & (y - dy < self.h), F.get(px, i - dy * self.w - dx)).otherwise(0))

    def upsample(self, px: Column, k: int) -> Column:
        """Each cell k x k times."""
        w = self.w * k
        return F.transform(F.sequence(F.lit(0), F.lit(self.n * k * k - 1)), lambda i: F.get(px, (div(i, F.lit(w * k)) * self.w + div(i % w, F.lit(k))).cast("int")))

    def pool(self, px: Column, k: int, rounded: bool = False) -> Column:
        """Means of k x k squares, truncated, or rounded half up."""
        w = self.w // k
        offsets = [dy * self.w + dx for dy in range(k) for dx in range(k)]

        def one(i: Column) -> Column:
            at = (div(i, F.lit(w)) * k * self.w + (i % w) * k).cast("int")
            s = F.lit(k * k // 2 if rounded else 0)
            for o in offsets:
                s = s + F.get(px, at + o)
            return div(s, F.lit(k * k)).cast("int")

        return F.transform(F.sequence(F.lit(0), F.lit(w * (self.h // k) - 1)), one)


def transition(a: Column, b: Column) -> Column:
    """Code of the trit-wise clamped difference of two block codes."""
    out = F.lit(0)
    for w in (9, 3, 1):
        digit = lambda c, w=w: (div(c, F.lit(w)) % 3).cast("int")
        out = out * 3 + clamp(digit(b) - digit(a), 1) + 1
    return out


def level(code: Column, kind: str = "d") -> Column:
    """Two bits from the sum of a block's trits: d below, at, above zero or full; b below, at or above zero."""
    s = sum(((div(code, F.lit(w)) % 3).cast("int") for w in (9, 3, 1)), F.lit(-3))
    return F.when(s < 0, 0).when(s == 0, 1).when(s < 3, 2).otherwise(3 if kind == "d" else 2)
