"""Signed distance fields, gradient maps of raw pixels and cascaded matches of codes: expressions over the arrays of a row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import div, let, total
from .grid import Grid

#: Distance where an image has no edge at all.
FAR = 999


def _edge(g: Grid, t: Column, alone: Callable[[Column], Column], differs: Callable[[Column, Column], Column]) -> Column:
    """1 for cells that are an edge by themselves or that differ from one of the four cells around them, else 0."""

    def one(v: Column, i: Column, x: Column, y: Column) -> Column:
        near = [(x > 0, -1), (x < g.w - 1, 1), (y > 0, -g.w), (y < g.h - 1, g.w)]
        return F.when(reduce(lambda a, b: a | b, (inside & differs(v, F.get(t, i + step)) for inside, step in near), alone(v)), 1).otherwise(0)

    return g._map(t, one)


def city_block(g: Grid, edge: Column) -> Column:
    """Distance of each cell to the nearest cell that holds 1: along rows, then along columns, so n * (w + h) steps an image."""
    across, up = F.sequence(F.lit(0), F.lit(g.w - 1)), F.sequence(F.lit(0), F.lit(g.h - 1))
    along = lambda e: g._map(e, lambda v, i, x, y: F.array_min(F.transform(across, lambda k: F.when(F.get(e, i - x + k) == 1, F.abs(k - x)).otherwise(FAR))))
    down = lambda r: g._map(r, lambda v, i, x, y: F.array_min(F.transform(up, lambda k: F.get(r, k * g.w + x) + F.abs(k - y))))
    return let(let(edge, along), down)


def _signed(t: Column, distance: Column, side: Callable[[Column], Column]) -> Column:
    return F.zip_with(t, distance, lambda v, d: F.greatest(F.lit(-128), F.least(F.lit(127), side(v) * d)).cast("int"))


def signed_distance(g: Grid, t: Column) -> Column:
    """Of a ternary plane: distance to the nearest zero or change of sign, negative inside the foreground."""
    edge = _edge(g, t, lambda v: v == 0, lambda v, u: v != u)
    return _signed(t, city_block(g, edge), lambda v: F.when(v > 0, -1).when(v < 0, 1).otherwise(0))


def edge_distance(g: Grid, t: Column) -> Column:
    """Of a plane of edges: distance to where zero meets non-zero, negative on the non-zero side."""
    edge = _edge(g, t, lambda v: F.lit(False), lambda v, u: (v != 0) != (u != 0))
    return _signed(t, city_block(g, edge), lambda v: F.when(v != 0, -1).otherwise(1))


def beyond(d: Column, least: int) -> Column:
    """1 above `least`, -1 below its negative, else 0."""
    return F.transform(d, lambda v: F.when(v > least, 1).when(v < -least, -1).otherwise(0))


def raw_gradient_map(g: Grid, px: Column, turn: int = 10, strengths: tuple[int, ...] = (5, 20, 50, 100)) -> Column:
    """Bins 15 * way across + 5 * way down + strength of all cells, from the differences of raw pixels."""
    way = lambda s: F.when(s > turn, 2).when(s < -turn, 0).otherwise(1)

    def one(a: Column, b: Column) -> Column:
        size = F.abs(a) + F.abs(b)
        return way(a) * 15 + way(b) * 5 + sum((F.when(size >= s, 1).otherwise(0) for s in strengths), F.lit(0))

    return F.zip_with(g.step_h(px), g.step_v(px), one)


def region_numbers(g: Grid, a: Column, rows: int, cols: int) -> Column:
    """The region of each cell in a rows x cols grid."""
    return g._map(a, lambda v, i, x, y: (div(y * rows, F.lit(g.h)) * cols + div(x * cols, F.lit(g.w))).cast("int"))


def cascade_score(a: Column, b: Column, n: int, weights: tuple[int, ...]) -> Column:
    """Equal codes of two arrays of n, plus triples that are equal as a whole, triples of those, and so on; a weight for each level."""

    def level(m: Column, n: int, left: tuple[int, ...]) -> Column:
        own = total(m) * left[0]
        if n < 3 or len(left) == 1:
            return own
        up = F.transform(F.sequence(F.lit(0), F.lit(n // 3 - 1)), lambda k: F.least(*(F.get(m, k * 3 + j) for j in range(3))))
        return own + let(up, lambda u: level(u, n // 3, left[1:]))

    return let(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), lambda m: level(m, n, weights))
