"""Structural features of images: native expressions, and Arrow functions where a region or a path must be walked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tritlake.functions.arrays import let
from tritlake.functions.grid import Grid

from .encode import planes


def enclosed_centroid(grid: Grid):
    """A function array<int> -> int: mean row of the cells without foreground that no path from outside reaches; -1 if none."""

    @F.pandas_udf("int")
    def run(t: pd.Series) -> pd.Series:
        if not len(t):
            return pd.Series([], dtype="int32")
        free = np.pad(np.stack(t.to_numpy()).reshape(-1, grid.h, grid.w) <= 0, ((0, 0), (1, 1), (1, 1)), constant_values=True)
        seen = np.zeros_like(free)
        seen[:, 0], seen[:, -1], seen[:, :, 0], seen[:, :, -1] = True, True, True, True
        while True:  # all images of the batch spread one step at a time
            wide = seen.copy()
            wide[:, 1:] |= seen[:, :-1]
            wide[:, :-1] |= seen[:, 1:]
            wide[:, :, 1:] |= seen[:, :, :-1]
            wide[:, :, :-1] |= seen[:, :, 1:]
            wide &= free
            if (wide == seen).all():
                break
            seen = wide
        closed = (free & ~seen)[:, 1:-1, 1:-1]
        n = closed.sum(axis=(1, 2))
        rows = (closed * np.arange(grid.h)[None, :, None]).sum(axis=(1, 2))
        return pd.Series(np.where(n > 0, rows // np.maximum(n, 1), -1).astype("int32"))

    return run


def flow_trace(grid: Grid):
    """A function (hg, vg) -> struct: paths at right angles to the gradient from each unvisited inner cell, at most 100 steps.

    A path ends at a visited cell, a cell without gradient or the border; it counts from three steps on. `turns` are changes
    of direction, `closures` returns to the start, `vortices` cells whose curl is 2 or more.
    """

    @F.pandas_udf("total_len int, paths int, closures int, turns int, vortices int")
    def run(hg: pd.Series, vg: pd.Series) -> pd.DataFrame:
        out = []
        for h, v in zip(hg, vg, strict=True):
            visited, lengths, paths, closures, turns = set(), 0, 0, 0, 0
            for start in (y * grid.w + x for y in range(1, grid.h - 1) for x in range(1, grid.w - 1)):
                if start in visited or not (h[start] or v[start]):
                    continue
                x, y, steps, before = start % grid.w, start // grid.w, 0, (0, 0)
                while steps < 100:
                    at = y * grid.w + x
                    if at in visited and steps:
                        closures += at == start
                        break
                    visited.add(at)
                    way = (-v[at], h[at])
                    if way == (0, 0):
                        break
                    turns += bool(steps) and way != before
                    before = way
                    x, y = x + way[0], y + way[1]
                    if not (0 <= x < grid.w and 0 <= y < grid.h):
                        break
                    steps += 1
                if steps > 2:
                    lengths, paths = lengths + steps, paths + 1
            hh, vv = (np.asarray(a).reshape(grid.h, grid.w).astype(int) for a in (h, v))
            curl = (vv[:-1, 1:] - vv[:-1, :-1]) - (hh[1:, :-1] - hh[:-1, :-1])
            out.append((lengths, paths, closures, turns, int((np.abs(curl) >= 2).sum())))
        return pd.DataFrame(out, columns=["total_len", "paths", "closures", "turns", "vortices"]).astype("int32")

    return run


def stream_function(grid: Grid, rounds: int = 50):
    """A function (hg, vg) -> array<int>: Jacobi rounds for the stream function of the curl, as a histogram of nine bins."""

    @F.pandas_udf("array<int>")
    def run(hg: pd.Series, vg: pd.Series) -> pd.Series:
        out = []
        for h, v in zip(hg, vg, strict=True):
            hh, vv = (np.pad(np.asarray(a, float).reshape(grid.h, grid.w), ((0, 1), (0, 1))) for a in (h, v))
            curl = (vv[:-1, 1:] - vv[:-1, :-1]) - (hh[1:, :-1] - hh[:-1, :-1])
            s = np.zeros((grid.h + 2, grid.w + 2))
            for _ in range(rounds):
                s[1:-1, 1:-1] = (s[:-2, 1:-1] + s[2:, 1:-1] + s[1:-1, :-2] + s[1:-1, 2:] + curl) / 4
            bins = np.clip(np.floor(s[1:-1, 1:-1] + 0.5).astype(int), -4, 4) + 4
            out.append(np.bincount(bins.reshape(-1), minlength=9).astype("int32"))
        return pd.Series(out)

    return run


def described(images: DataFrame, grid: Grid, rows: int = 2, cols: int = 4) -> DataFrame:
    """Adds what ranking needs: t, hg, vg, prof, ns, cy, gdiv, cent."""
    d = planes(images, grid)
    d = d.withColumn("d", grid.divergence(F.col("hg"), F.col("vg")))
    ns, cy = grid.negative_part(F.col("d"))
    return d.withColumns({"prof": grid.profile(F.col("t")), "ns": ns, "cy": cy, "gdiv": grid.region_sums(F.col("d"), rows, cols), "cent": enclosed_centroid(grid)(F.col("t"))}).drop("d")


def histogram(d: DataFrame, bins: Column, keys: tuple[str, ...] = ("id",), size: int = 0) -> DataFrame:
    """(keys, bin, n) of an array of bin numbers; with `size` all bins from 0 to size - 1, also empty ones.

    Bins are counted within each row's array, so nothing is shuffled.
    """
    def counted(a: Column) -> Column:
        which = F.sequence(F.lit(0), F.lit(size - 1)) if size else F.array_sort(F.array_distinct(a))
        return F.transform(which, lambda k: F.struct(k.alias("bin"), F.size(F.filter(a, lambda b: b == k)).cast("long").alias("n")))

    return d.select(*keys, F.explode(let(bins, counted)).alias("c")).select(*keys, "c.bin", "c.n")
