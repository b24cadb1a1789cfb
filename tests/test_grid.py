"""Column functions against plain Python on hand-made and random images."""

import random

import pytest
from pyspark.sql import functions as F

from tritlake.functions import arrays as A
from tritlake.functions import grid as G
from tritlake.functions.grid import Grid
from tritlake.operators import encode, features

SMALL = Grid(7, 6)


def one(spark, px, expr):
    return spark.createDataFrame([(list(px),)], "px array<int>").select(expr(F.col("px")).alias("r")).first().r


def test_thresholds_are_strict(spark):
    assert one(spark, [84, 85, 170, 171], G.ternary) == [-1, 0, 0, 1]


def test_percentiles_of_a_flat_image_part_by_one(spark):
    lo, hi = (one(spark, [9] * 9, lambda p, k=k: G.percentile_bounds(p)[k]) for k in (0, 1))
    assert (lo, hi) == (8, 10)
    assert one(spark, [0] * 9, G.ternary_percentile) == [0] * 9


def test_nonzero_percentile_falls_back_and_skips_an_open_bound(spark):
    def plain(px, low=33, high=67):
        some = sorted(p for p in px if p)
        lo, hi, cum = 85, 170, 0
        if len(some) > 10:
            for v in range(1, 256):
                cum = sum(p <= v for p in some)
                if cum >= len(some) * low // 100 and lo == 85:
                    lo = v
                if cum >= len(some) * high // 100 and hi == 170:
                    hi = v
                    break
            if lo >= hi:
                lo, hi = 85, 170
        return [1 if p > hi else -1 if p < lo else 0 for p in px]

    rng = random.Random(3)
    rows = [[rng.choice([0, 1, 84, 85, 86, 169, 170, 171, 255, rng.randrange(256)]) for _ in range(rng.choice([5, 12, 40]))] for _ in range(60)]
    rows += [[85] * 20 + [90] * 20, [0] * 30, [170] * 30]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, px array<int>").select("i", G.ternary_nonzero_percentile(F.col("px")).alias("t")).collect()
    for r in got:
        assert r.t == plain(rows[r.i]), rows[r.i]


def test_integer_quotient_truncates_towards_zero(spark):
    d = spark.createDataFrame([(-7, 2), (7, 2), (-7, -2), (7, -2), (0, 3)], "a int, b int").select(A.div(F.col("a"), F.col("b")).alias("q"))
    assert [r.q for r in d.collect()] == [-3, 3, 3, -3, 0]


def test_block_codes_leave_the_last_column_out_and_invert(spark):
    t = [random.Random(1).choice([-1, 0, 1]) for _ in range(SMALL.n)]
    codes = one(spark, t, SMALL.block_codes)
    assert len(codes) == 6 * 2
    for k, c in enumerate(codes):
        at = k // 2 * 7 + k % 2 * 3
        assert [c // 9 - 1, c // 3 % 3 - 1, c % 3 - 1] == t[at : at + 3]


@pytest.mark.parametrize("kind,sizes", [("adjacent", {3, 4, 5, 6}), ("hamming1", {6})])
def test_neighbours_differ_in_one_trit(spark, kind, sizes):
    pairs = [(r.val, r.nval) for r in encode.neighbours(spark, kind).collect()]
    digits = lambda c: (c // 9, c // 3 % 3, c % 3)
    by = {}
    for a, b in pairs:
        diff = [abs(x - y) for x, y in zip(digits(a), digits(b), strict=True)]
        assert sum(d > 0 for d in diff) == 1 and (kind == "hamming1" or max(diff) == 1)
        by.setdefault(a, set()).add(b)
    assert {len(v) for v in by.values()} == sizes and len(by) == 27


def flood(t, w, h):
    free = {(y, x) for y in range(-1, h + 1) for x in range(-1, w + 1) if not (0 <= y < h and 0 <= x < w and t[y * w + x] > 0)}
    todo, seen = [(-1, -1)], {(-1, -1)}
    while todo:
        y, x = todo.pop()
        for p in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if p in free and p not in seen:
                seen.add(p)
                todo.append(p)
    rows = [y for y, x in free - seen]
    return sum(rows) // len(rows) if rows else -1


def test_enclosed_centroid_against_a_flood_fill(spark):
    rng = random.Random(5)
    rows = [[rng.choice([-1, 0, 1, 1]) for _ in range(SMALL.n)] for _ in range(80)]
    ring = [1 if x in (1, 5) and 1 <= y <= 4 or y in (1, 4) and 1 <= x <= 5 else -1 for y in range(6) for x in range(7)]
    rows += [ring, [1] * SMALL.n, [0] * SMALL.n]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<int>").select("i", features.enclosed_centroid(SMALL)(F.col("t")).alias("c"))
    for r in d.collect():
        assert r.c == flood(rows[r.i], 7, 6)


def test_walsh_hadamard_keeps_dot_products(spark):
    rng = random.Random(2)
    a, b = ([rng.choice([-1, 0, 1]) for _ in range(64)] for _ in range(2))
    w = encode.walsh_hadamard(spark.createDataFrame([(0, a), (1, b)], "id int, t array<int>"), 8).collect()
    x, y = ({r.u: r.coef for r in w if r.id == k} for k in (0, 1))
    assert sum(x[u] * y[u] for u in x) == 64 * sum(p * q for p, q in zip(a, b, strict=True))
