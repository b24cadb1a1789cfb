"""Frequency cubes over few knots, rescue of queries with few candidates, propagation of labels, ternary components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tritlake.functions import arrays as A
from tritlake.functions import fields
from tritlake.functions import grid as G
from tritlake.functions.grid import Grid
from tritlake.functions.lineage import kept

from . import encode, retrieve, train


def gradient_histograms(images: DataFrame, grid: Grid, channels: dict[str, Column], rows: int = 1, cols: int = 1) -> DataFrame:
    """(id, channel, region, bin, n): raw gradient maps of each channel in each region."""
    maps = F.array(*(F.struct(F.lit(c).alias("channel"), F.arrays_zip(fields.region_numbers(grid, px, rows, cols).alias("region"), fields.raw_gradient_map(grid, px).alias("bin")).alias("cells")) for c, px in channels.items()))
    d = images.select("id", F.explode(maps).alias("c")).select("id", "c.channel", F.explode("c.cells").alias("x"))
    return d.groupBy("id", "channel", F.col("x.region").alias("region"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"))


# Knots: a fixed number of positions stands for all. Positions are numbered row by row, `across` in a row.


def uniform_knots(positions: int, knots: int) -> list[int]:
    return [positions // knots * k for k in range(knots)]


def variance_knots(sigs: DataFrame, knots: int) -> list[int]:
    """The positions of one channel whose codes vary most among the training rows; of equals the first."""
    v = F.col("val").cast("long")
    d = sigs.filter("not is_query").groupBy("pos").agg((F.count("*") * F.sum(v * v) - F.sum(v) * F.sum(v)).alias("spread"))
    return [r["pos"] for r in d.orderBy(F.desc("spread"), "pos").limit(knots).collect()]


def nearest_knots(sigs: DataFrame, knots: list[int], positions: int, across: int) -> DataFrame:
    """(pos, knot): the nearest knot of each position; of equally near ones the first listed. Its size is that of the code."""
    far = lambda a, b: (a // across - b // across) ** 2 + (a % across - b % across) ** 2
    rows = [(p, min(range(len(knots)), key=lambda k: (far(p, knots[k]), k))) for p in range(positions)]
    return sigs.sparkSession.createDataFrame(rows, "pos int, knot int")


def at_knots(sigs: DataFrame, nearest: DataFrame) -> DataFrame:
    """Signatures whose positions are the numbers of their knots: training and scoring then work as without knots."""
    return sigs.join(F.broadcast(nearest), "pos").withColumn("pos", F.col("knot")).drop("knot")


def interpolated_map(sigs: DataFrame, across: int, down: int, step: int = 4) -> DataFrame:
    """(channel, pos, val, label, cnt): counted at every `step`th position each way, in between from the four knots around, rounded."""
    rows = []
    for y in range(down):
        for x in range(across):
            x0, y0 = x // step * step, y // step * step
            x1, y1 = x0 + step if x0 + step < across else x0, y0 + step if y0 + step < down else y0
            dx, dy = (x - x0) / step, (y - y0) / step
            for ky, wy in ((y0, 1 - dy), (y1, dy)):
                rows += [(y * across + x, ky * across + kx, wx * wy) for kx, wx in ((x0, 1 - dx), (x1, dx)) if wx * wy]
    spread = sigs.sparkSession.createDataFrame(rows, "at int, pos int, share double")
    hot = train.hot_map(sigs).join(F.broadcast(spread), "pos")
    d = hot.groupBy("channel", F.col("at").alias("pos"), "val", "label").agg(F.floor(F.sum(F.col("cnt") * F.col("share")) + 0.5).alias("cnt"))
    return d.filter("cnt > 0")


# Rescue


def rescue_probes(images: DataFrame, grid: Grid, counts: DataFrame, ig: DataFrame, bg: DataFrame, few: int, channels: tuple[str, ...] = ("px",)) -> DataFrame:
    """(qid, channel, pos, val, w): further probes of queries with fewer than `few` candidates by counts (qid, n), moved by one
    pixel each way, at half weight."""
    q = images.filter("is_query")
    poor = q.join(counts, q["id"] == counts["qid"], "left").filter(F.coalesce("n", F.lit(0)) < few)
    moves = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    moved = poor.select("id", "label", "is_query", F.explode(F.array(*(grid.translate(F.col("px"), dx, dy) for dx, dy in moves))).alias("px"))
    s = encode.block_signatures(moved, grid).filter(F.col("channel").isin(*channels))
    p = s.join(F.broadcast(ig), ["channel", "pos"]).join(F.broadcast(bg), "channel").filter("val <> bg and w > 1")
    return p.select(F.col("id").alias("qid"), "channel", "pos", "val", F.floor(F.col("w") / 2).cast("long").alias("w"))


# Propagation


def propagate(planes: DataFrame, preds: DataFrame, sure: int, k: int = 7, anchors: int | None = 500, agree: int = 6, waves: int = 1) -> DataFrame:
    """(qid, pred, wave): rows with `agree` of at least `sure` keep their class and are anchors; the others vote among their k nearest.

    planes: (id, t); preds: (qid, pred, agree). A wave looks at the `anchors` anchors whose digests of the id are least, as
    the survey's form looks at some 500; with None at all of them, block by block; nearness is the dot product, ties go to the smaller id, ties of votes to the lower class. Rows
    that win `agree` votes are anchors of the next wave; a row keeps the class of its last vote. Without anchors nothing changes.
    """
    t = planes.select(F.col("id").alias("qid"), "t")
    state = preds.withColumn("wave", F.when(F.col("agree") >= sure, 0)).select("qid", "pred", "wave")
    for wave in range(1, waves + 1):
        state = kept(state.join(t, "qid"))
        some = state.filter("wave is not null")
        if anchors is not None:
            some = some.orderBy(F.md5(F.col("qid").cast("string")), "qid").limit(anchors)
        near = retrieve.brute(state.filter("wave is null").select("qid", F.col("t").alias("qa")), some.select(F.col("qid").alias("tid"), F.col("pred").alias("tlabel"), F.col("t").alias("ta")), "dot", k)
        n = near.groupBy("qid", F.col("tlabel").alias("cls")).agg(F.count("*").alias("n"))
        won = n.groupBy("qid").agg(F.max_by("cls", F.struct("n", -F.col("cls"))).alias("new"), F.max("n").alias("n"))
        state = state.drop("t").join(won, "qid", "left").select("qid", F.coalesce("new", "pred").alias("pred"), F.coalesce("wave", F.when(F.col("n") >= agree, wave)).alias("wave"))
    return state.select("qid", "pred", F.coalesce("wave", F.lit(waves + 1)).alias("wave"))


# Components


def principal_components(images: DataFrame, size: int, count: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(means, components) of the training images' ternary planes: power iteration with deflation on the sums of products.

    The sums, size x size integers, are made in each task and added by row; only they reach the driver. The sign of a
    component is such that its largest entry is positive.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((size + 1, size), np.int64)
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.int64).reshape(-1, size)
            acc += np.vstack([x.T @ x, x.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(acc.tolist(), pa.list_(pa.int64()))], names=["i", "v"])

    t = images.filter("not is_query").select("t")
    rows = t.mapInArrow(sums, "i int, v array<long>").groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(size))).collect()
    acc = np.array([r[1:] for r in sorted(rows, key=lambda r: r["i"])], np.float64).reshape(-1, size) if rows else np.zeros((size + 1, size))
    n = max(1, t.count())
    mean = acc[size] / n
    cov, out = acc[:size] / n - np.outer(mean, mean), []
    for k in range(count):
        v = np.ones(size) + np.arange(size) * (k + 1) / size
        for _ in range(rounds):
            nxt = cov @ v
            length = np.linalg.norm(nxt)
            if length < 1e-12:
                break
            v = nxt / length
        v = v / np.linalg.norm(v)
        v = v if v[np.argmax(np.abs(v))] > 0 else -v
        cov = cov - (v @ cov @ v) * np.outer(v, v)
        out.append(v)
    return mean, np.array(out).reshape(-1, size)


def ternary_components(images: DataFrame, grid: Grid, count: int, cut: float = 0.5) -> DataFrame:
    """The images with `pc`: the signs of their projections on ternary components, 0 within a third of the components' size.

    A component's entry counts if its size is at least `cut` times the root of the mean square.
    """
    _, comps = principal_components(images, grid.n, count)
    signs = [np.where(np.abs(c) >= cut / np.sqrt(grid.n), np.sign(c), 0).astype(int).tolist() for c in comps]
    sums = [(A.dot(F.col("t"), F.array(*(F.lit(v) for v in s))), sum(map(abs, s)) // 3) for s in signs]
    return images.withColumn("pc", F.array(*(F.when(d > z, 1).when(d < -z, -1).otherwise(0) for d, z in sums)))


def field_signatures(images: DataFrame, grid: Grid, least: int = 1) -> DataFrame:
    """Block codes of the quantized signed distance field: channel `sdf`."""
    d = images.withColumn("t", G.ternary(F.col("px")))
    d = d.withColumn("f", fields.beyond(fields.signed_distance(grid, F.col("t")), least))
    return encode.exploded(d, {"sdf": grid.block_codes(F.col("f"))})
