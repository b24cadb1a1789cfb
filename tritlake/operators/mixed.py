"""Orders, series, experts, tiles, levels and mixtures over the cube, the index and the candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tritlake.functions import arrays as A
from tritlake.functions import shape as S
from tritlake.functions.lineage import kept

from . import train
from .vote import CLASSES, argmax, argmax_array


def cells(sigs: DataFrame, hot: DataFrame, bg: DataFrame | None) -> DataFrame:
    """(qid, label, channel, pos, val, a): each query's values without the background, with the cube's counts of all classes."""
    q = sigs.filter("is_query").select(F.col("id").alias("qid"), "label", "channel", "pos", "val")
    if bg is not None:
        q = q.join(F.broadcast(bg), "channel").filter("val <> bg").drop("bg")
    return q.join(class_arrays(hot), ["channel", "pos", "val"], "left").withColumn("a", F.coalesce("a", F.array_repeat(F.lit(0).cast("long"), CLASSES)))


def class_arrays(hot: DataFrame) -> DataFrame:
    cube = hot.groupBy("channel", "pos", "val").agg(F.map_from_entries(F.collect_list(F.struct("label", "cnt"))).alias("m"))
    return cube.select("channel", "pos", "val", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("a"))


def summed(d: DataFrame, value=lambda c: c, digits: int | None = None) -> DataFrame:
    """(qid, label, s array): sums of value(a[k]) of each class."""
    s = [F.sum(value(F.col("a")[k])) for k in range(CLASSES)]
    return d.groupBy("qid", "label").agg(F.array(*(F.round(x, digits) if digits else x for x in s)).alias("s"))


def log_cell(c: Column) -> Column:
    return F.log(c + 0.5)


# Orders of positions and series along them


def moments(sigs: DataFrame, channel: str, positions: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, covariance) of the codes of the training rows. Sums and sums of products, one row a position, reach the driver."""
    rows = sigs.filter(f"not is_query and channel = '{channel}'").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda c: c["val"]).alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((positions + 2, positions), np.int64)
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.int64).reshape(-1, positions)
            acc += np.vstack([x.T @ x, x.sum(axis=0), np.full(positions, len(x))])
        yield pa.RecordBatch.from_arrays([pa.array(range(positions + 2), pa.int32()), pa.array(acc.tolist(), pa.list_(pa.int64()))], names=["i", "v"])

    got = rows.select("v").mapInArrow(sums, "i int, v array<long>").groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(positions))).collect()
    acc = np.array([r[1:] for r in sorted(got, key=lambda r: r["i"])], np.float64).reshape(-1, positions) if got else np.zeros((positions + 2, positions))
    n = max(1.0, acc[positions + 1, 0])
    mean = acc[positions] / n
    return mean, acc[:positions] / n - np.outer(mean, mean)


def eigen_importance(sigs: DataFrame, channel: str, positions: int, rounds: int = 200) -> DataFrame:
    """(pos, load): how much each position loads on the first eigenvector of the codes' covariance, six digits."""
    _, cov = moments(sigs, channel, positions)
    v = 1.0 + np.arange(positions) / positions
    for _ in range(rounds):
        nxt = cov @ v
        size = np.linalg.norm(nxt)
        if size < 1e-10:
            break
        v = nxt / size
    v = np.abs(v) / max(np.linalg.norm(v), 1e-300)
    return sigs.sparkSession.createDataFrame([(k, float(round(x, 6))) for k, x in enumerate(v)], "pos int, load double")


def combined_order(raw: DataFrame, loads: DataFrame) -> DataFrame:
    """(pos, ord): positions by gain times load, the greatest first. raw: (pos, raw) of one channel."""
    d = raw.join(F.broadcast(loads), "pos").withColumn("both", F.round(F.col("raw") * F.col("load"), 9))
    return d.withColumn("ord", F.row_number().over(W.partitionBy().orderBy(F.desc("both"), "pos"))).select("pos", "ord")  # one row a position


def series_ordered(cells_: DataFrame, order: DataFrame, stops: list[int]) -> DataFrame:
    """(stop, qid, label, pred): log sums over the first `stop` positions of the order, all channels of a position together."""
    d = cells_.join(F.broadcast(order.select("pos", "ord")), "pos").withColumn("stop", F.explode(F.array(*(F.lit(s) for s in stops)))).filter("ord <= stop")
    s = [F.round(F.sum(log_cell(F.col("a")[k])), 9) for k in range(CLASSES)]
    return d.groupBy("stop", "qid", "label").agg(F.array(*s).alias("s")).select("stop", "qid", "label", argmax_array(F.col("s")).alias("pred"))


def softmax(a: Column, temperature: float) -> Column:
    most = F.greatest(F.lit(0).cast("long"), F.array_max(a))
    e = F.transform(a, lambda x: F.exp((x - most) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def series_product(arrays: DataFrame, temperature: float) -> DataFrame:
    """(qid, label, pred): product of the channels' softmax posteriors."""
    p = F.zip_with(F.zip_with(softmax(F.col("px"), temperature), softmax(F.col("vg"), temperature), lambda x, y: x * y), softmax(F.col("hg"), temperature), lambda x, y: x * y)
    return arrays.select("qid", "label", argmax_array(F.transform(p, lambda x: F.round(x, 12))).alias("pred"))


def series_sequential(arrays: DataFrame, order: tuple[str, ...], temperatures: tuple[float, ...], floor: float = 1e-10) -> DataFrame:
    """(qid, label, pred): a posterior that each channel updates; after each it is floored and scaled to 1."""
    d = arrays.withColumn("post", F.array_repeat(F.lit(1.0 / CLASSES), CLASSES))
    for c, t in zip(order, temperatures, strict=True):
        d = d.withColumn("lik", softmax(F.col(c), t))
        d = d.withColumn("post", F.zip_with("post", "lik", lambda p, x: F.greatest(p * x, F.lit(floor))))
        d = d.withColumn("post", F.transform("post", lambda p: p / F.aggregate("post", F.lit(0.0), lambda s, y: s + y)))
    return d.select("qid", "label", argmax_array(F.transform("post", lambda x: F.round(x, 12))).alias("pred"))


# The cube with near values


def hot_multiprobe(sigs: DataFrame, hot: DataFrame, bg: DataFrame, ig: DataFrame, nbr: DataFrame, shift: int = 2) -> DataFrame:
    """(qid, label, pred, margin): own cells at their position's weight, cells of near values unweighted and shifted down before the sum."""
    q = sigs.filter("is_query").select(F.col("id").alias("qid"), "label", "channel", "pos", "val").join(F.broadcast(bg), "channel").filter("val <> bg").drop("bg")
    cube = class_arrays(hot)
    own = q.join(F.broadcast(ig), ["channel", "pos"]).join(cube, ["channel", "pos", "val"], "left").withColumn("a", F.transform("a", lambda x: x * F.col("w")))
    near = q.join(F.broadcast(nbr), "val").withColumn("val", F.col("nval")).join(cube, ["channel", "pos", "val"]).withColumn("a", F.transform("a", lambda x: F.shiftright(x, shift)))
    both = own.select("qid", "label", "a").unionByName(near.select("qid", "label", "a"))
    s = summed(both, lambda c: F.coalesce(c, F.lit(0).cast("long")))
    first = F.sort_array("s", asc=False)
    return s.select("qid", "label", argmax_array(F.col("s")).alias("pred"), (F.get(first, F.lit(0)) - F.get(first, F.lit(1))).alias("margin"))


def dual_map(px: DataFrame, gm: DataFrame) -> DataFrame:
    """(qid, label, px, gm, dual): best classes by the pixel cube, by the gradient map's cube, and by the first plus half of the second."""
    d = px.join(gm.withColumnRenamed("s", "g"), ["qid", "label"], "full")
    zero = F.array_repeat(F.lit(0).cast("long"), CLASSES)
    d = d.select("qid", "label", F.coalesce("s", zero).alias("s"), F.coalesce("g", zero).alias("g"))
    return d.select("qid", "label", argmax_array(F.col("s")).alias("px"), argmax_array(F.col("g")).alias("gm"), argmax_array(F.zip_with("s", "g", lambda a, b: a + A.div(b, F.lit(2)))).alias("dual"))


def level_fusion(fine: DataFrame, coarse: DataFrame, weight: int = 8) -> DataFrame:
    """(qid, label, pred): scores (qid, label, cls, score) of the fine level plus `weight` times those of the coarse one."""
    both = fine.select("qid", "label", "cls", "score").unionByName(coarse.select("qid", "label", "cls", (F.col("score") * weight).alias("score")))
    return argmax(both.groupBy("qid", "label", "cls").agg(F.sum("score").alias("score")), "score", keys=("qid", "label"))


# Prototypes


def nearest_mean(planes: DataFrame, centroids: DataFrame, sizes: DataFrame) -> DataFrame:
    """(qid, label, pred): the class whose mean plane (sums over its size, not rounded) has the largest dot product."""
    p = centroids.join(sizes, "label").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda c: c["s"]).alias("s"), F.first("n").alias("n"))
    q = planes.filter("is_query").select(F.col("id").alias("qid"), "label", "t")
    d = q.join(F.broadcast(p.select(F.col("label").alias("cls"), "s", "n"))).select("qid", "label", "cls", F.round(A.dot(F.col("t"), F.col("s")) / F.col("n"), 9).alias("v"))
    return argmax(d, "v", keys=("qid", "label"))


def spectral_prototypes(spectra: DataFrame) -> DataFrame:
    """(label, proto): means of the training rows' coefficients, truncated towards zero."""
    d = spectra.filter("not is_query").select("label", F.posexplode("coefs").alias("u", "c")).groupBy("label", "u").agg(F.sum("c").alias("s"), F.count("*").alias("n"))
    return d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("u", A.div(F.col("s"), F.col("n")).alias("m")))), lambda c: c["m"]).alias("proto"))


def noisy_prototype(planes: DataFrame, protos: DataFrame, per_mille: int, seed: str = "noise") -> DataFrame:
    """(qid, label, pred): nearest ternary prototype where a share of the query's trits is replaced, by digests of seed, id and place."""
    q = planes.filter("is_query").select(F.col("id").alias("qid"), "label", "t")
    draw = lambda what, i: F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.lit(what), F.col("qid"), i.cast("string"))), 1, 8), 16, 10).cast("long")
    t = F.transform("t", lambda v, i: F.when(draw("hit", i) % 1000 < per_mille, (draw("trit", i) % 3).cast("int") - 1).otherwise(v))
    d = q.select("qid", "label", t.alias("t")).join(F.broadcast(protos.select(F.col("label").alias("cls"), "proto")))
    return argmax(d.select("qid", "label", "cls", A.dot(F.col("t"), F.col("proto")).alias("s")), "s", keys=("qid", "label"))


# Experts, tiles, neighbours, priors


def first_classes(scores: DataFrame, n: int) -> DataFrame:
    """(qid, cls, place) of the best `n` classes."""
    w = W.partitionBy("qid").orderBy(F.desc("score"), "cls")
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("qid", "cls", "place")


def pair_experts(top: DataFrame, sigs: DataFrame, bg: DataFrame, pair_ig: DataFrame, posterior: DataFrame, base: DataFrame, margin: float) -> DataFrame:
    """(qid, label, pred, expert): where the two best classes of the posterior are within `margin`, the candidate of one of them that
    agrees with the query at most weight of that pair; else, or without such a candidate, the base answer.

    posterior: (qid, cls, score); base: (qid, label, pred); ties go to more votes, then the smaller id. The close queries and their
    candidates are kept: several branches read them, and a plan that holds them each time is large on the driver.
    """
    w = W.partitionBy("qid").orderBy(F.desc("score"), "cls")
    two = posterior.withColumn("place", F.row_number().over(w)).filter("place <= 2").groupBy("qid").agg(F.min("cls").alias("a"), F.max("cls").alias("b"), (F.max("score") - F.min("score")).alias("gap"))
    close = kept(two.filter(F.col("gap") < margin).select("qid", "a", "b"))
    s = sigs.join(F.broadcast(bg), "channel").filter("val <> bg")
    q = s.filter("is_query").select(F.col("id").alias("qid"), "channel", "pos", "val").join(close, "qid").join(F.broadcast(pair_ig), ["a", "b", "channel", "pos"])
    mine = kept(top.join(close, "qid").filter("tlabel = a or tlabel = b").select("qid", "tid", "tlabel", "votes"))
    t = s.filter("not is_query").select(F.col("id").alias("tid"), "channel", "pos", "val")
    hits = mine.select("qid", "tid").join(t, "tid").join(q, ["qid", "channel", "pos", "val"]).groupBy("qid", "tid").agg(F.sum("w").alias("v"))
    found = mine.join(hits, ["qid", "tid"], "left").groupBy("qid").agg(F.max_by("tlabel", F.struct(F.coalesce("v", F.lit(0).cast("long")), "votes", -F.col("tid"))).alias("own"))
    return base.join(found, "qid", "left").select("qid", "label", F.coalesce("own", "pred").alias("pred"), F.col("own").isNotNull().alias("expert"))


def tile_votes(planes: DataFrame, votes: DataFrame, protos: dict[int, list[int]]) -> DataFrame:
    """(qid, tid, tlabel, votes) of the rows in the query's own tile: the prototype of largest dot product, of equals the first."""
    tile = train.nearest_tile(protos)
    own = planes.filter("is_query").select(F.col("id").alias("qid"), tile.alias("tile"))
    theirs = planes.filter("not is_query").select(F.col("id").alias("tid"), tile.alias("tile2"))
    return votes.join(own, "qid").join(theirs, "tid").filter("tile = tile2").select("qid", "tid", "tlabel", "votes")


def first_blocks_vote(sigs: DataFrame, postings: DataFrame, order: DataFrame, classes: DataFrame, bg: DataFrame, blocks: int) -> DataFrame:
    """(qid, tid, tlabel, votes): one vote for each of the first `blocks` positions that agrees, among rows of the given classes (qid, cls).

    The classes are joined to the probes before the index is, so other rows are not met.
    """
    q = sigs.filter("is_query").select(F.col("id").alias("qid"), "channel", "pos", "val").join(F.broadcast(bg), "channel").filter("val <> bg").drop("bg")
    q = q.join(F.broadcast(order.filter(F.col("ord") <= blocks).select("channel", "pos")), ["channel", "pos"]).join(classes.select("qid", F.col("cls").alias("tlabel")), "qid")
    return q.join(postings, ["channel", "pos", "val", "tlabel"]).groupBy("qid", "tid", "tlabel").agg(F.count("*").alias("votes"))


def tempered_prior(votes: DataFrame, scores: DataFrame, alpha: float, temperature: float, scale: int) -> DataFrame:
    """Votes times 1 + int(alpha * share * scale), where share is the class's posterior to the power 1 / temperature, scaled to 1."""
    every = W.partitionBy("qid")
    p = F.col("score") / F.greatest(F.lit(1).cast("long"), F.sum("score").over(every))
    d = scores.withColumn("p", F.pow(p + 1e-30, F.lit(1.0 / temperature)))
    boost = 1 + F.floor(F.round(F.lit(alpha) * F.col("p") / F.sum("p").over(every) * scale, 6)).cast("long")
    d = d.withColumn("boost", boost).select("qid", F.col("cls").alias("tlabel"), "boost")
    return votes.join(d, ["qid", "tlabel"]).select("qid", "tid", "tlabel", (F.col("votes") * F.col("boost")).alias("votes"))


def cascade_gauss(top: DataFrame, maps: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """(k, qid, label, pred): candidates by the distance of their colour gradient maps (id, m), the nearest first, majority of the first k."""
    d = top.select("qid", "tid", "tlabel", "votes").join(maps.select(F.col("id").alias("tid"), F.col("m").alias("b")), "tid").join(maps.select(F.col("id").alias("qid"), F.col("m").alias("a")), "qid")
    d = d.withColumn("far", S.map_l1(F.col("a"), F.col("b"))).withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("far", F.desc("votes"), "tid")))
    d = d.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).filter("place <= k").join(labels, "qid")
    n = d.groupBy("k", "qid", "label", F.col("tlabel").alias("cls")).agg(F.count("*").alias("n"))
    return argmax(n, "n", keys=("k", "qid", "label"))


def pair_noise(planes: DataFrame, cols: dict[str, str]) -> DataFrame:
    """(channel, snr), six digits: mean dot of pairs of equal labels less that of others, over the others' deviation.

    Pairs are fixed: each training row with the next one of its label by id, and with the first row of the next label (the
    lowest label's after the highest).
    """
    t = planes.filter("not is_query").select("id", "label", *cols.values())
    after = t.withColumn("same", F.lead("id").over(W.partitionBy("label").orderBy("id")))
    order = W.partitionBy().orderBy("label")  # one row a label
    firsts = t.groupBy("label").agg(F.min("id").alias("first"))
    firsts = firsts.select("label", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("other"))
    pairs = after.join(F.broadcast(firsts), "label")
    partner = t.select(F.col("id").alias("pid"), *(F.col(c).alias(f"p_{c}") for c in cols.values()))
    dots = lambda key: pairs.filter(F.col(key).isNotNull()).join(partner, F.col(key) == F.col("pid")).select(F.explode(F.array(*(F.struct(F.lit(n).alias("channel"), A.dot(F.col(c), F.col(f"p_{c}")).alias("d")) for n, c in cols.items()))).alias("x")).select("x.*")
    same = dots("same").groupBy("channel").agg(F.avg("d").alias("ms"))
    other = dots("other").groupBy("channel").agg(F.avg("d").alias("md"), F.var_pop("d").alias("vd"))
    return same.join(other, "channel").select("channel", F.round((F.col("ms") - F.col("md")) / (F.sqrt("vd") + 1e-9), 6).alias("snr"))
