"""Votes over ranked candidates (qid, label, tlabel, place, ...) and over class scores (qid, label, channel, cls, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tritlake.functions import arrays as A

CLASSES = 10


def argmax(d: DataFrame, score: str, cls: str = "cls", keys: tuple[str, ...] = ("qid",), name: str = "pred") -> DataFrame:
    """The class of the largest score; of equals the smallest class."""
    return d.groupBy(*keys).agg(F.max_by(cls, F.struct(F.col(score), -F.col(cls))).alias(name))


def knn(ranked: DataFrame, k: int | Column = 3) -> DataFrame:
    """(qid, label, pred): majority of the first k."""
    n = ranked.filter(F.col("place") <= k).groupBy("qid", "label", F.col("tlabel").alias("cls")).agg(F.count("*").alias("n"))
    return argmax(n, "n", keys=("qid", "label"))


def weighted(ranked: DataFrame, k: int) -> DataFrame:
    """Votes of combined - least + 1 among the first k."""
    d = ranked.filter(F.col("place") <= k).withColumn("v", F.col("combined") - F.min("combined").over(W.partitionBy("qid")) + 1)
    return argmax(d.groupBy("qid", "label", F.col("tlabel").alias("cls")).agg(F.sum("v").alias("v")), "v", keys=("qid", "label"))


def adaptive(ranked: DataFrame, threshold: int) -> DataFrame:
    """k = 1, 3 or 7 as the spread is below the threshold, below twice it, or not."""
    return knn(ranked, F.when(F.col("mad") < threshold, 1).when(F.col("mad") < 2 * threshold, 3).otherwise(7))


def divergence_filtered(ranked: DataFrame, k: int, factor: float = 1.0) -> DataFrame:
    """Majority of those of the first k whose gdiv_sim lies within factor mean deviations of the median; else the first."""
    d = ranked.filter(F.col("place") <= k)
    g = d.groupBy("qid").agg(F.sort_array(F.collect_list("gdiv_sim")).alias("v"))
    med = F.get("v", F.floor(F.size("v") / 2).cast("int"))
    g = g.select("qid", med.alias("med"), F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + F.abs(x - med)).alias("dev"))
    d = d.join(g, "qid").withColumn("ok", F.abs(F.col("gdiv_sim") - F.col("med")) * F.col("n") <= F.col("dev") * factor)
    any_ok = F.max(F.col("ok").cast("int")).over(W.partitionBy("qid"))
    d = d.withColumn("any_ok", any_ok).filter("ok or (any_ok = 0 and place = 1)")
    n = d.groupBy("qid", "label", F.col("tlabel").alias("cls")).agg(F.count("*").alias("n"))
    return argmax(n, "n", keys=("qid", "label"))


def skip_if_sure(ranked: DataFrame, mad_below: int, ns_below: int, k: int = 3) -> DataFrame:
    """The first alone where the spread and the query's ns are below their thresholds, else majority of k."""
    return knn(ranked, F.when((F.col("mad") < mad_below) & (F.col("q_ns") < ns_below), 1).otherwise(k))


def bayes_sequential(ranked: DataFrame, decay: int = 2, first: int = 15, topo: int = 100) -> DataFrame:
    """(qid, label, pred): each of the first candidates adds evidence * S div (S + place) to its class.

    Classes without a candidate hold 0, so a class with negative evidence loses to the smallest of them.
    """
    j = F.col("place") - 1
    e = (F.col("combined") + (F.col("div_sim") + F.col("gdiv_sim")) * topo) * decay
    d = ranked.filter(F.col("place") <= first).withColumn("v", A.div(e, F.lit(decay) + j))
    return argmax(dense(d.groupBy("qid", "label", F.col("tlabel").alias("cls")).agg(F.sum("v").alias("v")), "v"), "v", keys=("qid", "label"))


def dense(scores: DataFrame, score: str, classes: int = CLASSES) -> DataFrame:
    """Adds the classes that a query has no score for, with 0."""
    every = scores.select("qid", "label").distinct().select("qid", "label", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("cls"))
    return every.join(scores, ["qid", "label", "cls"], "left").select("qid", "label", "cls", F.coalesce(score, F.lit(0).cast("long")).alias(score))


def recurrent(ranked: DataFrame, gain: int = 2, inertia: int = 3, penalty: int = 10, first: int = 15, start: Column | None = None, skip: int = 0) -> DataFrame:
    """(qid, label, h array): h = (S h + (gain * ev for the candidate's class, else -penalty)) div (S + 1), in rank order."""
    d = ranked.filter((F.col("place") > skip) & (F.col("place") <= skip + first))
    seq = d.groupBy("qid", "label").agg(F.array_sort(F.collect_list(F.struct("place", "tlabel", A.div(F.col("combined"), F.lit(256)).alias("ev")))).alias("seq"))
    zero = F.array_repeat(F.lit(0).cast("long"), CLASSES)

    def step(h: Column, c: Column) -> Column:
        return F.transform(h, lambda v, k: A.div(v * inertia + F.when(k == c["tlabel"], c["ev"] * gain).otherwise(F.lit(-penalty).cast("long")), F.lit(inertia + 1)))

    return seq.select("qid", "label", F.aggregate("seq", zero if start is None else start, step).alias("h"))


def argmax_array(h: Column) -> Column:
    return (F.array_position(h, F.array_max(h)) - 1).cast("int")


def pipeline(ranked: DataFrame, decay: int = 2, first_a: int = 5, topo: int = 100, gain: int = 2, inertia: int = 3, penalty: int = 10, first_b: int = 10) -> DataFrame:
    """(qid, label, pred): the sequential sums over the first candidates, then the recurrence over the next from there."""
    d = ranked.filter(F.col("place") <= first_a + first_b)
    evidence = A.div((F.col("combined") + (F.col("div_sim") + F.col("gdiv_sim")) * topo) * decay, F.lit(decay) + F.col("place") - 1)
    cells = F.struct("place", "tlabel", evidence.alias("a"), A.div(F.col("combined"), F.lit(256)).alias("b"))
    seq = d.groupBy("qid", "label").agg(F.array_sort(F.collect_list(cells)).alias("seq"))

    def step(h: Column, c: Column) -> Column:
        later = lambda v, k: A.div(v * inertia + F.when(k == c["tlabel"], c["b"] * gain).otherwise(F.lit(-penalty).cast("long")), F.lit(inertia + 1))
        return F.transform(h, lambda v, k: F.when(c["place"] <= first_a, v + F.when(k == c["tlabel"], c["a"]).otherwise(F.lit(0).cast("long"))).otherwise(later(v, k)))

    return seq.select("qid", "label", argmax_array(F.aggregate("seq", F.array_repeat(F.lit(0).cast("long"), CLASSES), step)).alias("pred"))


def hot_scores(sigs: DataFrame, hot: DataFrame, bg: DataFrame | None = None, by_channel: bool = False, log: bool = False, weight: DataFrame | None = None) -> DataFrame:
    """(qid, label, [channel,] cls, score): sums over positions of a query's cells of the class-frequency cube.

    All classes are there, with 0 (or ln 0.5 for each position with `log`) where a cell is empty. `bg` leaves background
    values out; `weight` multiplies by a position's weight.
    """
    q = sigs.filter("is_query").select(F.col("id").alias("qid"), "label", "channel", "pos", "val")
    if bg is not None:
        q = q.join(F.broadcast(bg), "channel").filter("val <> bg").drop("bg")
    # One row per cell with all classes in an array: the join hits it once for each position.
    cube = hot.groupBy("channel", "pos", "val").agg(F.map_from_entries(F.collect_list(F.struct("label", "cnt"))).alias("m"))
    cube = cube.select("channel", "pos", "val", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long"))).alias("a"))
    d = q.join(cube, ["channel", "pos", "val"], "left").withColumn("a", F.coalesce("a", F.array_repeat(F.lit(0).cast("long"), CLASSES)))
    if weight is not None:
        d = d.join(F.broadcast(weight), ["channel", "pos"]).withColumn("a", F.transform("a", lambda x: x * F.col("w")))
    keys = ["qid", "label", *(["channel"] if by_channel else [])]
    cell = lambda k: F.log(F.col("a")[k] + 0.5) if log else F.col("a")[k]
    g = d.groupBy(*keys).agg(*(F.sum(cell(k)).alias(f"s{k}") for k in range(CLASSES)))
    if log:  # sums of logarithms are rounded, so that their order does not decide
        g = g.select(*keys, *(F.round(f"s{k}", 9).alias(f"s{k}") for k in range(CLASSES)))
    return g.select(*keys, F.posexplode(F.array(*(f"s{k}" for k in range(CLASSES)))).alias("cls", "score"))


def channel_arrays(scores: DataFrame, channels: tuple[str, ...] = ("px", "hg", "vg")) -> DataFrame:
    """(qid, label, px, hg, vg): each channel's class scores as an array in class order."""
    s = scores.groupBy("qid", "label", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "score"))), lambda c: c["score"]).alias("a"))
    return s.groupBy("qid", "label").agg(*(F.max(F.when(F.col("channel") == c, F.col("a"))).alias(c) for c in channels))


def margin(a: Column) -> Column:
    s = F.sort_array(a, asc=False)
    return F.get(s, F.lit(0)) - F.get(s, F.lit(1))


def added(*parts: tuple[Column, int]) -> Column:
    def scaled(a: Column, w: int) -> Column:
        return F.transform(a, lambda x: x * w)

    out = scaled(*parts[0])
    for part in parts[1:]:
        out = F.zip_with(out, scaled(*part), lambda x, y: x + y)
    return out


def fused(arrays: DataFrame, rule: str) -> DataFrame:
    """(qid, label, pred) by a fusion rule over the channels' class scores."""
    p, h, v = F.col("px"), F.col("hg"), F.col("vg")
    am = argmax_array
    top = lambda a: F.greatest(F.lit(1), F.array_max(a))
    if rule == "majority":
        mp, mh, mv = margin(p), margin(h), margin(v)
        alone = F.when((mv >= mp) & (mv >= mh), am(v)).when(mp >= mh, am(p)).otherwise(am(h))
        pred = F.when((am(p) == am(h)) | (am(p) == am(v)), am(p)).when(am(h) == am(v), am(h)).otherwise(alone)
    elif rule == "borda":
        def points(a: Column) -> Column:
            order = F.sort_array(F.transform(a, lambda x, k: F.struct(x.alias("x"), (-k).alias("k"))), asc=False)
            return F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.lit(CLASSES) - F.array_position(F.transform(order, lambda o: -o["k"]), k))

        pred = am(added((points(p), 1), (points(h), 1), (points(v), 1)))
    elif rule == "normalized":
        part = lambda a: F.transform(a, lambda x: F.round(x / top(a), 12))
        pred = am(F.transform(added((part(p), 1), (part(h), 1), (part(v), 1)), lambda x: F.round(x, 9)))
    elif rule == "margin":
        own = lambda a, m: F.transform(a, lambda x: x * m)
        parts = [(own(a, margin(a)), 1) for a in (p, h, v)]
        none = (margin(p) + margin(h) + margin(v)) == 0
        pred = F.when(none, 0).otherwise(am(added(*parts)))
    elif rule == "v_primary":
        pred = F.when(margin(v) > A.div(top(v), F.lit(10)), am(v)).otherwise(am(added((v, 2), (p, 1))))
    elif rule == "gate":
        first = F.zip_with(v, p, lambda a, b: (a + 1) * (b + 1))
        scaled = F.transform(first, lambda x: A.div(x * 10000, F.greatest(F.lit(1), F.array_max(first))))
        pred = am(F.zip_with(scaled, h, lambda a, b: a * (b + 1)))
    else:
        w = {"additive": (1, 1, 1), "best_two": (1, 0, 1), "v_dominant": (2, 1, 4)}[rule]
        pred = am(added((p, w[0]), (h, w[1]), (v, w[2])))
    return arrays.select("qid", "label", pred.cast("int").alias("pred"))


def log_series(arrays: DataFrame, order: tuple[str, ...] = ("vg", "px", "hg"), temperature: float = 8.0, decay: float = 0.5) -> DataFrame:
    """(qid, label, pred): sum over channels of (score - best) / temperature, with a temperature that decays by channel.

    The posteriors multiplied channel by channel (softmax, updated in sequence) have the same best class.
    """
    def cooled(c: str, t: float) -> Column:
        return F.transform(F.col(c), lambda x: (x - F.greatest(F.lit(0), F.array_max(c))) / t)

    parts = [cooled(c, temperature * decay**k) for k, c in enumerate(order)]
    out = parts[0]
    for a in parts[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return arrays.select("qid", "label", argmax_array(F.transform(out, lambda x: F.round(x, 9))).alias("pred"))


def nearest_prototype(queries: DataFrame, protos: DataFrame) -> DataFrame:
    """(qid, label, pred): the prototype (label, proto array; one row for each label) of largest dot product."""
    p = protos.select(F.col("label").alias("cls"), "proto")
    d = queries.join(F.broadcast(p)).select("qid", "label", "cls", A.dot(F.col("t"), F.col("proto")).alias("s"))
    return argmax(d, "s", keys=("qid", "label"))
