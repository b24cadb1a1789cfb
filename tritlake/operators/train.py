"""Training-side aggregations over signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tritlake.functions.lineage import kept

#: Largest integer weight of a position.
SCALE = 16


def background(sigs: DataFrame) -> DataFrame:
    """(channel, bg): the most frequent value of the training rows; of equals the smallest."""
    n = sigs.filter("not is_query").groupBy("channel", "val").agg(F.count("*").alias("n"))
    return n.groupBy("channel").agg(F.max_by("val", F.struct("n", -F.col("val"))).alias("bg"))


def background_of(hot: DataFrame) -> DataFrame:
    """`background` from the cube, so that the signatures are read once."""
    n = hot.groupBy("channel", "val").agg(F.sum("cnt").alias("n"))
    return n.groupBy("channel").agg(F.max_by("val", F.struct("n", -F.col("val"))).alias("bg"))


def hot_map(sigs: DataFrame) -> DataFrame:
    """(channel, pos, val, label, cnt) over the training rows."""
    return sigs.filter("not is_query").groupBy("channel", "pos", "val", "label").agg(F.count("*").alias("cnt"))


def gain(hot: DataFrame, bg: DataFrame | None, raw_only: bool = False) -> DataFrame:
    """(channel, pos, w): information gain of a position about the label as an integer from 1 to SCALE.

    With `bg` the background value is left out of the conditional entropy, though rows that hold it stay in the total.
    The gain is rounded to nine digits before it is made an integer, so that the order of sums does not matter.
    """
    one = hot.groupBy("channel", "pos", "label").agg(F.sum("cnt").alias("n"))
    at = W.partitionBy("channel", "pos")
    share = F.col("n") / F.sum("n").over(at)
    prior = one.withColumn("e", -share * F.log2(share)).groupBy("channel", "pos").agg(F.sum("e").alias("hc"), F.sum("n").alias("total"))
    cell = W.partitionBy("channel", "pos", "val")
    p = F.col("cnt") / F.sum("cnt").over(cell)
    cond = hot.withColumn("e", -F.col("cnt") * F.log2(p))
    if bg is not None:
        cond = cond.join(F.broadcast(bg), "channel").withColumn("e", F.when(F.col("val") == F.col("bg"), 0.0).otherwise(F.col("e")))
    cond = cond.groupBy("channel", "pos").agg(F.sum("e").alias("he"))
    raw = prior.join(cond, ["channel", "pos"]).withColumn("raw", F.round(F.col("hc") - F.col("he") / F.col("total"), 9))
    if raw_only:
        return raw.select("channel", "pos", "raw")
    most = F.max("raw").over(W.partitionBy("channel"))
    return raw.withColumn("most", most).select("channel", "pos", F.when(F.col("most") > 0, F.greatest(F.lit(1), F.floor(F.round(F.col("raw") / F.col("most") * SCALE, 6) + 0.5).cast("int"))).otherwise(1).alias("w"))


def pair_gain(hot: DataFrame, bg: DataFrame) -> DataFrame:
    """(a, b, channel, pos, w): the gain between two labels a < b, for all pairs in one plan."""
    pairs = hot.select("label").distinct()
    pairs = kept(pairs.select(F.col("label").alias("a")).join(pairs.select(F.col("label").alias("b")), F.col("a") < F.col("b")))
    both = hot.join(F.broadcast(pairs), (F.col("label") == F.col("a")) | (F.col("label") == F.col("b")))
    keyed = both.withColumn("channel", F.concat_ws("|", "channel", "a", "b"))
    bgs = bg.join(F.broadcast(pairs)).withColumn("channel", F.concat_ws("|", "channel", "a", "b")).select("channel", "bg")
    g = gain(keyed, bgs)
    parts = F.split("channel", "\\|")
    return g.select(parts[1].cast("int").alias("a"), parts[2].cast("int").alias("b"), parts[0].alias("channel"), "pos", "w")


def postings(sigs: DataFrame, bg: DataFrame | None) -> DataFrame:
    """(channel, pos, val, tid, tlabel): the inverted index; without the background value if one is given."""
    p = sigs.filter("not is_query")
    if bg is not None:
        p = p.join(F.broadcast(bg), "channel").filter("val <> bg")
    return p.select("channel", "pos", "val", F.col("id").alias("tid"), F.col("label").alias("tlabel"))


def centroids(planes: DataFrame) -> DataFrame:
    """(label, pos, s, proto, mean): sums over the training images, their sign beyond a third of the images, their mean."""
    d = planes.filter("not is_query").select("label", F.posexplode("t").alias("pos", "t"))
    d = d.groupBy("label", "pos").agg(F.sum("t").alias("s"), F.count("*").alias("n"))
    third = F.floor(F.col("n") / 3)
    trunc = F.when(F.col("s") < 0, -F.floor(-F.col("s") / F.col("n"))).otherwise(F.floor(F.col("s") / F.col("n"))).cast("int")
    return d.select("label", "pos", "s", F.when(F.col("s") > third, 1).when(F.col("s") < -third, -1).otherwise(0).alias("proto"), trunc.alias("mean"))


def ground_states(hist: DataFrame) -> DataFrame:
    """(label, bin, mean, dev): integer mean and deviation of the training images' histograms; no spread counts as 1."""
    g = hist.groupBy("label", "bin").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count("*").alias("k"))
    m = F.floor(F.col("s") / F.col("k")).cast("long")
    var = F.floor(F.col("q") / F.col("k")).cast("long") - m * m
    return g.select("label", "bin", m.alias("mean"), F.when(var <= 0, 1).otherwise(F.greatest(F.lit(1), F.floor(F.sqrt(var.cast("double"))).cast("int"))).alias("dev"))


def delta_map(hist: DataFrame, states: DataFrame) -> DataFrame:
    """(proto, bin, trit, label, cnt): deviations from every label's ground state, beyond its spread, by own label."""
    s = states.select(F.col("label").alias("proto"), "bin", "mean", "dev")
    d = hist.join(F.broadcast(s), "bin")
    delta = F.col("n") - F.col("mean")
    trit = F.when(delta > F.col("dev"), 1).when(delta < -F.col("dev"), -1).otherwise(0)
    return d.withColumn("trit", trit).groupBy("proto", "bin", "trit", "label").agg(F.count("*").alias("cnt"))


def bucket_bounds(values: DataFrame, col: str, buckets: int, slices: int = 256) -> DataFrame:
    """(bucket, bound): the value at place (b+1)*n/B of the sorted values, for all buckets but the last.

    Counts of equal values are summed first. Distinct values are cut into ranges at approximate quantiles, each range is
    summed by itself, and the ranges' sums, a fixed number of them, give where each begins.
    """
    n = kept(values.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n")))
    cuts = n.agg(F.percentile_approx("v", F.array(*(F.lit(k / slices) for k in range(1, slices))), F.lit(1000)).alias("cuts"))
    part = n.join(F.broadcast(cuts)).select("v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    sums = part.groupBy("part").agg(F.sum("n").alias("own"))
    before = W.partitionBy().orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sums = sums.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(W.partitionBy()).alias("total"))
    run = part.join(F.broadcast(sums), "part").withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("v")))
    run = run.select("v", "n", "upto", "total", F.explode(F.sequence(F.lit(0), F.lit(buckets - 2))).alias("bucket"))
    place = F.floor((F.col("bucket") + 1) * F.col("total") / buckets)
    return run.filter((place < F.col("upto")) & (place >= F.col("upto") - F.col("n"))).select("bucket", F.col("v").alias("bound"))


def position_order(ig: DataFrame) -> DataFrame:
    """(channel, pos, ord): positions by weight, the heaviest first; a channel has a fixed number of positions."""
    return ig.withColumn("ord", F.row_number().over(W.partitionBy("channel").orderBy(F.desc("w"), "pos"))).select("channel", "pos", "ord")


def nearest_tile(protos: dict[int, list[int]]) -> Column:
    """The prototype of largest dot product with column t; of equals the first."""
    scored = [F.struct(F.aggregate(F.zip_with("t", F.array(*(F.lit(v) for v in p)), lambda x, y: x * y), F.lit(0), lambda s, x: s + x).alias("score"), F.lit(-k).alias("k")) for k, p in sorted(protos.items())]
    return -F.array_max(F.array(*scored))["k"]


def tile_prototypes(planes: DataFrame, rounds: int = 5) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """Prototypes of the last assignment of `tiles`, and those that it gives."""
    d = planes.filter("not is_query").select("id", "label", "t")

    def signs(grouped: DataFrame, key: str) -> dict[int, list[int]]:
        cells = grouped.select(key, F.posexplode("t").alias("pos", "v")).groupBy(key, "pos").agg(F.sum("v").alias("s"))
        rows = cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("a")).collect()
        return {r[key]: [(x["s"] > 0) - (x["s"] < 0) for x in r["a"]] for r in rows}

    used = protos = signs(d, "label")
    for _ in range(rounds):
        used = protos
        protos = used | signs(d.select("t", nearest_tile(used).alias("tile")), "tile")
        if protos == used:
            break
    return used, protos


def tiles(planes: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, tile): alternating assignment to the prototype of largest dot product and sign-of-sum prototypes.

    Prototypes start from the labels' sums. Only the prototypes, one short array for each label, are on the driver; a tile
    that loses all members keeps its prototype.
    """
    used, _ = tile_prototypes(planes, rounds)
    return planes.filter("not is_query").select("id", nearest_tile(used).alias("tile"))
