"""Candidates: similarities, robust weights, combined scores and filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tritlake.functions import arrays as A


@dataclass(frozen=True)
class Weights:
    """Weights of the topological terms and the scale of their damping; those of the two dot products are fixed."""

    cent: int = 50
    prof: int = 16
    div: int = 200
    gdiv: int = 100
    scale: int = 50
    px: int = 256
    vg: int = 192


#: Centroid similarity when both are open, or only one is.
BOTH_OPEN, DISAGREE = 50, -80


def centroid_similarity(q: Column, c: Column) -> Column:
    return F.when((q < 0) & (c < 0), BOTH_OPEN).when((q < 0) | (c < 0), DISAGREE).otherwise(-F.abs(q - c))


def divergence_similarity(qn: Column, qc: Column, cn: Column, cc: Column, one_sided: int = 10) -> Column:
    far = F.when((qc >= 0) & (cc >= 0), F.abs(qc - cc) * 2).when((qc < 0) != (cc < 0), one_sided).otherwise(0)
    return -F.abs(qn - cn) - far


def base_features(top: DataFrame, described: DataFrame, one_sided: int = 10) -> DataFrame:
    """Joins candidates (qid, tid, tlabel, votes, rank) with both sides' features; adds the similarities and the true label."""
    q = described.filter("is_query").select(F.col("id").alias("qid"), F.col("label"), *(F.col(c).alias(f"q_{c}") for c in ("t", "vg", "prof", "ns", "cy", "gdiv", "cent", "px")))
    t = described.filter("not is_query").select(F.col("id").alias("tid"), *(F.col(c).alias(f"t_{c}") for c in ("t", "vg", "prof", "ns", "cy", "gdiv", "cent", "px")))
    d = top.join(t, "tid").join(q, "qid")
    c = F.col
    return d.select(
        "qid", "tid", "tlabel", "label", "votes", "rank",
        A.dot(c("q_t"), c("t_t")).alias("dot_px"),
        A.dot(c("q_vg"), c("t_vg")).alias("dot_vg"),
        centroid_similarity(c("q_cent"), c("t_cent")).cast("long").alias("cent_sim"),
        A.dot(c("q_prof"), c("t_prof")).alias("prof_sim"),
        divergence_similarity(c("q_ns"), c("q_cy"), c("t_ns"), c("t_cy"), one_sided).cast("long").alias("div_sim"),
        (-A.sad(c("q_gdiv"), c("t_gdiv"))).alias("gdiv_sim"),
        A.sad(c("q_px"), c("t_px")).alias("sad"),
        c("t_ns").alias("ns"), c("q_ns").alias("q_ns"), c("t_cent").alias("cent"), c("q_cent").alias("q_cent"),
    )


def spread(candidates: DataFrame, default: int = 1000) -> DataFrame:
    """(qid, mad): median absolute deviation of the candidates' ns, upper medians; under three rows the default, at least 1."""
    g = candidates.groupBy("qid").agg(F.sort_array(F.collect_list("ns")).alias("v"))
    mid = lambda a: F.get(a, F.floor(F.size(a) / 2).cast("int"))
    g = g.withColumn("med", mid(F.col("v"))).withColumn("dev", F.sort_array(F.transform("v", lambda x: F.abs(x - F.col("med")))))
    return g.select("qid", F.when(F.size("v") < 3, default).otherwise(F.greatest(F.lit(1), mid(F.col("dev")))).cast("int").alias("mad"))


def combined(candidates: DataFrame, weights: Weights = Weights(), mad_default: int = 1000) -> DataFrame:
    """Adds mad, combined and place (1 is best: score, then votes, then smaller id)."""
    d = candidates.join(spread(candidates, mad_default), "qid")
    return ranked(d.withColumn("combined", combined_score(weights)))


def combined_score(w: Weights | dict[str, Column]) -> Column:
    """The score over columns of base_features and mad; weights are numbers or columns."""
    get = (lambda k: w[k]) if isinstance(w, dict) else (lambda k: F.lit(getattr(w, k)))
    damped = lambda k: A.div(get("scale").cast("long") * get(k), get("scale") + F.col("mad"))
    out = F.col("dot_px") * 256 + F.col("dot_vg") * 192
    for k in ("cent", "prof", "div", "gdiv"):
        out = out + damped(k) * F.col(f"{k}_sim")
    return out.cast("long")


def ranked(d: DataFrame, score: str = "combined", ascending: bool = False) -> DataFrame:
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return d.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(order, F.desc("votes"), "tid")))


def sad_reranked(candidates: DataFrame, keep: int) -> DataFrame:
    """The `keep` candidates of a query with the smallest pixel distance."""
    return ranked(candidates, "sad", ascending=True).filter(F.col("place") <= keep).drop("place")


def filtered(candidates: DataFrame, div_below: int = 0, same_enclosure: bool = False, residual: int = 0) -> DataFrame:
    """Candidates near the query in ns (and alike in enclosure), all if fewer than three pass; ranked by the dot products."""
    ok = F.lit(True)
    if div_below:
        ok = ok & (F.abs(F.col("q_ns") - F.col("ns")) < div_below)
    if same_enclosure:
        ok = ok & ((F.col("q_cent") >= 0) == (F.col("cent") >= 0))
    d = candidates.withColumn("ok", ok).withColumn("n_ok", F.sum(F.col("ok").cast("int")).over(W.partitionBy("qid")))
    d = d.filter("ok or n_ok < 3").drop("ok", "n_ok")
    return ranked(d.withColumn("combined", F.col("dot_px") * 256 + F.col("dot_vg") * 192 - F.abs(F.col("q_ns") - F.col("ns")).cast("long") * residual))
