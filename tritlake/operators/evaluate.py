"""Accuracy, confusions, error modes, sweeps and maps over predictions (qid, label, pred) and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .score import combined_score


def accuracy(preds: DataFrame) -> DataFrame:
    """(label, n, correct) for each true label."""
    return preds.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("pred")).cast("long")).alias("correct"))


def confusion(preds: DataFrame) -> DataFrame:
    return preds.groupBy("label", "pred").agg(F.count("*").alias("n"))


def confusion_pairs(preds: DataFrame, k: int = 10) -> DataFrame:
    """(a, b, n): the k unordered pairs of labels most often confused; of equals the smaller pair."""
    wrong = preds.filter("label <> pred").select(F.least("label", "pred").alias("a"), F.greatest("label", "pred").alias("b"))
    return wrong.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(k)


def error_modes(preds: DataFrame, ranked: DataFrame) -> DataFrame:
    """(mode, n) of wrong answers: A no candidate has the label, B one has but is not first, C the first has but is outvoted."""
    own = ranked.groupBy("qid").agg(F.max((F.col("tlabel") == F.col("label")).cast("int")).alias("there"), F.max(((F.col("place") == 1) & (F.col("tlabel") == F.col("label"))).cast("int")).alias("first"))
    j = preds.filter("label <> pred").join(own, "qid", "left")
    mode = F.when(F.coalesce("there", F.lit(0)) == 0, "A").when(F.col("first") == 0, "B").otherwise("C")
    return j.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


def recall_at(top: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(k, n, found): queries for which one of the first k candidates has the label, for all k in one pass."""
    hit = top.join(queries, "qid").filter("tlabel = label").groupBy("qid").agg(F.min("rank").alias("at"))
    j = queries.join(hit, "qid", "left").withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    return j.groupBy("k").agg(F.count("*").alias("n"), F.sum((F.coalesce("at", F.lit(1 << 30)) <= F.col("k")).cast("long")).alias("found"))


def agreement(ranked: DataFrame, first: int = 10) -> DataFrame:
    """(qid, agree, gap, mad): how many of the first candidates hold the first one's label; its lead over the second."""
    w = W.partitionBy("qid")
    d = ranked.filter(F.col("place") <= first).withColumn("lead", F.max(F.when(F.col("place") == 1, F.col("tlabel"))).over(w))
    score = lambda p: F.max(F.when(F.col("place") == p, F.col("combined")))
    return d.groupBy("qid").agg(F.sum((F.col("tlabel") == F.col("lead")).cast("long")).alias("agree"), (score(1) - F.coalesce(score(2), score(1))).alias("gap"), F.max("mad").alias("mad"))


def confidence_map(preds: DataFrame, agree: DataFrame, mad_bounds: list[int], gap_bounds: list[int]) -> DataFrame:
    """(fold, agree, mad_bucket, gap_bucket, n, correct): the cube of correctness, in two folds by parity of the id."""
    bucket = lambda c, bounds: sum((F.when(F.col(c) >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    j = preds.join(agree, "qid").select((F.col("qid") % 2).cast("int").alias("fold"), "agree", bucket("mad", mad_bounds).alias("mad_bucket"), bucket("gap", gap_bounds).alias("gap_bucket"), (F.col("label") == F.col("pred")).cast("long").alias("ok"))
    return j.groupBy("fold", "agree", "mad_bucket", "gap_bucket").agg(F.count("*").alias("n"), F.sum("ok").alias("correct"))


def mutual_information(cells: DataFrame, key: str, n: str = "n", correct: str = "correct") -> DataFrame:
    """(h, h_given, mi) in bits, six digits: entropy of correctness, and given the bucket."""
    g = cells.groupBy(key).agg(F.sum(n).alias("n"), F.sum(correct).alias("c"))
    e = lambda a, b: F.when((a > 0) & (a < b), -(a / b) * F.log2(a / b) - (1 - a / b) * F.log2(1 - a / b)).otherwise(0.0)
    t = g.agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum(F.col("n") * e(F.col("c"), F.col("n"))).alias("s"))
    h, hg = e(F.col("c"), F.col("n")), F.col("s") / F.col("n")
    return t.select(F.round(h, 6).alias("h"), F.round(hg, 6).alias("h_given"), F.round(h - hg, 6).alias("mi"))


def grid_search(features: DataFrame, grid: DataFrame, k: int = 3) -> DataFrame:
    """(cent, prof, div, gdiv, scale, n, correct) for every row of a parameter table, in one plan.

    `features` are candidates with mad; the table has a bounded number of rows and is broadcast. Ranking is within
    (configuration, query), so no group grows with the table.
    """
    names = ["cent", "prof", "div", "gdiv", "scale"]
    d = features.join(F.broadcast(grid.select(*(F.col(c).alias(f"w_{c}") for c in names))))
    d = d.withColumn("combined", combined_score({c: F.col(f"w_{c}") for c in names}))
    keys = [f"w_{c}" for c in names]
    d = d.withColumn("place", F.row_number().over(W.partitionBy(*keys, "qid").orderBy(F.desc("combined"), F.desc("votes"), "tid"))).filter(F.col("place") <= k)
    n = d.groupBy(*keys, "qid", "label", "tlabel").agg(F.count("*").alias("n"))
    p = n.groupBy(*keys, "qid", "label").agg(F.max_by("tlabel", F.struct("n", -F.col("tlabel"))).alias("pred"))
    return p.groupBy(*(F.col(f"w_{c}").alias(c) for c in names)).agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("pred")).cast("long")).alias("correct"))


def k_sweep(ranked_votes: DataFrame, ks: list[int], vote_k: int = 3) -> DataFrame:
    """(k, n, correct): candidates cut by votes at each k, ranked by score within, majority of the first vote_k."""
    d = ranked_votes.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).filter("rank <= k")
    d = d.withColumn("p", F.row_number().over(W.partitionBy("k", "qid").orderBy(F.desc("combined"), F.desc("votes"), "tid"))).filter(F.col("p") <= vote_k)
    n = d.groupBy("k", "qid", "label", "tlabel").agg(F.count("*").alias("n"))
    p = n.groupBy("k", "qid", "label").agg(F.max_by("tlabel", F.struct("n", -F.col("tlabel"))).alias("pred"))
    return p.groupBy("k").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("pred")).cast("long")).alias("correct"))


def error_profile(preds: DataFrame, values: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, wrong_n, wrong_sum, right_n, right_sum) of per-query values for wrong and right answers."""
    j = preds.join(values, "qid").withColumn("ok", F.col("label") == F.col("pred"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("long").alias("v")) for c in cols))).alias("f")
    part = lambda ok: F.col("ok") if ok else ~F.col("ok")
    return j.select("ok", pairs).groupBy("f.feature").agg(
        F.sum(part(False).cast("long")).alias("wrong_n"), F.sum(F.when(part(False), F.col("f.v")).otherwise(0)).alias("wrong_sum"),
        F.sum(part(True).cast("long")).alias("right_n"), F.sum(F.when(part(True), F.col("f.v")).otherwise(0)).alias("right_sum"),
    )


def effect_size(preds: DataFrame, values: DataFrame, col: str) -> DataFrame:
    """(d) to six digits: difference of the means of right and wrong answers over their pooled deviation."""
    j = preds.join(values, "qid").withColumn("ok", (F.col("label") == F.col("pred")).cast("int"))
    mean, var = lambda k: F.avg(F.when(F.col("ok") == k, F.col(col))), lambda k: F.var_pop(F.when(F.col("ok") == k, F.col(col)))
    return j.agg(F.round((mean(1) - mean(0)) / F.sqrt((var(1) + var(0)) / 2), 6).alias("d"))


def disagreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_ok, b_ok, n): how two systems' answers agree with the label."""
    j = a.join(b.select("qid", F.col("pred").alias("other")), "qid")
    return j.groupBy((F.col("pred") == F.col("label")).alias("a_ok"), (F.col("other") == F.col("label")).alias("b_ok")).agg(F.count("*").alias("n"))


def binomial_interval(acc: DataFrame, z: float = 1.96) -> DataFrame:
    """(n, correct, low, high): Wilson interval of the overall accuracy, six digits."""
    t = acc.agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))
    n, p = F.col("n"), F.col("correct") / F.col("n")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return t.select("n", "correct", F.round(mid - half, 6).alias("low"), F.round(mid + half, 6).alias("high"))
