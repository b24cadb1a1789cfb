"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / quality, with u from a digest of its id, so reruns agree. Each source first gets its complete
epochs; the rest of its word budget goes to the smallest keys, in key order up to the budget. The order within
a source is cut into fixed slices of the key, so that no task holds a whole source: slices are pre-summed, the slices'
sums are prefix-summed per source, and documents are ranked only within their slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text, table

#: Weights of the sources by code point order, repeating; the share of all words that the mix takes; most epochs of a source.
WEIGHTS, SHARE, MOST_EPOCHS = (5.0, 2.0, 1.0), 1.5, 2.0
#: Slices of the key within a source.
SLICES = 4096
SEED = "mix-1"
#: Characters that lower a document's quality.
SIGNS = "0123456789!\"#$%&()*+,-./:;<=>?@[]^_{|}~"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def quality(text: Column) -> Column:
    """A weight from 0.25 to 1.25: the share of characters that are no digits or ASCII signs, plus a quarter.

    Letters of all scripts count alike.
    """
    n = F.length(text)
    good = F.length(F.translate(text, SIGNS, ""))
    return F.when(n > 0, F.lit(0.25) + good / n).otherwise(F.lit(0.25))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> with `target`: `share` of all words by weight, none above `most` times its source.

    Resharing the excess by weight until none is above ends at least(level * weight, cap), with one level that makes the
    sum right; with the sources ordered by cap / weight the level follows from running sums. One row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy()
    ws = F.array(*(F.lit(float(w)) for w in weights))
    d = sizes.withColumn("__k", F.row_number().over(order) - 1)
    d = d.withColumn("__w", F.element_at(ws, (F.col("__k") % len(weights) + 1).cast("int"))).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    run = W.orderBy((F.col("__cap") / F.col("__w")).asc(), "__k").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({"__full": F.coalesce(F.sum("__cap").over(run), F.lit(0.0)), "__used": F.coalesce(F.sum("__w").over(run), F.lit(0.0)), "__all_w": F.sum("__w").over(every), "__total": F.sum("source_size").over(every) * F.lit(float(share))})
    d = d.withColumn("__level", (F.col("__total") - F.col("__full")) / (F.col("__all_w") - F.col("__used")))
    # The level is right at the first source, in this order, that it leaves below its cap; if there is none, all are capped.
    fits = F.when(F.col("__level") * F.col("__w") < F.col("__cap"), F.struct((F.col("__cap") / F.col("__w")).alias("r"), F.col("__k").alias("k"), F.col("__level").alias("level")))
    d = d.withColumn("__at", F.min(fits).over(every)["level"])
    return d.select("source", "source_size", F.when(F.col("__at").isNull(), F.col("__cap")).otherwise(F.least(F.col("__at") * F.col("__w"), F.col("__cap"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, slices: int = SLICES, keep: bool = False) -> DataFrame:
    """Per row: id, size (words), source, source_size, target, taken (words the mix takes, repeats counted).

    With `keep` all columns of `docs` come first, as they are, and then __size, __target and __taken, so that rows which
    repeat each other each have their own share. Null and empty texts have size 0 and are taken as 0; a null source is a source of its own, last in order. Equal keys
    (repeated ids) are ordered by size; rows equal in both are interchangeable. Documents are taken whole, but for the one at
    the edge of a source's budget, of which the words up to the budget are taken: a source's sum is its rounded target.
    An empty table gives no rows; other columns are ignored; a very long text is one document.
    """
    own = [f"__c{i}" for i in range(len(docs.columns))] if keep else []
    if keep:
        names = docs.columns
        docs = docs.select(*(F.col(f"`{c}`").alias(o) for c, o in zip(names, own, strict=True)))
        id_col, text_col, source_col = (own[names.index(c)] for c in (id_col, text_col, source_col))
    d = id_and_text(docs, id_col, text_col, source_col, *(c for c in own if c != source_col))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("__id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(u) / quality(F.col("__text"))
    d = d.select("__id", word_count(F.col("__text")).alias("size"), F.col(f"`{source_col}`").cast("string").alias("source"), key.alias("__key"), *own, *([F.xxhash64("__text").alias("__digest")] if keep else []))
    d = d.withColumn("__slice", F.floor((1 - F.exp(-F.col("__key"))) * slices).cast("int"))
    if not keep:  # whole documents are too much to write once more
        d = cut_lineage(d)
    per_slice = cut_lineage(d.groupBy("source", "__slice").agg(F.sum("size").alias("__n")))
    targets = source_targets(per_slice.groupBy("source").agg(F.sum("__n").alias("source_size")), weights, share, most)
    # One row per source and slice: the words of the slices before.
    before = W.partitionBy("source").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    edges = per_slice.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("source", "__slice", "__before")
    plan = edges.alias("e").join(targets.alias("t"), F.col("e.source").eqNullSafe(F.col("t.source"))).select(
        F.coalesce(F.col("e.source"), F.lit("")).alias("__s"), F.col("e.source").isNull().alias("__sn"), F.col("e.__slice").alias("__b"), "__before", "source_size", "target"
    )
    within = W.partitionBy("__s", "__sn", "__slice").orderBy("__key", "__id", "size", *(["__digest"] if keep else [])).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({"__s": F.coalesce("source", F.lit("")), "__sn": F.col("source").isNull()})
    d = d.withColumn("__in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(plan, (d["__s"] == plan["__s"]) & (d["__sn"] == plan["__sn"]) & (d["__slice"] == plan["__b"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") + 0.5) - epochs * F.col("source_size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__before") - F.col("__in")))
    taken = (epochs * F.col("size") + more).cast("long")
    if keep:
        return d.select(*(F.col(o).alias(c) for c, o in zip(names, own, strict=True)), F.col("size").alias("__size"), F.col("target").alias("__target"), taken.alias("__taken"))
    return d.select(F.col("__id").alias(id_col), "size", "source", "source_size", "target", taken.alias("taken"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; odd rows as in mix_sources."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln(u) / CASE WHEN length(text) > 0 THEN 0.25 + CAST(length(translate(text, '""" + SIGNS + """', '')) AS DOUBLE) / length(text) ELSE 0.25 END AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM k GROUP BY source
), w AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM s
), r AS (
  SELECT *, coalesce(sum(cap) OVER p, 0) AS full_, coalesce(sum(w) OVER p, 0) AS used, sum(w) OVER () AS all_w, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total
  FROM w WINDOW p AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT *, (total - full_) / (all_w - used) AS level FROM r),
t AS (
  SELECT source, source_size, CASE WHEN at_ IS NULL THEN cap ELSE least(at_ * w, cap) END AS target
  FROM (SELECT l.*, (SELECT level FROM l WHERE level * w < cap ORDER BY cap / w, k LIMIT 1) AS at_ FROM l)
), x AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target + 0.5) - epochs * source_size - before)) AS BIGINT) AS taken
FROM x
"""
