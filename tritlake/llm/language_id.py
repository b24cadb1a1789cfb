"""Language ID by Bayesian evidence fusion.

Four kinds of evidence are added as log odds: the text's likelihood under hashed byte-trigram models, the declared
language through the measured reliability of declarations, the address suffix, and a prior of the host that is smoothed
towards its suffix, which is smoothed towards the whole corpus. The languages are all that are declared, counted over all rows;
the models are fitted on a bounded sample of distinct texts of each; the reliabilities and the priors are counts over all rows.

A text's declaration takes part in fitting, so texts are parted in two halves by a digest and each is judged by the models of
the other half: the reliability of declarations is measured on texts that the models have not seen. Only a language without a
text in the other half is judged by all of its texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

#: About the most distinct texts of a language that its model is fitted on; hashed trigrams; weight of a trigram's log likelihood.
SAMPLE_ROWS, BUCKETS, TEMPER = 2_000, 1 << 15, 0.05
#: Pseudo-counts of the corpus in a suffix, of the suffix in a host, and of declarations.
SUFFIX_WEIGHT, HOST_WEIGHT, DECLARED_WEIGHT = 50.0, 20.0, 5.0
#: A document is accepted from this posterior on.
ACCEPT = 0.8
#: No key of the join with the priors holds much more than one in so many of all rows: larger hosts are spread over several keys.
SPREAD = 1_000


def _trigrams(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))


def _language(declared: Column) -> Column:
    """The declared language without its region (de-AT, pt_BR), in lower case; null if there is none."""
    name = F.lower(F.trim(F.split(declared.cast("string"), "[-_]", 2)[0]))
    return F.when(name != "", name)


def _half(text: Column) -> Column:
    return F.pmod(F.xxhash64(text.cast("string"), F.lit(17)), F.lit(2)).cast("int")


def fit_counts(docs: DataFrame, text: Column, declared: Column, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, counts[half, trigram, language]) from about `sample_rows` distinct texts of each language at most, the least by digest.

    All languages that are declared of a text are there. The driver gets one count per language, half and bucket.
    """
    rows = docs.select(_language(declared).alias("l"), text.cast("string").alias("t")).filter("l is not null and t is not null")
    rows = rows.withColumn("h", F.xxhash64("t", F.lit(17)))
    sizes = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("texts")).collect()
    if not sizes:
        return [], np.zeros((2, BUCKETS, 0))
    # Digests are uniform: about `sample_rows` distinct texts of a language lie below its bound, and all of a language with fewer.
    bounds = [(r["l"], int(-(2**63) + 2**64 * sample_rows / r["texts"])) for r in sizes if r["texts"] > sample_rows]
    if bounds:
        bound = F.create_map(*(F.lit(x) for pair in bounds for x in pair))
        rows = rows.filter(F.coalesce(F.col("h") <= F.try_element_at(bound, F.col("l")), F.lit(True)))
    rows = rows.dropDuplicates(["l", "h"])

    def count(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for lang, half, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = sums.setdefault((lang, half), np.zeros(BUCKETS, np.int32))
                own += np.bincount(_trigrams(t.as_py()), minlength=BUCKETS)
        for (lang, half), n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([half] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["l", "half", "k", "n"])

    got = rows.select("l", _half(F.col("t")).alias("half"), "t").mapInArrow(count, "l string, half int, k long, n long").groupBy("l", "half", "k").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(r["l"] for r in sizes)
    counts = np.zeros((2, BUCKETS, len(langs)))
    place = {lang: j for j, lang in enumerate(langs)}
    counts[got["half"].to_numpy(int), got["k"].to_numpy(int), got["l"].map(place).to_numpy(int)] = got["n"].to_numpy()
    return langs, counts


def _log_shares(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts + 0.5).sum(axis=0, keepdims=True))


def fit_models(docs: DataFrame, text: Column, declared: Column, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log P(trigram | language)) of both halves of the texts."""
    langs, counts = fit_counts(docs, text, declared, sample_rows)
    return langs, _log_shares(counts.sum(axis=0))


def judging_models(counts: np.ndarray) -> np.ndarray:
    """log P(trigram | language) by which the texts of each half are judged: of the other half, or of both where it has none."""
    both = counts.sum(axis=0)
    return np.stack([_log_shares(np.where(counts[1 - half].sum(axis=0, keepdims=True) > 0, counts[1 - half], both)) for half in (0, 1)])


def _host_parts(url: Column) -> tuple[Column, Column]:
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host), F.when(host != "", F.regexp_extract(host, "([^.]+)$", 1))


def identify(docs: DataFrame, text: Column, declared: Column, host: Column, suffix: Column, sample_rows: int = SAMPLE_ROWS, prefix: str = "__") -> DataFrame:
    """The rows of `docs` with four columns more: {prefix}lang, {prefix}confidence, {prefix}text_lang, {prefix}accepted.

    Null, empty or very short texts and texts without a letter have no text evidence: they are not accepted. A null
    declaration, host or suffix adds nothing. Without any declared row, as in an empty table, there is no language: lang is
    null, nothing is accepted. Very long texts are summed in parts. Models take 256 KB for each declared language. Ties go to the language first by code point. Repeated rows get equal answers. The host table is joined by
    size: broadcast only when Spark's own threshold allows it.
    """
    langs, counts = fit_counts(docs, text, declared, sample_rows)
    n, spark = len(langs), docs.sparkSession
    if not n:
        return docs.withColumns({f"{prefix}lang": F.lit(None).cast("string"), f"{prefix}confidence": F.lit(0.0), f"{prefix}text_lang": F.lit(None).cast("string"), f"{prefix}accepted": F.lit(False)})
    shared = spark.sparkContext.broadcast(judging_models(counts).astype(np.float32))

    @F.pandas_udf("array<double>")
    def likelihood(texts: pd.Series, halves: pd.Series) -> pd.Series:
        models, out = shared.value, []
        for t, half in zip(texts, halves, strict=True):
            ll = np.zeros(models.shape[2])
            if t:
                k = _trigrams(t)
                for i in range(0, len(k), 1 << 16):
                    ll += models[half][k[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
            out.append((ll - ll.max()).round(6) * TEMPER)
        return pd.Series(out)

    has_text = F.coalesce(text.rlike("\\p{L}") & (F.length(text) >= 3), F.lit(False))
    known = F.array(*(F.lit(x) for x in langs))
    said = F.array_position(known, _language(declared))
    d = docs.withColumns({"__ll": likelihood(text, F.coalesce(_half(text), F.lit(0))), "__has": has_text, "__decl": F.when(said > 0, said.cast("int")), "__host": host, "__suffix": suffix})
    best = F.when(F.col("__has"), F.array_position(F.col("__ll"), F.array_max("__ll")).cast("int"))
    # Counts over all rows: one pass, grouped by everything that the priors and reliabilities need; languages by number, from 1.
    cells = cut_lineage(d.select(best.alias("best"), "__decl", "__host", "__suffix").groupBy("__host", "__suffix", "__decl", "best").agg(F.count("*").alias("rows")))
    seen = cells.filter("best is not null")
    given = np.zeros((n + 1, n))
    for r in seen.groupBy("__decl", "best").agg(F.sum("rows").alias("rows")).collect():
        given[r["__decl"] or 0, r["best"] - 1] = r["rows"]
    total = given.sum(axis=0)
    overall = (total + 1) / (total.sum() + n)
    # log P(declared | language), smoothed towards the declaration's share
    by_declared = given[1:]
    share = by_declared.sum(axis=1, keepdims=True) / max(1.0, by_declared.sum())
    says = np.log((by_declared + DECLARED_WEIGHT * share + 1e-12) / (by_declared.sum(axis=0, keepdims=True) + DECLARED_WEIGHT))
    arr = lambda v: F.array(*(F.lit(float(x)) for x in v))
    # One row for each declared language that was seen; another declaration says nothing.
    rows = [(k + 1, [float(x) for x in says[k]]) for k in range(n) if by_declared[k].sum()]
    d = d.join(F.broadcast(spark.createDataFrame(rows, "__d1 int, __says array<double>")), F.col("__decl") == F.col("__d1"), "left")
    declared_ll = F.coalesce("__says", arr([0.0] * n))

    def dense(counted: DataFrame, keys: list[str], name: str) -> DataFrame:
        g = counted.groupBy(*keys, "best").agg(F.sum("rows").cast("double").alias("rows")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "rows"))).alias("m"))
        return g.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias(name))

    hosts, suffixes = dense(seen, ["__suffix", "__host"], "hc"), dense(seen, ["__suffix"], "sc")
    up = lambda own, above, weight: F.zip_with(own, above, lambda c, p: (c + p * F.lit(weight)) / (F.aggregate(own, F.lit(0.0), lambda a, x: a + x) + F.lit(weight)))
    suffixes = suffixes.select(F.col("__suffix").alias("__s2"), F.when(F.col("__suffix").isNull(), arr(overall)).otherwise(up(F.col("sc"), arr(overall), SUFFIX_WEIGHT)).alias("__sp"))
    priors = hosts.join(suffixes, F.col("__suffix").eqNullSafe(F.col("__s2")))
    priors = priors.select(F.col("__host").alias("__h1"), F.col("__suffix").alias("__s1"), F.when(F.col("__host").isNull(), F.col("__sp")).otherwise(up(F.col("hc"), F.col("__sp"), HOST_WEIGHT)).alias("__prior"))
    key = lambda h, s: F.concat_ws("\u0001", F.coalesce(h, F.lit("\u0002")), F.coalesce(s, F.lit("\u0002")))
    # A host may hold a third of all rows. Those with over 1/SPREAD of them, so at most SPREAD hosts, are broadcast with the
    # number of keys that their rows are spread over; only their priors are repeated.
    all_rows = cells.agg(F.sum("rows")).first()[0] or 0
    hot = cells.groupBy(key(F.col("__host"), F.col("__suffix")).alias("__hot")).agg(F.sum("rows").alias("rows")).filter(F.col("rows") * SPREAD > all_rows)
    hot = F.broadcast(hot.select("__hot", F.ceil(F.col("rows") * SPREAD / F.lit(max(all_rows, 1))).cast("int").alias("__keys")))
    keys = F.coalesce(F.col("__keys"), F.lit(1))
    priors = priors.select(key(F.col("__h1"), F.col("__s1")).alias("__k1"), "__prior").join(hot, F.col("__k1") == F.col("__hot"), "left")
    priors = priors.select("__k1", "__prior", F.explode(F.sequence(F.lit(0), keys - 1)).alias("__salt1"))
    hashable = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    d = d.withColumn("__k", key(F.col("__host"), F.col("__suffix"))).join(hot, F.col("__k") == F.col("__hot"), "left")
    d = d.withColumn("__salt", F.pmod(F.xxhash64(*hashable), keys).cast("int"))
    d = d.join(priors, (F.col("__k") == F.col("__k1")) & (F.col("__salt") == F.col("__salt1")), "left")
    prior = F.coalesce(F.col("__prior"), arr(overall))
    score = F.zip_with(F.zip_with(F.when(F.col("__has"), F.col("__ll")).otherwise(arr([0.0] * n)), declared_ll, lambda a, b: a + b), prior, lambda a, p: a + F.log(p))
    d = d.withColumn("__score", score)
    top = F.array_max("__score")
    conf = F.lit(1.0) / F.aggregate("__score", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    d = d.withColumns({
        f"{prefix}lang": F.element_at(known, F.array_position(F.col("__score"), top).cast("int")),
        f"{prefix}confidence": F.round(conf, 6),
        f"{prefix}text_lang": F.when(F.col("__has"), F.element_at(known, F.array_position(F.col("__ll"), F.array_max("__ll")).cast("int"))),
    }).withColumn(f"{prefix}accepted", F.col("__has") & (F.col(f"{prefix}confidence") >= ACCEPT))
    extra = [f"{prefix}{x}" for x in ("lang", "confidence", "text_lang", "accepted")]
    return d.select(*(F.col(f"`{c}`") for c in docs.columns), *extra)


def _of_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Documents carry no address: their source takes the host's place."""
    return identify(docs, F.col("text"), F.col("lang"), F.col("source"), F.lit(None).cast("string"), sample_rows)


def _of_pages(pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Pages (page_id, url, html): the declaration is the html element's lang, host and suffix come from the url."""
    host, suffix = _host_parts(F.col("url"))
    said = F.regexp_extract(F.col("html"), "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([A-Za-z]+)", 1)
    plain = F.regexp_replace(F.regexp_replace(F.col("html"), "(?is)<(script|style)\\b.*?</\\1\\s*>", " "), "<[^>]*>", " ")
    d = pages.withColumns({"__plain": plain, "__said": F.when(said != "", said)})
    return identify(d, F.col("__plain"), F.col("__said"), host, suffix, sample_rows)


def identify_pages(pages: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per page: page_id, url, lang, confidence, accepted."""
    out = _of_pages(pages, sample_rows)
    return out.select("page_id", "url", F.col("__lang").alias("lang"), F.col("__confidence").alias("confidence"), F.col("__accepted").alias("accepted"))


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows and columns of documents whose language is identified with confidence; the others go."""
    return _of_documents(docs, sample_rows).filter("__accepted").select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (page_id is null), then all pages (doc_id is null), each table with models, reliabilities and priors of its own."""
    said = lambda d, doc, page, declared: d.select(F.expr(doc).alias("doc_id"), F.expr(page).alias("page_id"), F.col(declared).alias("declared"), F.col("__lang").alias("lang"), F.col("__text_lang").alias("text_lang"), F.col("__confidence").alias("confidence"), F.col("__accepted").alias("accepted"))
    documents = said(_of_documents(table(spark, sf_dir, "documents")), "doc_id", "cast(null as bigint)", "lang")
    pages = said(_of_pages(table(spark, sf_dir, "pages")), "cast(null as bigint)", "page_id", "__said")
    return documents.union(pages)
