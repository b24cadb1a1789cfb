"""A training-corpus pipeline over `documents`: each stage works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tritlake.llm.common import bounded_batches, cut_lineage, table
from tritlake.llm.decontaminate import decontaminate
from tritlake.llm.language_id import keep_identified
from tritlake.llm.mixing import mix_sources
from tritlake.llm.secret_scan import redact_secrets
from tritlake.llm.simhash import drop_near_duplicates


def _with_n_chars(docs: DataFrame) -> DataFrame:
    """n_chars follows the text; where there is no text it stays."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with confidence.

    Null, empty and letterless texts go; repeated rows and ties get equal answers; an empty table, or one without any declared
    language, keeps nothing. All columns stay, whatever their names.
    """
    bounded_batches(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates, the one with the smallest id.

    Null and empty texts are one group. Rows with a null id stay, and so do rows that repeat the kept id. An empty table stays
    empty. All columns stay, whatever their names.
    """
    bounded_batches(spark)
    return drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: the heavily hit ones go, the others lose the passages.

    Null and empty texts are not hit and stay as they are; repeated rows are treated alike; an empty table stays empty. All
    columns stay, whatever their names.
    """
    bounded_batches(spark)
    return _with_n_chars(decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted.

    Null and empty texts stay as they are; repeated rows are treated alike; an empty table stays empty. All columns stay,
    whatever their names.
    """
    bounded_batches(spark)
    return _with_n_chars(redact_secrets(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, target (their source's words), taken (words) and epochs (taken / size; a part of
    the last one where the budget ends within the document).

    Null and empty texts and others without words are not taken. Each of several equal rows is taken for its own share, so that
    a source's words add up to its target. An empty table stays empty. All columns stay; where the input has a column size,
    target, taken or epochs, the mix's own is called mix_size and so on.
    """
    bounded_batches(spark)
    names = list(docs.columns)
    for own in ("size", "target", "taken", "epochs"):
        while own in names:
            own = f"mix_{own}"
        names.append(own)
    d = mix_sources(docs, keep=True).filter("__taken > 0")
    values = [*(F.col(f"`{c}`") for c in docs.columns), F.col("__size"), F.col("__target"), F.col("__taken"), F.col("__taken") / F.col("__size")]
    return d.select(*(v.alias(n) for v, n in zip(values, names, strict=True)))


#: In this order: operators 8, 3, 7, 10 and 9.
STAGES = [("language_id", language), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", benchmark_leaks), ("secret_scan", secrets), ("mix_sources", mix)]

#: SQL can't express the models and automata of the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is kept in the shared checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
