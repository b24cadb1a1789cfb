"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most rows and bytes that a Python worker gets at a time; a longer text makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 24


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, which bounds the workers' memory; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        digits = "".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-")
        if not 0 < int(digits or 0) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark's own reader so that any store works."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder the session names. A local session without one gets a temporary folder; on a cluster
    that is an error, as executors do not see the driver's disk."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return df.checkpoint(eager=True)


#: No key of a spread join gets much more than one in so many of the rows.
SPREAD = 1000


def spread_join(rows: DataFrame, on: str, one: DataFrame, counts: DataFrame, spread: int = SPREAD) -> DataFrame:
    """`rows` with the columns of `one`, which has a row for each value of the column `on`; others go.

    `counts` has (on, n): how many rows there are of a value. Values with over 1/spread of all, at most `spread` of them, are
    broadcast with the number of keys that their rows are dealt to, by a digest of the row; their row of `one` is repeated.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") * spread > total).select(F.col(on).alias("__hot"), F.ceil(F.col("n") * spread / F.lit(max(total, 1))).cast("int").alias("__keys"))
    hot = F.broadcast(hot)
    keys = F.coalesce(F.col("__keys"), F.lit(1))
    other = one.withColumnRenamed(on, "__on").join(hot, F.col("__on") == F.col("__hot"), "left").withColumn("__salt1", F.explode(F.sequence(F.lit(0), keys - 1))).drop("__hot", "__keys")
    dealt = rows.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), keys).cast("int")).drop("__hot", "__keys")
    return dealt.join(other, (F.col(on) == F.col("__on")) & (F.col("__salt") == F.col("__salt1"))).drop("__on", "__salt", "__salt1")


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that an operator reads, under names of its own; a null text is the empty text."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("__id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"),
        *(F.col(f"`{m}`") for m in more),
    )


def per_text(df: DataFrame, id_name: str, make: Callable[[], Callable[[str], tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """One output row per row of `df` (from id_and_text), the columns after the id made by a Python function.

    `make` runs once per task and gives the function of one text. Rows are handled one by one within an Arrow
    batch, so memory is bounded by a batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = batch.column(1)
            rows = [fn(texts[i].as_py() or "") for i in range(batch.num_rows)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(len(schema) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return df.mapInArrow(run, ddl).withColumnRenamed("__id", id_name)
