"""Scoring of a stream of images with a fitted class-frequency cube (an extra; fitting is batch only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tritlake.functions.grid import Grid
from tritlake.operators import encode, vote


def score_stream(images: DataFrame, grid: Grid, hot: DataFrame, bg: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of (id, label, is_query, px) is classified and written as one Parquet folder of its own.

    A batch that is run again after a failure overwrites its folder, so each image is answered once.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        sigs = encode.block_signatures(batch.withColumn("is_query", F.lit(True)), grid)
        vote.argmax(vote.hot_scores(sigs, hot, bg), "score", keys=("qid", "label")).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return images.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
