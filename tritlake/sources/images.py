"""Images as DataFrames (id, label, is_query, px array<int>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tritlake.functions.grid import Grid

#: The grid on which a 64-dimensional vector is viewed.
VECTOR_GRID = Grid(8, 8)


def vector_pixels(vector: Column) -> Column:
    """Components scaled to 0..255 around 128; the product is exact in double precision."""
    return F.transform(vector, lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 768 + 128).cast("int"))))


def vectors_as_images(spark: SparkSession, sf_dir: str, every: int = 5) -> DataFrame:
    """`embeddings` as images; ids divisible by `every` are queries, the others the training set."""
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return d.select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % every == 0).alias("is_query"), vector_pixels(F.col("embedding")).alias("px"))


def vectors_as_colour(spark: SparkSession, sf_dir: str, turns: tuple[int, ...] = (0, 21, 42)) -> DataFrame:
    """The images with planes r, g and b: the same cells, begun at another place for each plane."""
    d = vectors_as_images(spark, sf_dir)
    turned = lambda n: F.concat(F.slice("px", n + 1, F.size("px") - n), F.slice("px", 1, n)) if n else F.col("px")
    return d.withColumns(dict(zip("rgb", map(turned, turns), strict=True)))


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """IDX files: (path, id, value array<int>), a row per item; a file of labels gives arrays of one.

    The header is big-endian: a magic whose last byte is the number of dimensions, the count, then the other dimensions.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                dims = int(raw[3])
                shape = [int.from_bytes(raw[4 + 4 * k : 8 + 4 * k].tobytes(), "big") for k in range(dims)]
                each = int(np.prod(shape[1:])) if dims > 1 else 1
                body = raw[4 + 4 * dims : 4 + 4 * dims + shape[0] * each]
                for at in range(0, shape[0], 4096):
                    part = body[at * each : (at + 4096) * each].astype(np.int32)
                    n = len(part) // each
                    values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each), pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(at, at + n, dtype=np.int64)), values], names=["path", "id", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, id long, value array<int>")


def idx_images(spark: SparkSession, images: str, labels: str, is_query: bool) -> DataFrame:
    """An image file joined with its label file by place."""
    px = read_idx(spark, images).select("id", F.col("value").alias("px"))
    lab = read_idx(spark, labels).select("id", F.get("value", F.lit(0)).alias("label"))
    return px.join(lab, "id").select("id", "label", F.lit(is_query).alias("is_query"), "px")


def read_records(spark: SparkSession, path: str, plane: int = 1024) -> DataFrame:
    """Records of a label byte and three colour planes: (path, id, label, r, g, b)."""
    size = 1 + 3 * plane

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8)
                rec = raw[: len(raw) // size * size].reshape(-1, size)
                for at in range(0, len(rec), 1024):
                    part = rec[at : at + 1024].astype(np.int32)
                    n = len(part)
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * plane)
                    planes = [pa.ListArray.from_arrays(ends, pa.array(part[:, 1 + k * plane : 1 + (k + 1) * plane].reshape(-1))) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(at, at + n, dtype=np.int64)), pa.array(part[:, 0]), *planes], names=["path", "id", "label", "r", "g", "b"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, id long, label int, r array<int>, g array<int>, b array<int>")


def grey(r: Column, g: Column, b: Column) -> Column:
    """(77 r + 150 g + 29 b) >> 8 of each pixel."""
    return F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: F.shiftright(p["r"] * 77 + p["g"] * 150 + p["b"] * 29, 8))


def interleaved(r: Column, g: Column, b: Column) -> Column:
    """One row of r, g, b of each pixel in turn."""
    return F.flatten(F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: F.array(p["r"], p["g"], p["b"])))


def folds(images: DataFrame, validation: int = 5000) -> DataFrame:
    """Adds `part` (validation below the given id, holdout from it on) and `fold` (parity of the id) of the queries."""
    return images.withColumns({"part": F.when(F.col("id") < validation, "validation").otherwise("holdout"), "fold": (F.col("id") % 2).cast("int")})


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
