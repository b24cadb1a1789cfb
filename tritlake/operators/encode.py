"""Signatures: (id, label, is_query, channel, pos, val) from images; dimension tables of neighbouring codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tritlake.functions import grid as G
from tritlake.functions import shape
from tritlake.functions.grid import Grid


def planes(images: DataFrame, grid: Grid, quantizer=G.ternary) -> DataFrame:
    """Adds t, hg, vg: the quantized pixels and their gradients."""
    d = images.withColumn("t", quantizer(F.col("px")))
    h, v = grid.gradients(F.col("t"))
    return d.withColumns({"hg": h, "vg": v})


def exploded(d: DataFrame, channels: dict[str, Column], keys: tuple[str, ...] = ("id", "label", "is_query")) -> DataFrame:
    """One row for each channel, position and value of the channels' arrays."""
    named = F.array(*(F.struct(F.lit(c).alias("channel"), a.alias("codes")) for c, a in channels.items()))
    d = d.select(*keys, F.explode(named).alias("c"))
    return d.select(*keys, F.col("c.channel").alias("channel"), F.posexplode("c.codes").alias("pos", "val"))


def block_signatures(images: DataFrame, grid: Grid, quantizer=G.ternary) -> DataFrame:
    """Block codes of the channels px, hg and vg."""
    d = planes(images, grid, quantizer)
    return exploded(d, {"px": grid.block_codes(F.col("t")), "hg": grid.block_codes(F.col("hg")), "vg": grid.block_codes(F.col("vg"))})


def with_codes(images: DataFrame, grid: Grid, quantizer=G.ternary) -> DataFrame:
    d = planes(images, grid, quantizer)
    return d.withColumns({f"c_{c}": grid.block_codes(F.col(a)) for c, a in (("px", "t"), ("hg", "hg"), ("vg", "vg"))})


def transition_signatures(images: DataFrame, grid: Grid) -> DataFrame:
    """Transitions of the pixel channel: channels ht and vt."""
    d = with_codes(images, grid)
    right, below = grid.transitions(F.col("c_px"))
    return exploded(d, {"ht": right, "vt": below})


def joint_arrays(images: DataFrame, grid: Grid, kind: str = "d") -> DataFrame:
    """Adds c_joint: one byte for each position."""
    d = with_codes(images, grid)
    return d.withColumn("c_joint", grid.joint_codes(F.col("c_px"), F.col("c_hg"), F.col("c_vg"), kind))


def joint_signatures(images: DataFrame, grid: Grid, kind: str = "d") -> DataFrame:
    """One byte for each position: channel `joint`."""
    return exploded(joint_arrays(images, grid, kind), {"joint": F.col("c_joint")})


def colour_gradient_signatures(images: DataFrame, grid: Grid, planes_: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Block codes of the ternary gradients of each colour plane: channels r_h, r_v and so on.

    The ternary planes and their gradients are columns of their own, as each cell of a code would make its array anew.
    """
    d = images.withColumns({f"t_{c}": G.ternary(F.col(c)) for c in planes_})
    d = d.withColumns({f"g_{c}_{k}": g for c in planes_ for k, g in zip("hv", grid.gradients(F.col(f"t_{c}")), strict=True)})
    return exploded(d, {f"{c}_{k}": grid.block_codes(F.col(f"g_{c}_{k}")) for c in planes_ for k in "hv"})


def pentary_signatures(images: DataFrame, grid: Grid, length: int = 3) -> DataFrame:
    d = images.withColumn("t", G.pentary(F.col("px")))
    return exploded(d, {"pent": grid.block_codes(F.col("t"), base=5, length=length)})


def neighbours(spark: SparkSession, kind: str, symbols: int = 3, length: int = 3) -> DataFrame:
    """(val, nval) of the codes next to each code: `adjacent` one symbol by one step, `hamming1` one symbol by any,
    `bitflip` one of eight bits, `none` nothing. At most 256 codes."""
    if kind == "bitflip":
        return spark.range(256).select(F.col("id").cast("int").alias("val"), F.explode(F.array(*(F.lit(1 << k) for k in range(8)))).alias("m")).select("val", F.col("val").bitwiseXOR(F.col("m")).alias("nval"))
    n = symbols**length
    pairs = spark.range(n).select(F.col("id").cast("int").alias("val"))
    if kind == "none":
        return pairs.select("val", F.col("val").alias("nval")).limit(0)
    moves = []
    for j in range(length):
        w = symbols**j
        digit = F.floor(F.col("val") / w).cast("int") % symbols
        for step in range(1 - symbols, symbols):
            if step and (kind == "hamming1" or abs(step) == 1):
                moves.append(F.when((digit + step >= 0) & (digit + step < symbols), F.col("val") + step * w))
    return pairs.select("val", F.explode(F.array(*moves)).alias("nval")).filter("nval is not null")


def projections(spark: SparkSession, n: int, bits: int = 64, seed: int = 42) -> DataFrame:
    """(bit, pos, w) with w in -1, 0, 1 from a digest of (seed, bit, pos): the hyperplanes of the hash index."""
    cells = spark.range(bits * n).select((F.col("id") / n).cast("int").alias("bit"), (F.col("id") % n).cast("int").alias("pos"))
    digest = F.md5(F.concat_ws("-", F.lit(seed), "bit", "pos"))
    return cells.withColumn("w", (F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % 3) - 1)


def hyperplane_hash(images: DataFrame, planes_: DataFrame) -> DataFrame:
    """(id, label, is_query, bits): bit b is set if the projection of px - 128 on plane b is positive."""
    cells = images.select("id", "label", "is_query", F.posexplode("px").alias("pos", "p"))
    sums = cells.join(planes_, "pos").groupBy("id", "label", "is_query", "bit").agg(F.sum((F.col("p") - 128) * F.col("w")).alias("s"))
    return sums.groupBy("id", "label", "is_query").agg(F.bit_or(F.when(F.col("s") > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).otherwise(F.lit(0).cast("long"))).alias("bits"))


def walsh_hadamard(images: DataFrame, side: int) -> DataFrame:
    """(id, u, coef) of `spectra`: a row for each coefficient."""
    return spectra(images, side).select("id", F.posexplode("coefs").alias("u", "coef")).withColumn("coef", F.col("coef").cast("long"))


def spectra(images: DataFrame, side: int) -> DataFrame:
    """The images with `coefs`: two-dimensional transform of the ternary plane; place = row * side + column. `side` is a power of
    two; the plane t has side x side cells (pad it first if it has fewer)."""
    return images.withColumn("coefs", shape.walsh(F.col("t"), side * side))


def bag_masks(spark: SparkSession, bags: int, positions: int, percent: int, seed: str = "bag") -> DataFrame:
    """(bag, pos): each position is in a bag with the given chance, by a digest of seed, bag and position."""
    d = spark.range(bags * positions).select((F.col("id") / positions).cast("int").alias("bag"), (F.col("id") % positions).cast("int").alias("pos"))
    return d.filter(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "bag", "pos")), 1, 4), 16, 10).cast("int") % 100 < percent)
