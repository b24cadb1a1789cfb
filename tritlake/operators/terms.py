"""More similarities of candidates (qid, tid, ...) and scores that add them to the ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tritlake.functions import arrays as A
from tritlake.functions import grid as G
from tritlake.functions import shape as S
from tritlake.functions.grid import Grid

from .score import ranked


def textured(described: DataFrame, grid: Grid, collar: tuple[int, int]) -> DataFrame:
    """Adds pattern, energy and orientation counts, Haar bands of the rows `collar`, asymmetry, contrast and gradient maps."""
    px, hg, vg = F.col("px"), F.col("hg"), F.col("vg")
    return described.withColumns({
        "lbp": S.counts_of(grid.local_pattern(px)), "haar": S.sums_of(grid.cell_energy(px)), "goh": S.counts_of(grid.orientation(hg, vg)),
        "bands": S.haar_bands(grid, px, *collar), "symm": grid.symmetry(px), "glcm": grid.contrast(px),
        "gm": S.counts_of(grid.gradient_map(hg, vg)), "gmt": S.counts_of(grid.state_steps(hg, vg)),
    })


def with_sides(candidates: DataFrame, table: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """The candidates with q_ and t_ columns of both images."""
    side = lambda key, p: table.select(F.col("id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    return candidates.join(side("tid", "t"), "tid").join(side("qid", "q"), "qid")


def texture_similarities(candidates: DataFrame, table: DataFrame) -> DataFrame:
    """Adds lbp_sim, haar_sim, goh_sim, cwht_sim, symm_sim, glcm_sim, gm_sim and gmt_sim: negative distances."""
    maps = {"lbp": "lbp_sim", "haar": "haar_sim", "goh": "goh_sim", "gm": "gm_sim", "gmt": "gmt_sim"}
    d = with_sides(candidates, table, (*maps, "bands", "symm", "glcm"))
    q, t = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"t_{c}"))
    sims = {name: -S.map_l1(q(c), t(c)) for c, name in maps.items()}
    sims |= {"cwht_sim": -A.sad(q("bands"), t("bands")), "symm_sim": -F.abs(q("symm") - t("symm")), "glcm_sim": -A.sad(q("glcm"), t("glcm"))}
    return d.select(*candidates.columns, *(v.cast("long").alias(k) for k, v in sims.items()))


def scored(candidates: DataFrame, weights: dict[str, int], scale: int = 50) -> DataFrame:
    """Ranks by 256 dot_px + 192 dot_vg + the similarities at their weights, damped by the spread (column mad)."""
    out = F.col("dot_px") * 256 + F.col("dot_vg") * 192
    for name, w in weights.items():
        out = out + A.div(F.lit(scale * w).cast("long"), F.lit(scale) + F.col("mad")) * F.col(name)
    return ranked(candidates.withColumn("combined", out.cast("long")))


def delta_similarities(candidates: DataFrame, hist: DataFrame, states: DataFrame, bins: int = 45) -> DataFrame:
    """(qid, tid, raw, matches) against the ground state of the candidate's label.

    raw is the negative distance of the deviations, in which the means cancel; matches counts bins whose deviations, beyond
    the spread or within it, have the same sign. hist: (id, bin, n), all bins; states: (label, bin, mean, dev).
    """
    arrays = hist.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda c: c["n"]).alias("h"))
    state = states.groupBy(F.col("label").alias("tlabel")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mean", "dev"))), lambda c: F.struct(c["mean"].alias("m"), c["dev"].alias("s"))).alias("g"))
    d = with_sides(candidates.select("qid", "tid", "tlabel"), arrays, ("h",)).join(F.broadcast(state), "tlabel")
    trit = lambda v, g: F.when(v - g["m"] > g["s"], 1).when(v - g["m"] < -g["s"], -1).otherwise(0)
    signs = lambda h: F.zip_with(h, "g", trit)
    same = F.size(F.filter(F.zip_with(signs("q_h"), signs("t_h"), lambda a, b: a == b), lambda e: e))
    return d.select("qid", "tid", (-A.sad(F.col("q_h"), F.col("t_h"))).alias("raw"), same.alias("matches"))


def digit_dot(candidates: DataFrame, images: DataFrame, planes: tuple[int, ...] = (27, 9, 3, 1)) -> DataFrame:
    """(qid, tid, dot) of balanced ternary digits: the planes' dot products at their weights; 0 leaves a plane out."""
    table = images.select("id", G.balanced_digits(F.col("px")).alias("d"))
    d = with_sides(candidates.select("qid", "tid"), table, ("d",))
    each = lambda a, b: sum(((a[f"d{3 - k}"] * b[f"d{3 - k}"] * w).cast("long") for k, w in enumerate(planes) if w), F.lit(0).cast("long"))
    return d.select("qid", "tid", A.total(F.zip_with("q_d", "t_d", each)).alias("dot"))


def low_rows(a: Column, side: int, keep: int) -> Column:
    """The first `keep` values of the first `keep` rows of a square."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda y: F.slice(a, y * side + 1, F.lit(keep))))


def spectral_dot(candidates: DataFrame, spectra: DataFrame, side: int, keep: int) -> DataFrame:
    """(qid, tid, dot) over the low corner of keep x keep coefficients (id, coefs); with all of them side^2 times the plain dot."""
    table = spectra.select("id", low_rows(F.col("coefs"), side, keep).alias("c"))
    d = with_sides(candidates.select("qid", "tid"), table, ("c",))
    return d.select("qid", "tid", A.dot(F.col("q_c"), F.col("t_c")).alias("dot"))


def divergence_variants(candidates: DataFrame, described: DataFrame, bounds: DataFrame, zone: int) -> DataFrame:
    """(qid, tid, dead, bucket): with differences up to `zone` free (2 rows for the mean row), and by buckets of ns.

    bounds: (bucket, bound), the quantile bounds of the training images' ns; a value is in the bucket of the bounds it reaches.
    """
    d = with_sides(candidates.select("qid", "tid"), described, ("ns", "cy"))
    every = bounds.agg(F.sort_array(F.collect_list("bound")).alias("bounds"))
    d = d.join(F.broadcast(every))
    qn, qc, tn, tc = (F.col(c) for c in ("q_ns", "q_cy", "t_ns", "t_cy"))
    rows = F.when((qc >= 0) & (tc >= 0), F.greatest(F.lit(0), F.abs(qc - tc) - 2) * 2).when((qc < 0) != (tc < 0), 10).otherwise(0)
    of = lambda v: F.size(F.filter("bounds", lambda b: v >= b))
    return d.select("qid", "tid", (-F.greatest(F.lit(0), F.abs(qn - tn) - zone) - rows).cast("int").alias("dead"), (-F.abs(of(qn) - of(tn))).alias("bucket"))
