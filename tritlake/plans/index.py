"""Index.fit(images).retrieve(k).score(weights).vote(k): the retrieval pipeline as a lazy, fluent plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tritlake.functions import grid as G
from tritlake.functions.grid import Grid
from tritlake.functions.lineage import kept
from tritlake.operators import encode, features, retrieve, score, train, vote
from tritlake.operators.score import Weights


@dataclass(frozen=True)
class Candidates:
    index: Index
    top: DataFrame

    def score(self, weights: Weights = Weights()) -> Ranked:
        f = score.base_features(self.top, self.index.described)
        return Ranked(score.combined(f, weights))


@dataclass(frozen=True)
class Ranked:
    rows: DataFrame

    def vote(self, k: int = 3) -> DataFrame:
        return vote.knn(self.rows, k)

    def bayes(self, decay: int = 2, first: int = 15, topo: int = 100) -> DataFrame:
        return vote.bayes_sequential(self.rows, decay, first, topo)


@dataclass(frozen=True)
class Index:
    """A fitted index: signatures, background, weights and postings; queries are the rows of the images with is_query."""

    images: DataFrame
    grid: Grid
    sigs: DataFrame
    bg: DataFrame
    hot: DataFrame
    ig: DataFrame
    probe: str = "adjacent"
    quantizer: Callable[[Column], Column] = G.ternary
    channels: tuple[str, ...] = ("px", "hg", "vg")
    joint: bool = False
    #: (id, label, is_query, c_<channel> ...): the codes of all rows, kept.
    arrays: DataFrame | None = None

    @classmethod
    def fit(cls, images: DataFrame, grid: Grid, quantizer=G.ternary, probe: str = "adjacent", channels: tuple[str, ...] = ("px", "hg", "vg"), joint: bool = False) -> Index:
        """Reads the images once, for their codes, which are kept; the cube comes from them, background and weights from the cube.

        These are kept too: probes and votes read them several times, and a plan that makes them anew each time takes much of
        the driver's memory.
        """
        names = ("joint",) if joint else channels
        coded = encode.joint_arrays(images, grid) if joint else encode.with_codes(images, grid, quantizer)
        arrays = kept(coded.select("id", "label", "is_query", *(f"c_{c}" for c in names)))
        sigs = encode.exploded(arrays, {c: F.col(f"c_{c}") for c in names})
        hot = kept(train.hot_map(sigs))
        bg = kept(train.background_of(hot))
        return cls(images, grid, sigs, bg, hot, kept(train.gain(hot, bg)), probe, quantizer, channels, joint, arrays)

    @property
    def described(self) -> DataFrame:
        return features.described(self.images, self.grid)

    @property
    def probes(self) -> DataFrame:
        nbr = None if self.probe == "none" else encode.neighbours(self.images.sparkSession, self.probe)
        return retrieve.probes(self.sigs, self.ig, self.bg, nbr)

    def votes(self) -> DataFrame:
        """All pairs with a vote, by the inverted index: a join on (channel, position, value)."""
        return retrieve.votes(self.probes, train.postings(self.sigs, self.bg))

    @property
    def names(self) -> tuple[str, ...]:
        return ("joint",) if self.joint else self.channels

    @property
    def codes(self) -> DataFrame:
        """(tid, tlabel, codes) of the training rows, channel by channel."""
        return self.arrays.filter("not is_query").select(F.col("id").alias("tid"), F.col("label").alias("tlabel"), F.concat(*(F.col(f"c_{c}") for c in self.names)).alias("codes"))

    def kernel(self, k: int | None = None, probes: DataFrame | None = None, **how) -> DataFrame:
        """The same votes without a shuffle of the training rows, also for other probes; with k only the best k of each query."""
        positions = self.grid.h * self.grid.strips
        slots = {c: j * positions for j, c in enumerate(self.names)}
        return retrieve.kernel_votes(self.codes, self.probes if probes is None else probes, slots, positions * len(self.names), 256 if self.joint else 27, k, **how)

    def bags(self, masks: DataFrame, n: int, k: int | None = None) -> DataFrame:
        """(bag, qid, tid, tlabel, votes) by the positions of each of the n bags (bag, pos) alone; with k the best k of each bag."""
        votes = [self.kernel(k, self.probes.join(F.broadcast(masks.filter(F.col("bag") == b)), "pos")).withColumn("bag", F.lit(b)) for b in range(n)]
        return reduce(DataFrame.unionByName, votes)

    def retrieve(self, k: int = 200, mode: str = "exact") -> Candidates:
        return Candidates(self, self.kernel(k) if mode == "exact" else retrieve.top_threshold_id(self.kernel(), k))


def eyes_kernel(eyes: list[Index], k: int | None = None) -> DataFrame:
    """`kernel` over the summed votes of several indexes of the same images: the channels of each stand beside the others'."""
    size, slots, probes = eyes[0].grid.h * eyes[0].grid.strips, {}, []
    for j, e in enumerate(eyes):
        slots |= {f"{j}|{c}": (len(slots) + n) * size for n, c in enumerate(e.names)}
        probes.append(e.probes.withColumn("channel", F.concat_ws("|", F.lit(j), "channel")))
    t = eyes[0].images.filter("not is_query")
    for j, e in enumerate(eyes):
        t = encode.with_codes(t, e.grid, e.quantizer)
        t = t.withColumn(f"codes{j}", F.concat(*(F.col(f"c_{c}") for c in e.names)))
    codes = t.select(F.col("id").alias("tid"), F.col("label").alias("tlabel"), F.concat(*(F.col(f"codes{j}") for j in range(len(eyes)))).alias("codes"))
    return retrieve.kernel_votes(codes, reduce(DataFrame.unionByName, probes), slots, len(slots) * size, 27, k)
