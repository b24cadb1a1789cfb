"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are dealt by masked bit patterns: the 64 bits form six blocks, and fingerprints that differ in at
most four bits agree in two blocks at least, so each of the fifteen pairs of blocks gives one key under which they meet.
Under a key the fingerprints are sorted by Gray rank and a tree is built over them, whose nodes hold the bits that all
below share (mask) and their values (pattern). A search walks the levels for all fingerprints at once and prunes a whole
node when the differences in its shared bits exceed the limit; a node whose bits vary within the limit is taken whole.
Each key gives only a spanning forest of its links; components come from alternating star contractions over edges.

A pattern under which very many fingerprints meet is not searched by one task: they are dealt again by patterns of finer
blocks of all bits, of which two that differ in at most four bits must share several too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text, per_text, spread_join, table

WORDS, LIMIT, SEED = 4, 4, 42
#: Blocks of bits at the first dealing and at those of patterns with more than GROUP fingerprints. With b blocks and LIMIT differences, b - LIMIT blocks agree.
BLOCKS, GROUP = (6, 7, 8, 9), 1 << 20
#: Children of an index node; rows of a search at a time.
FAN, SEARCH = 8, 1 << 14


def fingerprint(text: str) -> int:
    """Signed 64-bit SimHash of a text's word shingles; see find_near_duplicates for the rules."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    digest = xxhash.xxh64_intdigest
    counts, n, done = np.zeros(64, np.int64), max(1, len(words) - WORDS + 1), 0
    it = iter(shingles)
    while done < n:
        part = np.fromiter((digest(s, SEED) for _, s in zip(range(min(n - done, 1 << 16)), it, strict=False)), np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += len(part)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the sequence in which neighbours differ in one bit."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def _levels(fp: np.ndarray, group: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of the index from the leaves up: mask, pattern, first child, number of children, first leaf of each node.

    `group` is the key of each leaf, in order; a node covers FAN neighbours of one group.
    """
    n = len(fp)
    level = {"mask": np.full(n, ~np.uint64(0)), "pattern": fp, "group": group, "leaf": np.arange(n), "child": np.arange(n), "count": np.ones(n, np.int64)}
    out = [level]
    while True:
        g = level["group"]
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.append(starts, len(g)))
        if size.max() == 1:
            return out
        place = np.arange(len(g)) - np.repeat(starts, size)
        first = np.flatnonzero(place % FAN == 0)
        ones = np.bitwise_and.reduceat(level["pattern"] & level["mask"], first)
        zeros = np.bitwise_and.reduceat(~level["pattern"] & level["mask"], first)
        mask = ones | zeros
        level = {"mask": mask, "pattern": ones, "group": g[first], "leaf": level["leaf"][first], "child": first, "count": np.diff(np.append(first, len(g)))}
        out.append(level)


def links(fp: np.ndarray, group: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Edges (leaf numbers) that join exactly the fingerprints of a group that `limit` or fewer differences connect."""
    levels = _levels(fp, group)
    label = np.arange(len(fp))
    top = levels[-1]
    # Nodes whose bits vary within the limit are cliques: chain their leaves.
    size = np.diff(np.append(top["leaf"], len(fp)))
    covered = np.zeros(len(fp), bool)
    for lv in levels[:0:-1]:
        ends = np.append(lv["leaf"][1:], len(fp))
        whole = np.flatnonzero((np.bitwise_count(~lv["mask"]) <= limit) & ~covered[lv["leaf"]])
        for s, e in zip(lv["leaf"][whole], ends[whole], strict=True):
            label[s:e] = s
            covered[s:e] = True
    root_of = np.searchsorted(top["leaf"], np.arange(len(fp)), side="right") - 1
    for at in range(0, len(fp), SEARCH):
        q = np.arange(at, min(at + SEARCH, len(fp)))
        q = q[size[root_of[q]] > 1]
        node = root_of[q]
        us, vs = [], []
        for depth in range(len(levels) - 1, -1, -1):
            lv = levels[depth]
            keep = lv["leaf"][node] <= q  # a pair is found from its later leaf
            d = np.bitwise_count((fp[q] ^ lv["pattern"][node]) & lv["mask"][node])
            keep &= d <= limit
            q, node, d = q[keep], node[keep], d[keep]
            spread = np.bitwise_count(~lv["mask"][node])
            whole = d + spread <= limit
            us.append(q[whole])
            vs.append(lv["leaf"][node[whole]])
            q, node = q[~whole], node[~whole]
            if not len(q):
                break
            n = lv["count"][node]
            start = lv["child"][node]
            node = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            q = np.repeat(q, n)
        if us:
            _join(label, np.concatenate(us), np.concatenate(vs))
    label = _settled(label)
    far = np.flatnonzero(label != np.arange(len(fp)))
    return far, label[far]


def _settled(label: np.ndarray) -> np.ndarray:
    while True:
        nxt = label[label]
        if (nxt == label).all():
            return label
        label = nxt


def _join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite the classes of u and v; labels are smaller members of the same class."""
    while len(u):
        label[:] = _settled(label)
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _masks(limit: int, blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - limit)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(fps: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """Distinct fingerprints (column fp) -> edges (u, v) of a graph with the same components as all links of `limit` bits.

    A task holds at most `group` fingerprints of a pattern. Beyond, it gives them back, and they are dealt by finer patterns
    within the ones they share; at the finest any number is searched.
    """
    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, edges = fps.select("fp", F.lit(0).cast("long").alias("within")), None
    for round_, blocks in enumerate(BLOCKS):
        most = group if round_ + 1 < len(BLOCKS) else 1 << 62
        keys = F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(_masks(limit, blocks)))))
        dealt = left.select("fp", "within", keys.alias("k")).select("fp", F.xxhash64("within", "k.t", "k.key").alias("key"))
        found = dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda b, most=most: _searched(b, limit, most), "u long, v long, within long")
        if round_ + 1 < len(BLOCKS):
            found = cut_lineage(found)
        own = found.filter("v is not null").select("u", "v")
        edges = own if edges is None else edges.union(own)
        left = found.filter("v is null").select(F.col("u").alias("fp"), "within")
        if round_ + 1 < len(BLOCKS) and left.isEmpty():
            break
    return edges.distinct()


def _searched(batches: Iterator[pa.RecordBatch], limit: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (fp, key) in order of the key -> edges (u, v, null), and (fp, null, key) of keys with over `most` rows."""

    def emit(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        many = np.bincount(group)[group] > 1
        fp, group = fp[many].view(np.uint64), group[many]
        order = np.lexsort((gray_rank(fp), group))
        fp, group = fp[order], group[order]
        u, v = links(fp, group, limit) if len(fp) else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(fp[u].view(np.int64)), pa.array(fp[v].view(np.int64)), pa.nulls(len(u), pa.int64())], names=["u", "v", "within"])

    def back(fp: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(key)], names=["u", "v", "within"])

    held_fp, held_key = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        held_fp = np.concatenate((held_fp, batch.column(0).to_numpy(zero_copy_only=False)))
        held_key = np.concatenate((held_key, batch.column(1).to_numpy(zero_copy_only=False)))
        if len(held_fp) <= min(most, 1 << 18):
            continue
        # Hand over up to the last change of key; of an open key with too many rows give back what is there.
        last = int(np.searchsorted(held_key, held_key[-1]))
        if last:
            yield emit(held_fp[:last], held_key[:last])
            held_fp, held_key = held_fp[last:], held_key[last:]
        if len(held_fp) > most:
            yield back(held_fp, held_key)
            gone = held_key[-1]
            held_fp, held_key = held_fp[:0], held_key[:0]
            for batch in batches:  # the rest of that key
                fp, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                same = int(np.searchsorted(key, gone, "right"))
                if same:
                    yield back(fp[:same], key[:same])
                if same < len(key):
                    held_fp, held_key = fp[same:].copy(), key[same:].copy()
                    break
    if len(held_fp):
        yield emit(held_fp, held_key)


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs -> (node, root) for every node that has an edge; root is the component's smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each checkpointed, until the edges stay the same.
    """
    e = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


def find_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id that links reach).

    Null and empty texts have fingerprint zero and are linked like any other. Texts with fewer than four words count as one
    shingle. Equal fingerprints are one node of the graph, so exact copies add no edges; repeated rows give repeated rows. A
    null id never is a component's id unless all its ids are null. Extra columns are ignored, and an empty table gives no
    rows. Very long texts are hashed in parts.
    """
    schema = pa.schema([("__id", pa.int64()), ("fp", pa.int64())])
    rows = cut_lineage(per_text(id_and_text(docs, id_col, text_col), "__id", lambda: lambda t: (fingerprint(t),), schema, "__id long, fp long"))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("__id").alias("least"), F.count("*").alias("n")))
    roots = components(near_links(nodes.select("fp"), limit))
    labelled = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    labelled = cut_lineage(labelled)
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    # A component may hold a third of the fingerprints, and a fingerprint a third of the rows.
    named = spread_join(labelled.select("fp", "root"), "root", least.select("root", "component_id"), least.select("root", "n"))
    out = spread_join(rows, "fp", named.select("fp", "component_id"), nodes.select("fp", "n"))
    return out.select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs` with one document of each component: the one with the smallest id.

    Null and empty texts are near-duplicates of each other. Rows with a null id stay. Other columns stay whatever their names;
    an empty table stays empty. Of rows that repeat the kept id all stay. Components of only null ids stay whole.
    """
    found = find_near_duplicates(docs, id_col, text_col).filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(found, docs[id_col] == found["__gone"], "left_anti")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; odd rows as in find_near_duplicates."""
    return find_near_duplicates(table(spark, sf_dir, "documents"))
