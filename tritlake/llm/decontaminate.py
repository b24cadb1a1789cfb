"""Benchmark decontamination with a generalised suffix automaton of the benchmark's normalised words.

The automaton of a block of items is built on the driver and broadcast; a block holds at most BLOCK_WORDS words. With a
larger benchmark each block passes over the documents by itself and gives the hits of the texts that it hits, which are then
merged, so that no task holds more than one block. Documents are streamed: words map to the automaton's
alphabet, stretches whose neighbouring words follow each other in no item are skipped, and elsewhere the automaton
tracks the longest match that ends at each word. Where it reaches a window's length, the window is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, table

WINDOW = 10
#: Most words of items in one automaton: bounds what is broadcast (a few hundred bytes a word).
BLOCK_WORDS = 500_000
#: In the pipeline a document goes if one run of hit words is this long or this share of its words is hit; else its runs are cut out.
MAX_RUN, MAX_SHARE = 13, 0.2

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words after lower-casing A-Z: maximal runs of digits, letters a-z and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; `run` gives, for each word, the length of the longest match ending there."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        cur = self._state({}, length[last] + 1, 0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, step: dict[int, int], length: int, link: int) -> int:
        self.next.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        twin = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, symbols: list[int]) -> None:
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def run(self, symbols: list[int]) -> list[int]:
        state, matched, out = 0, 0, []
        for c in symbols:
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            out.append(matched)
        return out


class BenchmarkIndex:
    """A block of items: alphabet, automaton, successor pairs as a hashed bit table, and the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        self.items: dict[tuple[int, ...], set[str]] = {}
        pairs = set()
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words]
            self.automaton.add(ids)
            pairs.update(zip(ids, ids[1:], strict=False))
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1) if n else ():
                self.items.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.lengths = sorted({len(k) for k in self.items})
        bits = max(16, (16 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.follows = np.zeros(1 << bits, bool)
        if pairs:
            a, b = np.array(sorted(pairs), np.uint64).T
            self.follows[self._slot(a, b)] = True

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93)) >> self.shift

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs [start, end) of hit words, merged, and the items whose windows occur."""
        if not self.lengths or len(words) < self.lengths[0]:
            return [], set()
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = ids > 0
        joined = np.zeros(len(ids), bool)  # whether a word may continue a match of the word before
        joined[1:] = known[1:] & known[:-1] & self.follows[self._slot(ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64))]
        begins = np.flatnonzero(known & ~joined)
        breaks = np.flatnonzero(~joined)
        after = np.searchsorted(breaks, begins, side="right")
        ends = np.where(after < len(breaks), breaks[np.minimum(after, len(breaks) - 1)], len(ids))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for s, e in zip(*(x[ends - begins >= self.lengths[0]].tolist() for x in (begins, ends)), strict=True):
            own = ids[s:e].tolist()
            for i, matched in enumerate(self.automaton.run(own)):
                for n in self.lengths:
                    if n > matched:
                        break
                    items = self.items.get(tuple(own[i + 1 - n : i + 1]))
                    if items:
                        spans.append((s + i + 1 - n, s + i + 1))
                        found |= items
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int) -> Iterator[BenchmarkIndex]:
    """Indexes over blocks of whole items; one block is on the driver at a time."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if block and size + len(words) > block_words:
            yield BenchmarkIndex(block, window)
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield BenchmarkIndex(block, window)


def _with_hits(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_words: int) -> DataFrame:
    """Adds __starts, __ends (runs of hit words) and __items to rows that have __text."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(index) for index in blocks_of(benchmark, item_col, item_text_col, window, block_words)]

    def hits_of(df: DataFrame, block, all_rows: bool) -> DataFrame:
        """A narrow pass: `df` with its hits, or only the rows that have any."""
        k = df.columns.index("__text")
        names = [*df.columns, "__starts", "__ends", "__items"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = block.value
            for batch in batches:
                found = [index.hits(words_of(batch.column(k)[i].as_py())) for i in range(batch.num_rows)]
                starts, ends = ([[x[side] for x in spans] for spans, _ in found] for side in (0, 1))
                items = [sorted(x for x in own if x is not None) for _, own in found]
                out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=names)
                yield out if all_rows else out.filter(pa.array([bool(s) for s in starts], pa.bool_()))

        more = T.StructType([*df.schema.fields, *(T.StructField(n, T.ArrayType(t)) for n, t in (("__starts", T.IntegerType()), ("__ends", T.IntegerType()), ("__items", T.StringType())))])
        return df.mapInArrow(run, more)

    if len(blocks) == 1:
        return hits_of(docs, blocks[0], True)
    keyed = docs.withColumn("__key", F.md5("__text"))
    passes = [hits_of(keyed.select("__key", "__text"), b, False).select("__key", "__starts", "__ends", "__items") for b in blocks]
    # Equal texts have equal hits: one row for each text and block.
    one = reduce(DataFrame.union, (p.groupBy("__key").agg(F.first(F.struct("__starts", "__ends", "__items")).alias("x")) for p in passes))
    all_ = one.groupBy(F.col("__key").alias("__k1")).agg(F.flatten(F.collect_list(F.arrays_zip("x.__starts", "x.__ends"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("x.__items")))).alias("__items"))

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def joined(spans):
        return type(spans)([[{"s": s, "e": e} for s, e in merged([(x["__starts"], x["__ends"]) for x in own])] for own in spans], dtype=object)

    all_ = all_.select("__k1", joined("spans").alias("r"), "__items")
    found = keyed.join(all_, F.col("__key") == F.col("__k1"), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return found.select(*docs.columns, none(F.col("r.s"), "int").alias("__starts"), none(F.col("r.e"), "int").alias("__ends"), none(F.col("__items"), "string").alias("__items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of `docs`: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words. Items without words have no windows; items with equal texts all count; a null item
    id counts for hits but is not listed. Repeated rows give repeated rows; extra columns on either side are ignored.
    An empty benchmark hits nothing; an empty table gives no rows; very long texts are read word by word like others. Without
    more than one block there is no shuffle: a hot item or passage costs each document only its own words.
    """
    df = _with_hits(id_and_text(docs, id_col, text_col), benchmark, item_col, item_text_col, window, block_words)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, items = (batch.column(i).to_pylist() for i in (2, 3, 4))
            n = [len(words_of(t.as_py())) for t in batch.column(1)]
            hit = [sum(e) - sum(s) for s, e in zip(starts, ends, strict=True)]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=["__id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return df.mapInArrow(finish, "__id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").withColumnRenamed("__id", id_col)


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the given runs of words; what stood around a run is parted by a line break."""
    data = text.encode("utf-8", "surrogatepass")
    mask = np.frombuffer(data.translate(_KEEP), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts, at = [], 0
    for s, e in runs:
        parts.append(data[at : begins[s]])
        at = int(ends[e - 1])
    parts.append(data[at:])
    return b"\n".join(parts).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_run: int = MAX_RUN, max_share: float = MAX_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows and columns of `docs` without contamination: a document with a run of `max_run` hit words or with `max_share`
    of its words hit goes; other hit runs are cut out of its text. Documents without a hit, null and empty texts among them, stay as they are; so do rows that repeat
    each other, and other columns whatever their names. An empty table stays empty.
    """
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names)), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    found = _with_hits(plain, benchmark, item_col, item_text_col, window, block_words)

    @F.pandas_udf("string")
    def cleaned(texts, starts, ends):
        out = []
        for t, s, e in zip(texts, starts, ends, strict=True):
            if not len(s):
                out.append(t)
                continue
            n, runs = len(words_of(t)), list(zip(s.tolist(), e.tolist(), strict=True))
            out.append(None if max(b - a for a, b in runs) >= max_run or sum(b - a for a, b in runs) >= max_share * n else cut_words(t, runs))
        return type(texts)(out, dtype=object)

    hit = F.size("__starts") > 0
    k = names.index(text_col)
    done = found.withColumn("__clean", cleaned("__text", "__starts", "__ends"))
    new = F.when(hit, F.col("__clean")).otherwise(F.col(f"__c{k}"))
    return done.filter(~hit | F.col("__clean").isNotNull()).select(*((new if i == k else F.col(f"__c{i}")).alias(c) for i, c in enumerate(names)))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items; odd rows as in find_contamination."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
