"""Suffix-array dedup: removes the bytes of strings of a given length that also start elsewhere in the corpus.

Two equal strings of WIDTH bytes hold the same least GRAM-byte gram at the same place, so a string belongs to exactly one
occurrence of such an anchor. Anchors are counted; only stretches around anchors that occur again can hold a repeat. Equal
stretches are one row with a count. What is left are different stretches around equal anchors: they are dealt by anchor
into shards, a shard's text goes to disk as it arrives, and its suffix and common-prefix arrays, by external induced sorting,
tell which of its strings occur twice. An anchor is in one task, so one with very many stretches is not dealt: its strings
are folded to digests before the shuffle and counted.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text, table
from .suffix_induction import DiskQueue, induce, on_disk

WIDTH, GRAM = 200, 64
#: Bytes of a text that are looked at together; a separator that no UTF-8 text holds.
BLOCK, SEPARATOR = 1 << 20, 0xFF
#: Bytes after which a shard ends at the next anchor; stretches from which on an anchor's strings are folded.
SHARD, HOT = 1 << 22, 1 << 12
#: Kinds of the rows that are dealt: a stretch with its text, a string of a hot anchor by its digest, one that is known to repeat.
TEXT, DIGEST, SETTLED = 0, 1, 2
_WORD = (1 << 64) - 1


def anchors(data: bytes, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor digest, stretch digest, first string, number of strings) of the stretches of a text.

    A stretch is a run of starts of strings that share the occurrence of their least gram; leftmost of equals.
    """
    whole = np.frombuffer(data, np.uint8)
    total = len(whole) - width + 1
    for at in range(0, total, BLOCK):
        # A block starts and ends its own stretches; equal strings still meet under their anchor.
        part = whole[at : min(len(whole), at + BLOCK + width - 1)]
        h = part.astype(np.uint64) + np.uint64(1)
        w = 1
        while w < gram:
            h = h[:-w] * np.uint64(0x9E3779B97F4A7C15) + (h[w:] ^ (h[w:] >> np.uint64(29)))
            w *= 2
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        span, w = width - gram + 1, 1
        while 2 * w <= span:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        if span > w:
            least = np.minimum(least[: len(least) - (span - w)], least[span - w :])
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        n = np.diff(np.append(starts, len(place)))
        view = memoryview(data)
        digest = np.fromiter((xxhash.xxh3_64_intdigest(view[at + s : at + s + k + width - 1]) for s, k in zip(starts.tolist(), n.tolist(), strict=True)), np.uint64, len(starts))
        yield h[place[starts]].view(np.int64), digest.view(np.int64), starts + at, n


class Shard:
    """Stretches whose text and rows are on disk; memory holds a block of either."""

    def __init__(self) -> None:
        self.file, self.size = tempfile.TemporaryFile(), 0
        self.rows = DiskQueue(6)  # i, h, done, first string, number of strings, place of the text

    def add(self, i: int, h: int, done: bool, s: int, n: int, text: bytes) -> None:
        self.rows.push(*np.array([[i, h, done, s, n, self.size]]).T)
        self.file.write(text)
        self.file.write(bytes([SEPARATOR]))
        self.size += len(text) + 1

    def repeated(self, width: int) -> Iterator[tuple[int, int, int, int]]:
        """(i, h, first byte, last byte + 1) of the strings that occur again, of the stretches that are not done."""
        self.file.flush()
        x = np.asarray(np.memmap(self.file, np.uint8, "r", shape=(self.size,)))
        mark, last = on_disk(self.size, np.bool_), -1
        for pos, lcp in induce(x, 256, most=width):
            same = lcp >= width
            if same.any():
                mark[pos[same]] = True
                mark[np.concatenate(([last], pos[:-1]))[same]] = True
            last = int(pos[-1])
        for block in self.rows.blocks():
            for i, h, done, s, n, at in block.T.tolist():
                if not done:
                    for lo, hi in zip(*_runs(mark[at : at + n]), strict=True):
                        yield i, h, s + int(lo), s + int(hi) + width - 1


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the spans and the maximal runs removed (spans that touch are one)."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    parts, at = [], 0
    for s, e in runs:
        parts.append(data[at:s])
        at = e
    return b"".join([*parts, data[at:]]), [(s, e) for s, e in runs]


def repeated_spans(base: DataFrame, width: int = WIDTH, gram: int = GRAM, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(__id, i, h, text) -> (i, h, s, e): byte spans that repeated strings cover; i and h name a document."""

    names = ["i", "h", "a", "c", "s", "n", "m"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of a batch of texts, equal ones as one row with m = 2; all their occurrences come as spans, m = 0.

        A span has a key of its own in place of an anchor, so spans spread over the tasks of the join below.
        """
        for b in batches:
            parts = []
            for k in range(b.num_rows):
                data = b.column(2)[k].as_py().encode("utf-8", "surrogatepass")
                if len(data) >= width:
                    for a, c, s, n in anchors(data, width, gram):
                        parts.append((np.full(len(a), b.column(0)[k].as_py(), np.int64), np.full(len(a), b.column(1)[k].as_py(), np.int64), a, c, s, n))
            if not parts:
                continue
            i, h, a, c, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((c, a))
            new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])))
            size = np.diff(np.append(np.flatnonzero(new), len(order)))
            m = np.minimum(size, 2)
            first = order[new]
            again = np.sort(order[np.repeat(size > 1, size)])  # in the order of the texts
            if len(again):  # spans that touch are one
                end = s[again] + n[again]
                head = np.concatenate(([True], (i[again][1:] != i[again][:-1]) | (h[again][1:] != h[again][:-1]) | (s[again][1:] != end[:-1])))
                at, stop = again[head], np.append(np.flatnonzero(head)[1:], len(again)) - 1
                key = (s[at] * 0x9E3779B97F4A7C1 + i[at]) ^ h[at]
                spans = [i[at], h[at], key, np.zeros(len(at), np.int64), s[at], end[stop] - s[at], np.zeros(len(at), np.int64)]
            else:
                spans = [np.zeros(0, np.int64)] * 7
            cols = [np.concatenate((x, y)) for x, y in zip((i[first], h[first], a[first], c[first], s[first], n[first], m), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols[:5]] + [pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int32())], names=names)

    found = base.select("i", "h", "text").mapInArrow(find, "i long, h long, a long, c long, s long, n int, m int")
    again = found.filter("m > 0").groupBy("a").agg(F.sum("m").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("k > 1").select(F.col("a").alias("a1"), (F.col("lo") != F.col("hi")).alias("mixed"), (F.col("k") > hot).alias("hot"))
    kept = found.join(again, F.col("a") == F.col("a1"), "left").filter("m = 0 or mixed is not null")
    kept = cut_lineage(kept.withColumn("mixed", F.when(F.col("m") == 0, False).otherwise(F.col("mixed"))).drop("a1"))
    stretches = kept.filter("mixed").groupBy("a", "c").agg(F.sum("m").alias("k"), F.min(F.struct("i", "h", "s", "n")).alias("r"), F.any_value("hot").alias("hot"))
    twice = stretches.filter("k > 1").select(F.col("a").alias("a1"), F.col("c").alias("c1"))
    covered = kept.filter("not mixed").select("i", "h", "s", "n").union(kept.filter("mixed").join(twice, (F.col("a") == F.col("a1")) & (F.col("c") == F.col("c1"))).select("i", "h", "s", "n"))
    covered = covered.select("i", "h", F.col("s"), (F.col("s") + F.col("n") + (width - 1)).alias("e"))

    # The text of one occurrence of each other stretch, dealt by anchor; of hot anchors the digests of its strings.
    wanted = stretches.select("a", "c", "k", "hot", "r.*").groupBy(F.col("i").alias("i1"), F.col("h").alias("h1")).agg(F.collect_list(F.struct("a", "k", "s", "n", "hot")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["i", "h", "key", "kind", "done", "s", "n", "t"], [pa.int64()] * 3 + [pa.int8(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            rows, strings = [], {}
            for k in range(b.num_rows):
                i, h, text, want = (b.column(j)[k].as_py() for j in range(1, 5))
                data = text.encode("utf-8", "surrogatepass")
                for x in want:
                    s, n, done = x["s"], x["n"], x["k"] > 1
                    if x["hot"]:
                        for p in range(s, s + n):
                            strings.setdefault(xxhash.xxh3_64_intdigest(data[p : p + width], x["a"] & _WORD), []).append((i, h, p, done))
                    else:
                        rows.append((i, h, x["a"], TEXT, done, s, n, data[s : s + n + width - 1]))
            for digest, places in strings.items():
                # Several in one batch are known to repeat: they are settled, and one tells the others.
                many = len(places) > 1
                if many:
                    rows += [(i, h, (digest ^ hash((i, p)) & _WORD) - (1 << 63), SETTLED, False, p, 1, None) for i, h, p, done in places if not done]
                i, h, p, done = places[0]
                rows.append((i, h, digest - (1 << 63), DIGEST, done or many, p, 1, None))
            for at in range(0, len(rows), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + (1 << 14)], strict=True), types, strict=True)], names=names)

    # The same columns of the texts are dealt here and at the end, so that one shuffle of them serves both.
    texts = base.join(wanted, (F.col("i") == F.col("i1")) & (F.col("h") == F.col("h1"))).select("__id", "i", "h", "text", "want")
    fetched = texts.mapInArrow(fetch, "i long, h long, key long, kind tinyint, done boolean, s long, n int, t binary")
    shards = fetched.repartition("key").sortWithinPartitions("key")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["i", "h", "s", "e"])
            out.clear()
            return made

        own, last, first, told = Shard(), None, None, False
        for b in batches:
            for i, h, key, kind, done, s, n, t in zip(*(b.column(j).to_pylist() for j in range(8)), strict=True):
                if kind == TEXT:
                    if own.size >= shard and key != last:
                        for row in own.repeated(width):
                            out.append(row)
                            if len(out) >= 1 << 14:
                                yield batch()
                        own = Shard()
                    own.add(i, h, done, s, n, t)
                    last = key
                elif kind == SETTLED:
                    out.append((i, h, s, s + width))
                elif first is None or first[0] != key:
                    first, told = (key, i, h, s, done), False
                else:
                    if not told and not first[4]:
                        out.append((*first[1:4], first[3] + width))
                    told = True
                    if not done:
                        out.append((i, h, s, s + width))
            if len(out) >= 1 << 14:
                yield batch()
        if own.size:
            for row in own.repeated(width):
                out.append(row)
                if len(out) >= 1 << 14:
                    yield batch()
        if out:
            yield batch()

    return covered.union(shards.mapInArrow(sort, "i long, h long, s long, e long"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes; texts shorter than `width` lose none. All occurrences of a repeated string go, the
    first too. Repeated rows repeat each other's strings; each is judged as a document of its own. A null id is as good as
    any other; extra columns are ignored; an empty table gives no rows. Very long texts are read in blocks. What is kept may be cut within a character, so it is given by its digest.
    """
    base = id_and_text(docs, id_col, text_col).select("__id", F.coalesce("__id", F.lit(-(2**63))).alias("i"), F.xxhash64("__text").alias("h"), F.col("__text").alias("text"))
    spans = repeated_spans(base, width, gram)
    per_doc = spans.groupBy("i", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans")).withColumnsRenamed({"i": "i1", "h": "h1"})
    joined = base.join(per_doc, (F.col("i") == F.col("i1")) & (F.col("h") == F.col("h1")), "left").select("__id", "i", "h", "text", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text, spans in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                left, runs = remove_spans(data, [(x["s"], x["e"]) for x in spans or ()])
                for col, v in zip(cols, (len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(finish, "__id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("__id", id_col)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with strings of 200 bytes; odd rows as in remove_repeats."""
    return remove_repeats(table(spark, sf_dir, "documents"))
