"""Substring dedup by line hashing.

A unit is the least run of whole lines, from each line of a text on, that holds enough text; a long line is a unit by itself.
So a short line is judged together with the lines behind it: a passage that repeats goes whatever the length of its lines,
while a heading or a greeting that many texts share stays in its place. Passages also begin and end within lines; for those
the same runs are taken over the sentences of the lines, with digests of their own, so that a line and its sentences are not
taken for repeats of each other. A unit's digest is that of its normalised words.
Digests are counted over the whole corpus with map-side combination; of each repeated unit the occurrence of least rank
(document id, text digest, offset) stays and every other one is removed, with its offsets in the original text kept.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, id_and_text, table

#: UTF-8 bytes of normalised words, a space between each two, that a unit holds at least: some 20 to 25 words of Latin script
#: or 40 Chinese signs, as words are not counted. A text with fewer is one unit.
LEAST_BYTES = 120

_LINE = re.compile(r"[^\n]+")
#: Up to a stop before white space, a stop of scripts without spaces, or the line's end.
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』”’]*|(?=\n)|$)")
_WORDS = re.compile(r"\w+")
# Vowel signs and tones of Indic scripts and Thai are marks, which are not in \w; short lines that differ in them are not equal.
_MARKS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "M")
_MARKED_WORDS = re.compile(f"[\\w{''.join(sorted(_MARKS))}]+")


def _finder(text: str) -> re.Pattern[str]:
    """What finds the words of a text and its parts; the slow pattern only where a mark is, as else both find the same."""
    try:
        text.encode("latin-1")  # no marks there
    except UnicodeEncodeError:
        return _WORDS if _MARKS.isdisjoint(text.lower()) else _MARKED_WORDS
    return _WORDS


def lines_of(text: str, piece: re.Pattern[str] = _LINE) -> list[tuple[int, int, bytes]]:
    """(start, end, normalised words) in code points of each line, or other piece, with a word, without the white space at its ends."""
    out, finder = [], _finder(text)
    for line in piece.finditer(text):
        words = " ".join(finder.findall(line[0].lower()))
        if words:
            at = line.start() + len(line[0]) - len(line[0].lstrip())
            out.append((at, at + len(line[0].strip()), words.encode("utf-8", "surrogatepass")))
    return out


def units_of(text: str, least_bytes: int = LEAST_BYTES, inside: bool = False) -> list[tuple[int, int, int]]:
    """(start, end, digest) in code points: from each line on the least run of lines with enough text; of a shorter text all lines.
    With `inside` also the runs of sentences."""
    return _runs(lines_of(text), least_bytes, 0) + (_runs(lines_of(text, _SENTENCE), least_bytes, 1) if inside else [])


def _runs(lines: list[tuple[int, int, bytes]], least_bytes: int, seed: int) -> list[tuple[int, int, int]]:
    out, stop, size = [], 0, 0
    for first, (start, _, words) in enumerate(lines):
        while stop < len(lines) and (size < least_bytes or stop <= first):
            size += len(lines[stop][2])
            stop += 1
        if size < least_bytes and first:
            break
        out.append((start, lines[stop - 1][1], xxhash.xxh3_64_intdigest(b"\n".join(w for _, _, w in lines[first:stop]), seed) - (1 << 63)))
        size -= len(words)
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the spans merged where they touch."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    parts, at = [], 0
    for s, e in runs:
        parts.append(text[at:s])
        at = e
    return "".join([*parts, text[at:]]), [(s, e) for s, e in runs]


def drop_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = LEAST_BYTES, inside: bool = False) -> DataFrame:
    """Per row: id, text (what is left), n_removed (lines, whole or in part), removed_spans ("start:end" in code points, merged).

    With `least_bytes` of 1 every line with a word is a unit by itself. With `inside` passages go that begin or end within
    lines, as far as their sentences are whole and hold enough text. Null and empty texts have no units and give the empty
    text, an empty table no rows; very long texts are split like any other, in memory of their size. Rows that repeat id and
    text have equal rank: the units that they hold first stay in each of them. A null id ranks before all others. Extra
    columns are ignored.
    """
    base = id_and_text(docs, id_col, text_col).select("__id", F.coalesce("__id", F.lit(-(2**63))).alias("i"), F.xxhash64("__text").alias("h"), "__text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows = []
                for i, h, t in zip(*(b.column(j).slice(k, 256).to_pylist() for j in range(3)), strict=True):
                    rows += [(i, h, s, e, d) for s, e, d in units_of(t, least_bytes, inside)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["i", "h", "s", "e", "d"])

    # Read twice, made once.
    units = cut_lineage(base.select("i", "h", "__text").mapInArrow(split, "i long, h long, s long, e long, d long"))
    rank = F.struct("i", "h", "s", "e")
    firsts = units.groupBy("d").agg(F.count("*").alias("n"), F.min(rank).alias("first")).filter("n > 1").select(F.col("d").alias("d1"), "first")
    gone = units.join(firsts, F.col("d") == F.col("d1")).filter(rank != F.col("first"))
    per_doc = cut_lineage(gone.groupBy("i", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans")).withColumnsRenamed({"i": "i1", "h": "h1"}))
    joined = base.join(per_doc, (base["i"] == per_doc["i1"]) & (base["h"] == per_doc["h1"]), "left").select("__id", "__text", "spans")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, gone, said = [], [], []
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py()
                rest, runs = cut(text, [(x["s"], x["e"]) for x in b.column(2)[k].as_py() or ()])
                left.append(rest)
                gone.append(sum(len(lines_of(text[s:e])) for s, e in runs))
                said.append(",".join(f"{s}:{e}" for s, e in runs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string()), pa.array(gone, pa.int64()), pa.array(said, pa.string())], names=["__id", "text", "n_removed", "removed_spans"])

    return joined.mapInArrow(finish, "__id long, text string, n_removed long, removed_spans string").withColumnRenamed("__id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: what is left of each text, the lines removed and their places; passages within lines too."""
    return drop_repeated_units(table(spark, sf_dir, "documents"), inside=True)
