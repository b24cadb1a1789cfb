"""Media columns: bytes held as Matroska, written and parsed element by element.

The writer makes an EBML header and a Segment with Info, Tracks (8-bit PCM), Clusters of laced SimpleBlocks and Cues. The
parser walks variable-length elements of any such file, knows Cluster, BlockGroup, SimpleBlock, the three lacings and
Cues, and gives a packet table: track, timestamp, key flag and byte range of each frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, per_text, table

#: Bytes (8-bit samples) of a frame, samples a second, frames of a laced block, blocks of a cluster.
UNIT, RATE, LACE, CLUSTER = 192, 48_000, 8, 32
PAD = b"\x20"

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CUES, CLUSTER_ID, GROUP = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1C53BB6B, 0x1F43B675, 0xA0
TRACK_ENTRY, AUDIO, CUE_POINT, CUE_AT, SIMPLE, BLOCK, TIMESTAMP = 0xAE, 0xE1, 0xBB, 0xB7, 0xA3, 0xA1, 0xE7
DOC_TYPE, SCALE, DURATION, NUMBER, UID, KIND, CODEC, FREQUENCY, CHANNELS, DEPTH = 0x4282, 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264
CUE_TIME, CUE_TRACK, CUE_CLUSTER, REFERENCE = 0xB3, 0xF7, 0xF1, 0xFB
_PARENTS = {SEGMENT, INFO, TRACKS, CUES, CLUSTER_ID, GROUP, TRACK_ENTRY, AUDIO, CUE_POINT, CUE_AT}


class MediaError(ValueError):
    """The bytes are not a file that this parser can read."""


def write_size(n: int, width: int = 0) -> bytes:
    """A size as a variable-length number: the count of leading zero bits gives its bytes; all ones are kept for 'unknown'."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def read_number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, next offset) of the variable-length number at `at`; -1 for the unknown size."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MediaError(f"cut off at {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return raw, at + width
    value = raw - (1 << 7 * width)
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + write_size(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def write_media(payload: bytes, unit: int = UNIT, rate: int = RATE, lace: int = LACE, cluster: int = CLUSTER) -> bytes:
    """One track of 8-bit samples; `payload` is a whole number of units, each a frame of unit / rate seconds."""
    if not payload or len(payload) % unit:
        raise MediaError("the payload is not a positive multiple of the unit")
    ms = unit * 1000 // rate
    frames = len(payload) // unit
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(frames * ms))) + element(0x4D80, b"tritlake") + element(0x5741, b"tritlake"))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", float(rate))) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    parts = [info, element(TRACKS, element(TRACK_ENTRY, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + uint(0x9C, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))]
    at, cues = sum(map(len, parts)), []
    for first in range(0, frames, lace * cluster):
        body = [uint(TIMESTAMP, first * ms)]
        for k in range(first, min(first + lace * cluster, frames), lace):
            n = min(lace, frames - k)
            flags = 0x80 | (0x04 if n > 1 else 0)  # key frame; fixed-size lacing
            body.append(element(SIMPLE, b"\x81" + struct.pack(">hB", (k - first) * ms, flags) + (bytes([n - 1]) if n > 1 else b"") + payload[k * unit : (k + n) * unit]))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first * ms) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER_ID, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """Packets are (track, timestamp in units of `scale` ns, key, offset, size), in file order."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements between two offsets; an unknown size reaches to the end of its parent."""
    while at < end:
        ident, p = read_number(data, at, keep_marker=True)
        size, p = read_number(data, p)
        stop = end if size < 0 else p + size
        if stop > end:
            raise MediaError(f"element {ident:X} at {at} reaches beyond its parent")
        yield ident, p, stop
        at = stop


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and the offset of the first: kind 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise MediaError("frames of a fixed lace differ")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            size, at = read_number(data, at)
            if k:  # a difference, shifted so that it is never negative
                size = sizes[-1] + size - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MediaError("a lace is longer than its block")
    return sizes, at


def parse_media(data: bytes) -> Media:
    m = Media()
    whole = list(elements(data, 0, len(data)))
    if not whole or whole[0][0] != EBML:
        raise MediaError("no EBML header")
    for ident, s, e in elements(data, *whole[0][1:]):
        if ident == DOC_TYPE:
            m.doc_type = data[s:e].decode("ascii", "replace")
    for ident, s, e in whole[1:]:
        if ident == SEGMENT:
            _segment(m, data, s, e)
    return m


def _segment(m: Media, data: bytes, start: int, end: int) -> None:
    number = lambda s, e: int.from_bytes(data[s:e], "big")
    real = lambda s, e: struct.unpack(">d" if e - s == 8 else ">f", data[s:e])[0] if e > s else 0.0
    for ident, s, e in elements(data, start, end):
        if ident == INFO:
            for i, a, b in elements(data, s, e):
                if i == SCALE:
                    m.scale = number(a, b)
                elif i == DURATION:
                    m.duration = real(a, b)
        elif ident == TRACKS:
            for i, a, b in elements(data, s, e):
                if i == TRACK_ENTRY:
                    own = {j: (c, d) for j, c, d in elements(data, a, b)}
                    sound = {j: (c, d) for j, c, d in elements(data, *own[AUDIO])} if AUDIO in own else {}
                    m.tracks.append({"number": number(*own.get(NUMBER, (0, 0))), "codec": data[slice(*own.get(CODEC, (0, 0)))].decode("ascii", "replace"), "rate": real(*sound.get(FREQUENCY, (0, 0))), "depth": number(*sound.get(DEPTH, (0, 0)))})
        elif ident == CLUSTER_ID:
            m.clusters += 1
            base = 0
            for i, a, b in elements(data, s, e):
                if i == TIMESTAMP:
                    base = number(a, b)
                elif i == SIMPLE:
                    _block(m, data, a, b, base, None)
                elif i == GROUP:
                    inside = list(elements(data, a, b))
                    for j, c, d in inside:
                        if j == BLOCK:
                            _block(m, data, c, d, base, all(x != REFERENCE for x, *_ in inside))
        elif ident == CUES:
            for i, a, b in elements(data, s, e):
                if i == CUE_POINT:
                    point = list(elements(data, a, b))
                    at = next((number(c, d) for j, c, d in point if j == CUE_TIME), 0)
                    for j, c, d in point:
                        if j == CUE_AT:
                            own = {x: number(p, q) for x, p, q in elements(data, c, d)}
                            m.cues.append((at, own.get(CUE_TRACK, 0), start + own.get(CUE_CLUSTER, 0)))


def _block(m: Media, data: bytes, start: int, end: int, base: int, key: bool | None) -> None:
    track, at = read_number(data, start)
    if at + 3 > end:
        raise MediaError("a block is cut off")
    shift, flags = struct.unpack(">hB", data[at : at + 3])
    sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    rate = next((t["rate"] for t in m.tracks if t["number"] == track), 0.0)
    for k, size in enumerate(sizes):
        # Frames of a lace follow each other; 8-bit mono samples give each one's length.
        later = round(k * size * 1e9 / (rate * m.scale)) if rate else 0
        m.packets.append((track, base + shift + later, bool(flags & 0x80) if key is None else key, at, size))
        at += size


def track_bytes(data: bytes, m: Media, track: int = 1) -> bytes:
    return b"".join(data[at : at + size] for t, _, _, at, size in m.packets if t == track)


def feature_of(data: bytes, m: Media, payload: bytes) -> str:
    """Packets, clusters, cues and length of the stored form; mean, deviation and level crossings of its samples."""
    x = np.frombuffer(payload, np.uint8)
    total, squares, n = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum()), len(x)
    above = x.astype(np.int64) * n > total
    spread = max(0, squares * n - total * total) / (n * n)
    return f"packets={len(m.packets)};clusters={m.clusters};cues={len(m.cues)};ms={m.duration:.0f};mean={total / n:.4f};var={spread:.4f};crossings={int((above[1:] != above[:-1]).sum())}"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """Per row: id and `media` (binary), the text's UTF-8 bytes padded with spaces to a positive multiple of `unit`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [write_media(padded((t.as_py() or "").encode("utf-8", "surrogatepass"), unit), unit) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["__id", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "__id long, media binary").withColumnRenamed("__id", id_col)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: id, packet, track, timestamp_ns, is_key, offset, size. Null or unreadable media give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", "packet", "track", "timestamp_ns", "is_key", "offset", "size"]
        types = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 2
        for b in batches:
            rows = []
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    m = parse_media(data) if data is not None else Media()
                except (MediaError, IndexError, struct.error):
                    continue
                rows += [(i, k, t, ts * m.scale, key, at, size) for k, (t, ts, key, at, size) in enumerate(m.packets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, types, strict=True)], names=names)

    ddl = "__id long, packet long, track long, timestamp_ns long, is_key boolean, offset long, size long"
    return media.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{media_col}`").cast("binary").alias("__m")).mapInArrow(run, ddl).withColumnRenamed("__id", id_col)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + PAD * (-len(data) % unit if data else unit)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """Per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Each text is written as Matroska and its samples are read back through the packet table. Null and empty texts are one
    unit of spaces. Equal texts give equal values, repeated rows repeated rows; extra columns are ignored;
    an empty table gives no rows. A very long text is one file, in memory of a few times its size.
    """

    def make() -> Callable[[str], tuple]:
        def one(text: str) -> tuple:
            raw = text.encode("utf-8", "surrogatepass")
            media = write_media(padded(raw, unit), unit)
            m = parse_media(media)
            back = track_bytes(media, m)
            return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(media, m, back)

        return one

    fields = [("__id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    ddl = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in fields)
    return per_text(id_and_text(docs, id_col, text_col), id_col, make, pa.schema(fields), ddl)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; odd rows as in media_features."""
    return media_features(table(spark, sf_dir, "documents"))
