"""HTML extraction by nearest-URL page differencing.

A page is cut into text lines, one per block element, in page order. Pages are put in order of host and URL path; each is
compared with the pages before and after it on its host. Of the two, the one whose path shares the longer prefix is the
nearest (both if they share as much). Lines are aligned by longest common subsequence; lines that a page shares with a nearest
one are template and are deleted. Markup gives hints: elements made for menus, notices, forms and the like never hold text; in
a marked article only such lines go as begin or end it and the articles of both neighbours; and a page that has no neighbour
to be compared with is cut to its article.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Element names of the format and words of class, id and role attributes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript template xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("head nav footer aside form button select option dialog menu svg canvas object audio video map input fieldset".split())
# A class, id or role is a hint if it is such a word, or if all its parts are such words or name a place or a box.
_HINTS_ANYWHERE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe sidebar nav navbar navigation breadcrumb breadcrumbs "
    "comment comments commentlist replies reply respond disqus share sharing social related recommended pagination pager complementary contentinfo".split()
)
_HINTS_OUTSIDE = _HINTS_ANYWHERE | frozenset("notice notices notification alert banner popup modal overlay menu footer header search login signin signup widget".split())
_PLACES = frozenset("site page main top bottom left right inner outer list area box wrap wrapper container section block bar item items thread body form link links post posts reader user holder slot unit panel row col group content 1 2 3 4".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Blocks of running text, which stay outside a marked article too if no neighbour shares them.
_PROSE = frozenset("p h1 h2 h3 blockquote pre".split())
ARTICLE, MAIN, OTHER = 2, 1, 0


def hinted(value: str, hints: frozenset[str]) -> bool:
    """Whether one of the words of an attribute is a hint, as a whole or by all its parts."""
    for word in value.strip("\"'").split():
        parts = [p.lower() for p in _PART.findall(word)]
        if word.lower() in hints or (any(p in hints for p in parts) and all(p in _HINTS_OUTSIDE or p in _PLACES for p in parts)):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, str]]:
    """Text lines of a page in order, each with where it is (ARTICLE, MAIN or OTHER) and the name of its block."""
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[str, bool, int]] = []  # name, dropped, where
    text: list[str] = []

    def flush() -> None:
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, stack[-1][2], stack[-1][0]) if stack else (line, OTHER, ""))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at and not (stack and stack[-1][1]):
            text.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _INLINE and name != "br":
            continue
        if name == "br":
            text.append(" ")
            continue
        flush()
        dropped, where = (stack[-1][1], stack[-1][2]) if stack else (False, OTHER)
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in _VOID or m[3].rstrip().endswith("/"):
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
            stack.pop()
        elif stack and stack[-1][0] == "p":
            stack.pop()
        if m[3] and not dropped and name not in ("html", "body"):
            for a in _ATTR.finditer(m[3]):
                if a[1].lower() == "hidden" or (a[1].lower() != "itemprop" and hinted(a[2] or "", _HINTS_ANYWHERE if where == ARTICLE or name in ("article", "main") else _HINTS_OUTSIDE)):
                    dropped = True
        if name in _DROPPED or (name == "header" and where != ARTICLE):
            dropped = True
        if name == "article":
            where = ARTICLE
        elif name == "main" and where == OTHER:
            where = MAIN
        stack.append((name, dropped, where))
    flush()
    return out


def digests_of(lines: list[tuple[str, int, str]]) -> list[int]:
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x, _, _ in lines]


def article_ends(lines: list[tuple[str, int, str]], own: list[int], others: list[list[int]]) -> set[int]:
    """Places of the article's lines at its beginning and end that also begin and end the articles of both neighbours.

    A main heading is passed over. A neighbour that holds half of the article is a copy of it and says nothing of template.
    """
    inside = [k for k, line in enumerate(lines) if line[1] == ARTICLE and line[2] != "h1"]
    mine = [own[k] for k in inside]
    size = sum(len(lines[k][0]) for k in inside)
    if any(2 * sum(len(lines[inside[j]][0]) for j in common_lines(mine, o)) >= size for o in others):
        return set()
    alike = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    first, last = min(alike(mine, o) for o in others), min(alike(mine[::-1], o[::-1]) for o in others)
    return set(inside[:first]) | set(inside[len(inside) - last :])


def chosen(lines: list[tuple[str, int, str]], before: set[int] | None, after: set[int] | None, nearest: tuple[bool, bool], ends: set[int]) -> str:
    """The text. `before` and `after` are the places of lines shared with the neighbours, None if there is none; `nearest` says
    which count as nearest; `ends` are lines of the article that are template."""
    compared = before is not None or after is not None
    shared = set().union(*(s for s, near in zip((before, after), nearest, strict=True) if s and near))
    inside = [k for k, line in enumerate(lines) if line[1] == ARTICLE]
    marked = bool(inside) or any(where == MAIN for _, where, _ in lines)

    def stays(k: int) -> bool:
        _, where, block = lines[k]
        if where == ARTICLE:
            return k not in ends
        if where == MAIN or not marked:
            return k not in shared
        return compared and k not in shared and block in _PROSE

    kept = [k for k in range(len(lines)) if stays(k)]
    if not kept or (marked and not any(lines[k][1] != OTHER for k in kept)):  # nothing of the marked part is its own
        kept = inside or [k for k, line in enumerate(lines) if line[1] == MAIN] or list(range(len(lines)))
    return "\n\n".join(lines[k][0] for k in kept)


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b, from bit vectors: one addition for each element of a."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = row = (1 << len(b)) - 1
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & every
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in `a` of a longest common subsequence with `b`, in memory proportional to both (Hirschberg's halving).

    Common ends are matched first. Of equally long ones the earliest split of `b` is taken at each halving.
    """
    lo, m, n = 0, len(a), len(b)
    while lo < m and lo < n and a[lo] == b[lo]:
        lo += 1
    out = set(range(lo))
    while m > lo and n > lo and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
        out.add(m)
    both = set(a[lo:m]) & set(b[lo:n])
    todo = [([k for k in range(lo, m) if a[k] in both], [y for y in b[lo:n] if y in both])] if both else []
    while todo:
        xs, ys = todo.pop()
        if not xs or not ys:
            continue
        if len(xs) == 1:
            if a[xs[0]] in ys:
                out.add(xs[0])
            continue
        half = len(xs) // 2
        left = _prefix_lengths([a[k] for k in xs[:half]], ys)
        right = _prefix_lengths([a[k] for k in reversed(xs[half:])], ys[::-1])[::-1]
        cut = int(np.argmax(left + right))
        todo += [(xs[:half], ys[:cut]), (xs[half:], ys[cut:])]
    return out


def _address(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def article_of(lines: list[tuple[str, int, str]], own: list[int]) -> list[int]:
    """Digests of the article's lines, without main headings."""
    return [d for d, line in zip(own, lines, strict=True) if line[1] == ARTICLE and line[2] != "h1"]


_PLACE = ("host", "path", "key", "salt")


def _blocks(base: DataFrame, parts: int) -> tuple[list[tuple], dict[int, tuple]]:
    """(first row of each block but the first, {block: (page before it, page after it)}), each page as (path, line digests, the article's line digests).

    Blocks are ranges of the order of the pages. The driver gets four addresses for each, and the lines of its two neighbours.
    """
    spark = base.sparkSession
    n = 2 * parts
    light = base.select(*_PLACE).repartitionByRange(n, *_PLACE).sortWithinPartitions(*_PLACE)
    names = [f"{c}{k}" for k in range(4) for c in _PLACE]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = second = last = previous = None  # the first two pages and the last two
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                first = first or row
                if second is None and row[:3] != first[:3]:
                    second = row
                if last is None or row[:3] != last[:3]:
                    last, previous = row, last
        if first:
            cells = [v for row in (first, second, last, previous) for v in (row or (None,) * 4)]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k % 4 < 2 else pa.int64()) for k, v in enumerate(cells)], names=names)

    found = light.mapInArrow(ends, ", ".join(f"{c}{k} {'string' if c in ('host', 'path') else 'long'}" for k in range(4) for c in _PLACE)).collect()
    rows = sorted(tuple(tuple(r[k : k + 4]) for k in range(0, 16, 4)) for r in (tuple(x) for x in found))
    near: dict[int, list] = {}
    for k, (first, _, last, _) in enumerate(rows):
        before = next((p for r in reversed(rows[:k]) for p in (r[2], r[3]) if p[0] is not None and p[:3] != first[:3]), None)
        after = next((p for r in rows[k + 1 :] for p in (r[0], r[1]) if p[0] is not None and p[:3] != last[:3]), None)
        near[k] = [before[:3] if before and before[0] == first[0] else None, after[:3] if after and after[0] == last[0] else None]
    wanted = {p for pair in near.values() for p in pair if p}
    lines: dict[tuple, tuple[list[int], list[int]]] = {}
    if wanted:
        some = F.broadcast(spark.createDataFrame(sorted(wanted), "host string, path string, key long"))  # two for each block

        def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = set()
            for b in batches:
                for k in range(b.num_rows):
                    page = tuple(b.column(j)[k].as_py() for j in range(3))
                    if page not in done:
                        done.add(page)
                        found = lines_of(b.column(3)[k].as_py())
                        own = digests_of(found)
                        yield pa.RecordBatch.from_arrays([*(b.column(j).slice(k, 1) for j in range(3)), pa.array([own], pa.list_(pa.int64())), pa.array([article_of(found, own)], pa.list_(pa.int64()))], names=["host", "path", "key", "lines", "article"])

        got = base.select("host", "path", "key", "html").join(some, ["host", "path", "key"], "left_semi").mapInArrow(outline, "host string, path string, key long, lines array<long>, article array<long>")
        got = got.groupBy("host", "path", "key").agg(F.first("lines").alias("lines"), F.first("article").alias("article"))
        lines = {(r["host"], r["path"], r["key"]): (r["lines"], r["article"]) for r in got.collect()}
    return [r[0] for r in rows[1:]], {k: tuple((p[1], *lines[p]) if p else None for p in pair) for k, pair in near.items()}


def _alike(a: str, b: str) -> int:
    """Length of the shared prefix of two paths."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (blocks joined by two line breaks, empty if none), n_chars.

    Null and empty html give the empty text, an empty table no rows. Rows without a url are on one host. Rows of the same url
    and html are one page when pairing, so exact repeats do not delete each other, and get equal texts. A page that would lose
    all of its marked part, or all lines if none is marked, keeps them. Every article of a page stays, in page order. Extra
    columns are ignored. A page is parsed once, in a task that has the pages beside it; very long pages are aligned in memory
    proportional to their lines. Pages are dealt by ranges of (host, path, page, row), so neither a hot host nor a page that is
    repeated very often lands in one task.
    """
    host, path = _address(F.col(f"`{url_col}`"))
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"), host.alias("host"), path.alias("path"))
    base = base.withColumn("key", F.xxhash64("url", "html")).withColumn("salt", F.xxhash64("id"))
    # As many parts as the input has, so that they do not grow with it.
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.rdd.getNumPartitions())
    starts, near = _blocks(base, n)
    if not near:
        return base.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    block = F.lit(0)
    if starts:  # how many starts are not greater than the row: binary search in a constant array
        kinds = dict(zip(_PLACE, ("string", "string", "long", "long"), strict=True))
        table_ = F.array(*(F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(_PLACE, s, strict=True))) for s in starts))
        steps = F.array(*(F.lit(1 << k) for k in range(len(starts).bit_length() - 1, -1, -1)))
        own = F.struct(*_PLACE)
        block = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(starts)) & (F.get(table_, at + step - 1) <= own), at + step).otherwise(at))
    dealt = base.withColumn("block", block.cast("int")).repartition(n, "block").sortWithinPartitions("block", *_PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        page: tuple | None = None  # block, host, path, key
        lines, own, rows, before = [], [], [], None

        def done(after: tuple[str, list[int], list[int]] | None) -> None:
            sides = [(common_lines(own, s[1]), _alike(page[2], s[0])) if s else (None, -1) for s in (before, after)]
            most = max(s[1] for s in sides)
            ends = article_ends(lines, own, [before[2], after[2]]) if before and after else set()
            text = chosen(lines, sides[0][0], sides[1][0], (sides[0][1] == most, sides[1][1] == most), ends)
            out.extend((i, u, text, len(text)) for i, u in rows)

        def batch() -> pa.RecordBatch:
            cols = zip(*out, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["id", "url", "text", "n_chars"])
            out.clear()
            return made

        for b in batches:
            for k in range(b.num_rows):
                now = tuple(b.column(j)[k].as_py() for j in range(4))
                if now != page:
                    new = lines_of(b.column(6)[k].as_py())
                    digests = digests_of(new)
                    if page is None or now[0] != page[0]:
                        if page is not None:
                            done(near[page[0]][1])
                        before = near[now[0]][0]
                    else:
                        together = now[1] == page[1]
                        done((now[2], digests, article_of(new, digests)) if together else None)
                        before = (page[2], own, article_of(lines, own)) if together else None
                    page, lines, own, rows = now, new, digests, []
                    if len(out) >= 256:
                        yield batch()
                rows.append((b.column(4)[k].as_py(), b.column(5)[k].as_py()))
        if page is not None:
            done(near[page[0]][1])
        if out:
            yield batch()

    done = dealt.select("block", "host", "path", "key", "id", "url", "html").mapInArrow(run, "id long, url string, text string, n_chars long")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with the contract's columns."""
    return extract_pages(table(spark, sf_dir, "pages"))
