"""Suffix and common-prefix arrays by external induced sorting.

A suffix is L if it is greater than the next one, else S; an S suffix after an L suffix is a seed. Seeds are sorted first:
the substrings between seeds are named in order, and if names repeat, the string of names is sorted in turn: by recursion
while it is longer than a fixed number of names, which bounds the memory, and below it in memory, where the recursion ends.
From the sorted seeds a scan in ascending order induces all L suffixes, and a scan in descending order all S suffixes.

What a scan has yet to visit waits in a priority queue of tuples (suffix, common prefix with the tuple before it of its
symbol). Its order is by first symbol and, within a symbol, by arrival. Symbols are dealt in order to groups, each with one
first-in first-out file: a group holds many rare symbols, few enough tuples to be put in order in memory, or one frequent
symbol, whose tuples are read block by block. The common prefix of two tuples of a symbol that arrive one after the other is
one more than the least common prefix passed between their sources. All that grows with the text is in files without a name;
in memory are blocks of tuples and each group's newest ones.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples of a block, tuples of a group of several symbols, tuples that a file keeps in memory.
BLOCK, GROUP, BUFFER = 1 << 15, 1 << 12, 1 << 11
#: Symbols of a walk over a string.
WALK = 1 << 16
#: Most groups, so that their buffers are bounded; symbols of a scan that are looked at together.
MOST_GROUPS, LOOK = 1 << 9, 1 << 12
#: Seeds of a part that are named in memory; names of a string that is sorted in memory, at about 130 bytes a name.
NAMED, IN_MEMORY = 1 << 18, 1 << 20
_FAR = np.int64(1) << 60


class DiskQueue:
    """Rows of integers in order of arrival; all but the newest are in a file without a name, which goes with the process."""

    def __init__(self, width: int = 2, buffer: int = BUFFER, wide: bool = True):
        self.width, self.buffer, self.file, self.stored, self.size = width, buffer, None, 0, 0
        self.dtype = np.dtype(np.int64 if wide else np.int32)
        self.parts: list[np.ndarray] = []

    def rows(self, *columns: np.ndarray) -> np.ndarray:
        out = np.empty((len(columns[0]), self.width), self.dtype)
        for k, c in enumerate(columns):
            out[:, k] = c
        return out

    def push(self, *columns: np.ndarray) -> None:
        self.append(self.rows(*columns))

    def append(self, rows: np.ndarray) -> None:
        self.parts.append(rows)
        self.size += len(rows)
        if self.size - self.stored > self.buffer:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.file.write(b"".join(p.tobytes() for p in self.parts))
            self.parts, self.stored = [], self.size

    def read(self, start: int, stop: int) -> np.ndarray:
        """Rows start to stop, one array for each column."""
        got = []
        if start < self.stored:
            size, end = self.width * self.dtype.itemsize, min(stop, self.stored)
            self.file.seek(start * size)
            got.append(np.frombuffer(self.file.read((end - start) * size), self.dtype).reshape(-1, self.width))
        if stop > self.stored and self.parts:
            rest = np.concatenate(self.parts) if len(self.parts) > 1 else self.parts[0]
            self.parts = [rest]
            got.append(rest[max(0, start - self.stored) : stop - self.stored])
        if not got:
            return np.zeros((self.width, 0), np.int64)
        return (np.concatenate(got) if len(got) > 1 else got[0]).astype(np.int64).T

    def blocks(self, backward: bool = False) -> Iterator[np.ndarray]:
        """What is there now, in blocks, each in the direction asked for."""
        edges = range(0, self.size, BLOCK)
        for s in reversed(edges) if backward else edges:
            rows = self.read(s, min(s + BLOCK, self.size))
            yield rows[:, ::-1] if backward else rows


def on_disk(n: int, dtype) -> np.ndarray:
    """An array in a file without a name."""
    return np.asarray(np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,))) if n else np.zeros(0, dtype)


def _spans(n: int, size: int) -> Iterator[tuple[int, int]]:
    return ((s, min(n, s + size)) for s in range(0, n, size))


def _s_types(x: np.ndarray) -> np.ndarray:
    """Whether each suffix is S; from the end, block by block."""
    n = len(x)
    out = on_disk(n, np.bool_)
    after_char, after_s = -1, False  # behind the end stands a symbol less than all
    for stop in range(n, 0, -WALK):
        start = max(0, stop - WALK)
        part = np.asarray(x[start:stop], np.int64)
        diff = np.sign(np.diff(np.append(part, after_char)))
        last = len(diff) - 1
        if diff[last] == 0:
            diff[last] = 1 if after_s else -1
        at = np.where(diff != 0, np.arange(len(diff)), len(diff))
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        out[start:stop] = diff[nearest] > 0
        after_char, after_s = int(part[0]), bool(out[start])
    return out


def _seeds(s_type: np.ndarray) -> np.ndarray:
    """Places of S suffixes after L suffixes, ascending."""
    queue = DiskQueue(1)
    for s, e in _spans(len(s_type) - 1, WALK):
        part = np.asarray(s_type[s : e + 1])
        queue.push(np.flatnonzero(part[1:] & ~part[:-1]) + s + 1)
    out, at = on_disk(queue.size, np.int64), 0
    for (rows,) in queue.blocks():
        out[at : at + len(rows)] = rows
        at += len(rows)
    return out


def _named(x: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (number of a seed, whether its substring differs from the one before) in order of the substrings.

    A substring goes up to and with the next seed. Symbols are compared with their types, so none is a proper prefix of
    another. They are packed several to a key; a part with too many seeds is dealt by its next key into files.
    """
    n, m = len(x), len(seeds)
    bits = int(2 * symbols + 2).bit_length()
    per = max(1, 62 // bits)

    def ends(i: np.ndarray) -> np.ndarray:
        return np.where(i + 1 < m, seeds[np.minimum(i + 1, m - 1)], n)

    def keys(i: np.ndarray, offset: int) -> np.ndarray:
        start, end, key = seeds[i] + offset, ends(i), np.zeros(len(i), np.int64)
        for j in range(per):
            at = start + j
            safe = np.minimum(at, n - 1)
            key = key << bits | np.where((at <= end) & (at < n), 2 * x[safe].astype(np.int64) + s_type[safe] + 1, 0)
        return key

    def in_memory(i: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        rank, active = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(active):
            key = keys(i[active], offset)
            order = np.lexsort((key, rank[active]))
            r, k = rank[active][order], key[order]
            group = np.concatenate(([True], r[1:] != r[:-1]))
            new = group | np.concatenate(([True], k[1:] != k[:-1]))
            place = np.arange(len(order))
            rank[active[order]] = r + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
            size = np.diff(np.append(np.flatnonzero(new), len(order)))
            offset += per
            more = ends(i[active[order]]) - seeds[i[active[order]]] >= offset
            active = np.sort(active[order][np.repeat(size > 1, size) & more])
        order = np.argsort(rank, kind="stable")
        return i[order], np.concatenate(([True], rank[order][1:] != rank[order][:-1]))

    def whole() -> Iterator[np.ndarray]:
        return (np.arange(s, e) for s, e in _spans(m, BLOCK))

    # Parts still to be named, the first of the order last; a part that is over has only equal substrings.
    todo: list[tuple[int, Callable[[], Iterator[np.ndarray]], int, bool]] = [(m, whole, 0, False)] if m else []
    while todo:
        size, blocks, offset, over = todo.pop()
        if over:
            first = True
            for i in blocks():
                new = np.zeros(len(i), bool)
                new[0], first = first, False
                yield i, new
        elif size <= NAMED:
            i, new = in_memory(np.concatenate(list(blocks())), offset)
            for s, e in _spans(len(i), BLOCK):
                yield i[s:e], new[s:e]
        else:
            sample = np.sort(np.concatenate([keys(i[:: 1 + size // NAMED], offset) for i in blocks()]))
            cuts = np.unique(sample[np.linspace(0, len(sample) - 1, 2 + min(MOST_GROUPS // 4, 4 * size // NAMED)).astype(int)])
            # Keys equal to a cut get a part of their own, so that a frequent key parts from its neighbours.
            parts = [DiskQueue(1) for _ in range(2 * len(cuts) + 1)]
            longest = [False] * len(parts)
            for i in blocks():
                key = keys(i, offset)
                to = np.searchsorted(cuts, key, "left") + np.searchsorted(cuts, key, "right")
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(len(parts) + 1))
                more = ends(i) - seeds[i] >= offset + per
                for p in np.flatnonzero(np.diff(edges)):
                    own = order[edges[p] : edges[p + 1]]
                    parts[p].push(i[own])
                    longest[p] |= bool(more[own].any())
            for p in range(len(parts) - 1, -1, -1):
                if parts[p].size:
                    single = p % 2 == 1  # all keys are equal: their substrings go on behind it, or all have ended
                    todo.append((parts[p].size, lambda q=parts[p]: (b[0] for b in q.blocks()), offset + per if single else offset, single and not longest[p]))


def _agree(x: np.ndarray, a: np.ndarray, b: np.ndarray, base: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, or some number over `most`, of the suffixes a and b of which `base` symbols are known to agree."""
    n, out = len(x), base.astype(np.int64).copy()
    todo = np.flatnonzero(out <= most)
    while len(todo):
        for _ in range(8):
            p, q = a[todo] + out[todo], b[todo] + out[todo]
            ok = (p < n) & (q < n)
            ok &= x[np.minimum(p, n - 1)] == x[np.minimum(q, n - 1)]
            todo = todo[ok]
            if not len(todo):
                break
            out[todo] += 1
        todo = todo[out[todo] <= most]
    return out


def _doubled(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes (or some number over `most`) of a short string, by ranks of prefixes that double.

    Ranks of 2^k symbols are equal exactly where the prefixes are, so the ranks kept from each round give the common prefixes.
    """
    n = len(x)
    sa = np.argsort(x, kind="stable")
    new = np.concatenate(([True], x[sa][1:] != x[sa][:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, k = [], 1
    while True:
        if k <= most:
            levels.append(rank.astype(np.int32))
        size = np.diff(np.append(np.flatnonzero(new), n))
        places = np.flatnonzero(np.repeat(size > 1, size))
        if not len(places):
            break
        idx = sa[places]
        nxt = np.where(idx + k < n, rank[np.minimum(idx + k, n - 1)], -1)
        order = np.lexsort((nxt, rank[idx]))
        sa[places] = idx[order]
        g, v = rank[idx][order], nxt[order]
        new[places] |= np.concatenate(([True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])))
        rank[sa[places]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[places]
        k *= 2
    lcp = np.zeros(n, np.int64)
    todo = np.arange(1, n)
    while len(todo):  # a pair that agrees in all of a round goes on with the next
        before = lcp[todo].copy()
        for k in range(len(levels) - 1, -1, -1):
            p, q = sa[todo - 1] + lcp[todo], sa[todo] + lcp[todo]
            ok = np.flatnonzero(np.maximum(p, q) + (1 << k) <= n)
            ok = ok[levels[k][p[ok]] == levels[k][q[ok]]]
            lcp[todo[ok]] += 1 << k
        todo = todo[(lcp[todo] - before == (1 << len(levels)) - 1) & (lcp[todo] <= most)]
    return sa, lcp


class _RangeMin:
    """Least value of ranges of one block (sparse table)."""

    def __init__(self, v: np.ndarray):
        self.rows = [v]
        w = 1
        while 2 * w <= len(v):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[: len(last) - w], last[w:]))
            w *= 2

    def get(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of [lo, hi]; lo <= hi."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in range(len(self.rows)):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(self.rows[k][lo[at]], self.rows[k][hi[at] - (1 << k) + 1])
        return out


def _groups(x: np.ndarray, symbols: int) -> np.ndarray:
    """First symbol of each group: several symbols with few suffixes in all, or one symbol with more."""
    count = on_disk(symbols, np.int64)
    for s, e in _spans(len(x), WALK):
        v, k = np.unique(np.asarray(x[s:e], np.int64), return_counts=True)
        count[v] += k
    most, starts, run = max(GROUP, 2 * len(x) // MOST_GROUPS), [0], 0
    for s, e in _spans(symbols, 1 << 16):
        part = np.cumsum(np.asarray(count[s:e]))
        at, before = 0, 0
        while at < len(part):
            stop = int(np.searchsorted(part, before + most - run, "right"))
            if stop == len(part):
                run += int(part[-1]) - before
                break
            if s + stop > starts[-1]:
                starts.append(s + stop)
                at, before, run = stop, int(part[stop - 1]) if stop else 0, 0
            else:  # the group's first symbol is over the limit: it stands alone
                starts.append(s + stop + 1)
                at, before, run = stop + 1, int(part[stop]), 0
    return np.array([s for s in dict.fromkeys(starts) if s < symbols], np.int64)


class _Scan:
    """One scan in the order of the symbols (`up`) or against it: what it takes induces tuples in the groups' files.

    `own` tuples are induced by the scan itself; with each symbol come others behind them, by `others(lo, hi)` in blocks
    (suffix, common prefix with the one before, as scanned) of the symbols lo to hi. `seen` gets all tuples as scanned,
    with a mark for own ones; a symbol's first tuple has no common prefix with the one before.
    """

    def __init__(self, x: np.ndarray, symbols: int, starts: np.ndarray, up: bool, most: int, others: Callable[[int, int], Iterator[np.ndarray]], seen: Callable[[np.ndarray, np.ndarray, bool], None]):
        self.x, self.symbols, self.up, self.most, self.others, self.seen = x, symbols, up, most, others, seen
        # Against the order, symbols are numbered from the greatest.
        self.starts = starts if up else np.sort(symbols - np.append(starts[1:], symbols))
        wide = len(x) >= 1 << 31
        self.queues = [DiskQueue(wide=wide) for _ in self.starts]
        # Of each symbol that tuples of one frequent symbol induced: that symbol, the block of the last source and the least common prefix after it.
        self.source, self.block, self.after = (on_disk(symbols, np.int64) for _ in range(3))
        self.source[:] = -1

    def symbol(self, pos: np.ndarray) -> np.ndarray:
        v = self.x[pos].astype(np.int64)
        return v if self.up else self.symbols - 1 - v

    def induced(self, pos: np.ndarray, symbol: np.ndarray, own: np.ndarray | bool) -> np.ndarray:
        """Symbol of the suffix that each one induces, or a great number: those before it that the scan has yet to visit."""
        before = self.symbol(np.maximum(pos - 1, 0))
        return np.where((pos > 0) & ((before > symbol) | ((before == symbol) & own)), before, _FAR)

    def push(self, to: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Tuples (symbol, suffix, common prefix), the symbols ascending."""
        if not len(to):
            return
        group = np.searchsorted(self.starts, to, "right") - 1
        edges = np.flatnonzero(group[1:] != group[:-1]) + 1
        rows, s = self.queues[-1].rows(pos, lcp), 0
        for g, e in zip(group[np.append(0, edges)].tolist(), [*edges.tolist(), len(to)], strict=True):
            self.queues[g].append(rows[s:e].copy())
            s = e

    def values(self, pos: np.ndarray, lcp: np.ndarray, to: np.ndarray, frequent: int = -1, block: int = 0, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, suffix, common prefix) of what a block induces, by symbol, then as induced.

        Tuples of several symbols are whole symbols, so a tuple induced earlier shares one symbol only. Of one `frequent`
        symbol several blocks may come; `least` has the least common prefix of the blocks after each one.
        """
        q = np.flatnonzero(to < _FAR)
        order = np.argsort(to[q], kind="stable")
        q = q[order]
        b = to[q]
        if not len(q):
            return b, b, b
        first = np.concatenate(([True], b[1:] != b[:-1]))
        heads = np.flatnonzero(first)
        if frequent < 0:
            got, more = np.zeros(len(q), np.int64), np.flatnonzero(~first)
            if len(more):
                got[more] = _RangeMin(lcp).get(q[more - 1] + 1, q[more])
        else:
            mins = _RangeMin(lcp)
            lo = np.concatenate(([0], q[:-1] + 1))
            lo[first] = 0
            got = mins.get(lo, q)
            known = self.source[b[heads]] == frequent
            at = b[heads][known]
            prior = np.zeros(len(heads), np.int64)
            prior[known] = np.minimum(self.after[at], least[self.block[at]])
            got[heads] = np.minimum(got[heads], prior)
            tails = q[np.append(heads[1:], len(q)) - 1]
            after = np.full(len(tails), _FAR)
            inner = tails + 1 < len(lcp)
            if inner.any():
                after[inner] = mins.get(tails[inner] + 1, np.full(int(inner.sum()), len(lcp) - 1))
            self.source[b[heads]], self.block[b[heads]], self.after[b[heads]] = frequent, block, after
        return b, pos[q] - 1, got + 1

    def run(self, first: int | None = None) -> None:
        """Scan everything; `first` is a suffix that is there at the start."""
        if first is not None:
            p = np.array([first], np.int64)
            self.push(self.symbol(p), p, np.zeros(1, np.int64))
        stops = np.append(self.starts[1:], self.symbols)
        for g, (lo, hi) in enumerate(zip(self.starts.tolist(), stops.tolist(), strict=True)):
            if hi - lo == 1:
                self._frequent(lo, self.queues[g], self.others(lo, hi))
            else:
                self._group(lo, hi, self.queues[g])
            self.queues[g] = None

    def _seam(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _agree(self.x, a, b, np.zeros(len(a), np.int64), self.most)

    def _frequent(self, symbol: int, queue: DiskQueue, others: Iterator[np.ndarray]) -> None:
        """A symbol's own tuples, of which there come more while they are scanned, then the others."""
        at, block, least, last = 0, 0, np.zeros(0, np.int64), -1
        while at < queue.size:
            stop = min(at + BLOCK, queue.size)
            pos, lcp = (np.array(v) for v in queue.read(at, stop))
            if at == 0:
                lcp[0] = 0
            self.seen(pos, lcp, True)
            b, p, v = self.values(pos, lcp, self.induced(pos, np.int64(symbol), True), symbol, block, least)
            least = np.append(np.minimum(least, lcp.min()), _FAR)
            if len(b):
                more = int(np.searchsorted(b, symbol, "right"))  # no less symbols are induced
                if more:
                    queue.push(p[:more], v[:more])
                if more < len(b):
                    self.push(b[more:], p[more:], v[more:])
            at, block, last = stop, block + 1, int(pos[-1])
        for pos, lcp in others:
            lcp = np.array(lcp)
            if last < 0:
                lcp[0] = 0
            elif at >= 0:
                lcp[:1] = self._seam(np.array([last]), pos[:1])
            at, last = -1, int(pos[-1])
            self.seen(pos, lcp, False)
            self.push(*self.values(pos, lcp, self.induced(pos, np.int64(symbol), False), symbol, block, least))
            least = np.append(np.minimum(least, lcp.min()), _FAR)
            block += 1

    def _group(self, lo: int, hi: int, queue: DiskQueue) -> None:
        """Several symbols, in memory: as many at a time as induce nothing among themselves."""
        other = list(self.others(lo, hi))
        pos, lcp = (np.concatenate([v, *(o[k] for o in other)]) for k, v in enumerate(queue.read(0, queue.size)))
        if not len(pos):
            return
        sym, later = self.symbol(pos), np.arange(len(pos)) >= queue.size
        # Rows: place in the order (symbol, own ones first), suffix, common prefix, symbol induced.
        key = sym * 2 + later
        order = np.argsort(key, kind="stable")
        left = np.stack((key, pos, lcp, self.induced(pos, sym, ~later)))[:, order]
        while left.shape[1]:
            key, pos, lcp, to = left[:, :LOOK]
            if len(key) < left.shape[1]:  # whole symbols
                whole = int(np.searchsorted(key, key[-1] & -2, "left")) or int(np.searchsorted(left[0], key[0] | 1, "right"))
                key, pos, lcp, to = left[:, :whole]
            sym = key >> 1
            ends = np.append(np.flatnonzero(sym[1:] != sym[:-1]), len(sym) - 1)
            safe = np.flatnonzero(np.minimum.accumulate(to)[ends] > sym[ends])
            if not len(safe):  # the first symbol induces itself
                n, o = (int(np.searchsorted(key, key[0] | 1, side)) for side in ("right", "left"))
                alone = DiskQueue(buffer=BLOCK)
                alone.push(pos[:o], lcp[:o])
                b, p, v = self._alone(int(sym[0]), alone, iter([left[1:3, o:n]] if o < n else []))
            else:
                n = int(ends[safe[-1]]) + 1
                key, pos, lcp, to = key[:n], pos[:n], lcp[:n].copy(), to[:n]
                change = np.concatenate(([True], key[1:] != key[:-1]))
                heads = np.flatnonzero(change)
                behind = (key[heads] & 1 == 1) & np.append(False, key[heads[1:]] >> 1 == key[heads[1:] - 1] >> 1)
                lcp[heads[~behind]] = 0
                seam = heads[behind]
                if len(seam):
                    lcp[seam] = self._seam(pos[seam - 1], pos[seam])
                self.seen(pos, lcp, key & 1 == 0)
                b, p, v = self.values(pos, lcp, to)
            left = left[:, n:]
            if not len(b):
                continue
            inside = int(np.searchsorted(b, hi, "left"))
            self.push(b[inside:], p[inside:], v[inside:])
            if inside:  # behind the own tuples of their symbol that are there
                b, p, v = b[:inside], p[:inside], v[:inside]
                at = np.searchsorted(left[0], b * 2, "right")
                left = np.insert(left, at, np.stack((b * 2, p, v, self.induced(p, b, True))), axis=1)

    def _alone(self, symbol: int, queue: DiskQueue, others: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A symbol of a group by itself; gives what it induces in other symbols, by symbol."""
        kept, got = self.push, []
        self.push = lambda *columns: got.append(columns)
        self._frequent(symbol, queue, others)
        self.push = kept
        b, p, v = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*got, strict=True) if got else ((), (), ())))
        order = np.argsort(b, kind="stable")
        return b[order], p[order], v[order]


def induce(x: np.ndarray, symbols: int, most: int = 1 << 60) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (suffix, common prefix with the one before) of all suffixes of x, ascending. Symbols are 0 .. symbols - 1.

    Common prefixes over `most` may be given as any number over it, which saves time on text with long repeats.
    """
    n = len(x)
    if not n:
        return
    s_type = _s_types(x)
    seeds = _seeds(s_type)
    by, shared = _sorted_seeds(x, s_type, seeds, symbols, most)
    del seeds, s_type
    starts = _groups(x, symbols)
    wide = n >= 1 << 31

    # Both lists are read in their order, each symbol once, so a place in them is all that is kept.
    place = [0]

    def seeds_of(lo: int, hi: int) -> Iterator[np.ndarray]:
        while place[0] < len(by):
            s, e = place[0], min(place[0] + BLOCK, len(by))
            pos = np.asarray(by[s:e], np.int64)
            k = int(np.searchsorted(x[pos], hi, "left"))
            if not k:
                return
            place[0] = s + k
            yield np.stack((pos[:k], np.asarray(shared[s : s + k], np.int64)))

    found = DiskQueue(buffer=BLOCK, wide=wide)  # L suffixes, ascending

    def keep(pos: np.ndarray, lcp: np.ndarray, own: np.ndarray | bool) -> None:
        if own is True:
            found.push(pos, lcp)
        elif own is not False and own.any():
            found.push(pos[own], lcp[own])

    # Of tuples of a symbol that follow each other in `found`, the second's common prefix is the one with the first.
    _Scan(x, symbols, starts, True, most, seeds_of, keep).run(first=n - 1)
    left = [found.size]

    def great_of(lo: int, hi: int) -> Iterator[np.ndarray]:
        least = symbols - hi  # in the order of the symbols
        while left[0]:
            e = left[0]
            s = max(0, e - BLOCK)
            pos, lcp = found.read(s, min(e + 1, found.size))
            above = lcp[1:] if e < found.size else np.append(lcp[1:], 0)  # a tuple's common prefix with the greater one
            pos = pos[: e - s]
            k = int((x[pos] >= least).sum())
            if not k:
                return
            left[0] = e - k
            yield np.stack((pos[::-1][:k], above[::-1][:k]))

    out = DiskQueue(buffer=BLOCK, wide=wide)
    _Scan(x, symbols, starts, False, most, great_of, lambda pos, lcp, own: out.push(pos, lcp)).run()
    # The last scan saw all suffixes from the greatest: a tuple's common prefix is with the one after it.
    for e in range(out.size, 0, -BLOCK):
        s = max(0, e - BLOCK)
        pos, lcp = out.read(s, min(e + 1, out.size))
        before = lcp[1:] if e < out.size else np.append(lcp[1:], 0)
        yield pos[: e - s][::-1], before[::-1]


def _sorted_seeds(x: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, symbols: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds in suffix order and their common prefixes, from the string of names, sorted in turn where names repeat."""
    m = len(seeds)
    order, shared = on_disk(m, np.int64), on_disk(m, np.int64)
    names = on_disk(m, np.int32 if m < 1 << 31 else np.int64)
    at, count = 0, 0
    for i, new in _named(x, s_type, seeds, symbols):
        name = count + np.cumsum(new) - 1
        names[i] = name
        order[at : at + len(i)] = i
        at, count = at + len(i), int(name[-1]) + 1
    if count < m <= IN_MEMORY:
        order[:], shared[:] = _doubled(np.asarray(names, np.int64), most // 2 + 1)
    elif count < m:
        at = 0
        for pos, lcp in induce(names, count, most // 2 + 1):  # a name stands for two symbols at least
            order[at : at + len(pos)], shared[at : at + len(pos)] = pos, lcp
            at += len(pos)
    del names
    by, lcps, last = on_disk(m, np.int64), on_disk(m, np.int64), None
    for s, e in _spans(m, BLOCK):
        o, k = np.asarray(order[s:e]), np.asarray(shared[s:e])
        pos = np.asarray(seeds[o])
        # Shared names give a stretch of text; the rest, within one substring, is compared.
        stop = o + k
        known = np.where(stop < m, seeds[np.minimum(stop, m - 1)], len(x)) - pos
        prev = np.concatenate(([pos[0] if last is None else last], pos[:-1]))
        lcp = _agree(x, prev, pos, known, most)
        if last is None:
            lcp[0] = 0
        by[s:e], lcps[s:e], last = pos, lcp, int(pos[-1])
    return by, lcps
