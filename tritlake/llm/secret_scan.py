"""Secret scans with one combined deterministic automaton.

Every rule is a regular expression over bytes. All rules are compiled together: Thompson NFAs, subset construction
over byte classes, minimisation by partition refinement, and a flat transition list. The combined automaton reads the
text once, from its last byte to its first, over the reversed rules: a state's accept mask then names the rules that
have a match *starting* at that byte. From the leftmost start of each rule its own small automaton runs forward to the
longest end, which gives leftmost non-overlapping matches; a filter on the value's length may then drop a match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, per_text, table


@dataclass(frozen=True)
class Rule:
    """`pattern` is what is scanned for. `head`, if given, is the part before the value; the value (or else the match) must have `least` bytes."""

    name: str
    pattern: str
    head: str = ""
    least: int = 0


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_ASSIGN_HEAD = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")[\"']?\\x20*[:=]\\x20*[\"']?"

# The base kinds, in the order in which they are listed. A run of hex digits that is too short can hide no
# longer one, so there the least length is part of the pattern. Elsewhere it is a filter, which keeps the automaton small.
BASE_RULES = (
    Rule("assign", _ASSIGN_HEAD + "[A-Za-z0-9+/_.=\\-]+", _ASSIGN_HEAD, 6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),
)
# Further kinds of public token formats.
MORE_RULES = (
    Rule("hosted_git", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat_bot", "xox[abprs]-[A-Za-z0-9\\-]+", least=15),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", least=40),
)
RULES = BASE_RULES + MORE_RULES


class _Pattern:
    """Parser of a rule: signs, escapes, classes, groups, | and the repeats ? * + {m,n}. Gives nested tuples.

    ("set", bytes), ("all", parts), ("any", options), ("repeat", part, least, most or None).
    """

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def parse(self) -> tuple:
        out = self._options()
        if self.at < len(self.text):
            raise ValueError(f"not supported in a rule: {self.text[self.at :]}")
        return out

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _options(self) -> tuple:
        options = [self._parts()]
        while self._peek() == "|":
            self._take()
            options.append(self._parts())
        return ("any", options)

    def _parts(self) -> tuple:
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._repeated(self._one()))
        return ("all", parts)

    def _one(self) -> tuple:
        c = self._take()
        if c == "(":
            inner = self._options()
            if self._peek() != ")":
                raise ValueError("a group is open")
            self._take()
            return inner
        if c == "[":
            return ("set", self._class())
        if c in ".^$?*+{":
            raise ValueError(f"not supported in a rule: {c}")
        return ("set", frozenset([self._byte(c)]))

    def _byte(self, c: str) -> int:
        if c != "\\":
            return ord(c)
        c = self._take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"not supported in a rule: \\{c}")
        return ord(c)

    def _class(self) -> frozenset[int]:
        out: set[int] = set()
        while self._peek() != "]":
            first = last = self._byte(self._take())
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self._take()
                last = self._byte(self._take())
            out.update(range(first, last + 1))
        self._take()
        return frozenset(out)

    def _repeated(self, part: tuple) -> tuple:
        while self._peek() and self._peek() in "?*+{":
            c = self._take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, _, high = self.text[self.at : end].partition(",")
                bounds = (int(low), int(high) if high else None if "," in self.text[self.at : end] else int(low))
                self.at = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            part = ("repeat", part, *bounds)
        return part


class _Nfa:
    """Thompson construction over byte sets; `reverse` builds the automaton of the reversed language."""

    def __init__(self, reverse: bool):
        self.reverse, self.eps, self.step = reverse, [], []

    def state(self) -> int:
        self.eps.append([])
        self.step.append([])
        return len(self.eps) - 1

    def add(self, node: tuple, start: int) -> int:
        """Append what a parsed node stands for behind `start`; gives the end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.step[start].append((node[1], end))
            return end
        if kind == "all":
            for part in reversed(node[1]) if self.reverse else node[1]:
                start = self.add(part, start)
            return start
        if kind == "any":
            end = self.state()
            for option in node[1]:
                first = self.state()
                self.eps[start].append(first)
                self.eps[self.add(option, first)].append(end)
            return end
        _, body, low, high = node
        for _ in range(low):
            start = self.add(body, start)
        if high is None:
            loop = self.state()
            self.eps[start].append(loop)
            self.eps[self.add(body, loop)].append(loop)
            return loop
        ends = [start]
        for _ in range(high - low):
            ends.append(self.add(body, ends[-1]))
        for e in ends[:-1]:
            self.eps[e].append(ends[-1])
        return ends[-1]


@dataclass(frozen=True)
class Dfa:
    """`step[state + classes[byte]]` is the next state; states are multiples of the number of classes.

    Accepting states come last, from `accepting` on; `mask[state // width]` has a bit for each rule. State 0 is the start;
    `dead` is the state without a way out, or -1.
    """

    classes: bytes
    width: int
    step: list[int]
    mask: list[int]
    accepting: int
    start: int
    dead: int


def compile_rules(patterns: list[str], reverse: bool, search: bool) -> Dfa:
    """One minimal automaton of all patterns; with `search` it may begin a match at any byte."""
    nfa = _Nfa(reverse)
    start, ends = nfa.state(), {}
    for k, p in enumerate(patterns):
        first = nfa.state()
        nfa.eps[start].append(first)
        ends[nfa.add(_Pattern(p).parse(), first)] = 1 << k
    sets = {s for steps in nfa.step for s, _ in steps}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    number = {sig: k for k, sig in enumerate(dict.fromkeys(signature))}
    classes, sample = bytes(number[s] for s in signature), {number[s]: b for b, s in reversed(list(enumerate(signature)))}
    width = len(number)

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    first = closure([start])
    ids, order, table_, masks = {first: 0}, [first], [], []
    for subset in order:  # grows while it is walked
        masks.append(sum({ends[s] for s in subset if s in ends}))
        row = []
        for c in range(width):
            to = {t for s in subset for chars, t in nfa.step[s] if sample[c] in chars}
            nxt = closure(to | ({start} if search else set()))
            if nxt not in ids:
                ids[nxt] = len(order)
                order.append(nxt)
            row.append(ids[nxt])
        table_.append(row)

    # Minimisation: refine the partition by accept mask until no class of states splits.
    part = masks
    while True:
        keys = [(part[i], *(part[t] for t in row)) for i, row in enumerate(table_)]
        names = {k: n for n, k in enumerate(dict.fromkeys(keys))}
        refined = [names[k] for k in keys]
        if len(names) == len(set(part)):
            break
        part = refined
    first_of = {}
    for i, p in enumerate(refined):
        first_of.setdefault(p, i)
    ranked = sorted(first_of, key=lambda p: masks[first_of[p]] > 0)
    place = {p: k for k, p in enumerate(ranked)}
    step = [place[refined[t]] * width for p in ranked for t in table_[first_of[p]]]
    mask = [masks[first_of[p]] for p in ranked]
    dead = next((k * width for k in range(len(ranked)) if not mask[k] and all(t == k * width for t in step[k * width : (k + 1) * width])), -1)
    return Dfa(classes, width, step, mask, sum(m == 0 for m in mask) * width, place[refined[0]] * width, dead)


def _longest(d: Dfa, data: bytes, at: int) -> int:
    """End of the longest match that starts at `at`, or -1."""
    s, end, step, classes, accepting, dead = d.start, -1, d.step, d.classes, d.accepting, d.dead
    for i in range(at, len(data)):
        s = step[s + classes[data[i]]]
        if s >= accepting:
            end = i + 1
        elif s == dead:
            break
    return end


class SecretScanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.starts = compile_rules([r.pattern for r in rules], reverse=True, search=True)
        self.full = [compile_rules([r.pattern], reverse=False, search=False) for r in rules]
        self.head = [compile_rules([r.head], reverse=False, search=False) if r.head else None for r in rules]

    def scan_bytes(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in byte offsets, sorted."""
        d = self.starts
        s, step, accepting, hits = d.start, d.step, d.accepting, []
        for i, c in enumerate(data[::-1].translate(d.classes)):
            s = step[s + c]
            if s >= accepting:
                hits.append((i, s))
        if not hits:
            return []
        out, free, last = [], [0] * len(self.rules), len(data) - 1
        for i, s in reversed(hits):
            at, mask = last - i, d.mask[s // d.width]
            for k, rule in enumerate(self.rules):
                if mask >> k & 1 and at >= free[k]:
                    end = free[k] = _longest(self.full[k], data, at)
                    value = _longest(self.head[k], data, at) if self.head[k] else at
                    if end - value >= rule.least:
                        out.append((at, k, end))
        return sorted(out)

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, sorted by start, then by the order of the rules."""
        data, at, chars, out, place = text.encode("utf-8", "surrogatepass"), 0, 0, [], {}
        found = self.scan_bytes(data)
        for b in sorted({x for s, _, e in found for x in (s, e)}):
            chars += len(data[at:b].decode("utf-8", "surrogatepass"))
            at, place[b] = b, chars
        for s, k, e in found:
            out.append((self.rules[k].name, place[s], place[e]))
        return out

    def redact(self, text: str) -> str:
        """The text with each found span (overlapping ones as one) replaced by [REDACTED]."""
        parts, at, open_at = [], 0, -1
        for _, s, e in sorted(self.scan(text), key=lambda x: x[1:]):
            if s >= at or open_at < 0:
                parts += [text[at:s], "[REDACTED]"]
                open_at = s
            at = max(at, e)
        return "".join([*parts, text[at:]])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, spans. See the module for the method.

    A null or empty text has no spans (counts 0, the digest of the empty string). Repeated rows give repeated rows, a null
    id stays null; other columns of `docs` are ignored; an empty table gives no rows; very long texts are read byte by byte. Narrow: no shuffle, one pass, and a lost task is simply run again.
    """
    base = {r.name for r in BASE_RULES}

    def make() -> Callable[[str], tuple]:
        scanner = SecretScanner(rules)

        def one(text: str) -> tuple:
            spans = scanner.scan(text)
            own = [x for x in spans if x[0] in base]
            n = {b: sum(x[0] == b for x in own) for b in base}
            return n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(spans)

        return one

    schema = pa.schema([("__id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
    return per_text(id_and_text(docs, id_col, text_col), id_col, make, schema, "__id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns; secrets in `text_col` become [REDACTED].

    A null text stays null, an empty one empty; repeated rows, other columns whatever their names and an empty table stay as they are.
    """
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = SecretScanner(rules)
        for b in batches:
            clean = pa.array([scanner.redact(t.as_py()) if t.is_valid else None for t in b.column(k)], pa.string())
            yield pa.RecordBatch.from_arrays([clean if i == k else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with all rules; odd rows as in find_secrets."""
    return find_secrets(table(spark, sf_dir, "documents"))
