"""Token counts from a compiled finite-state view of a word-level BPE tokenizer.

A sequence of tokens is the encoding of a word exactly if each neighbouring pair of tokens is the encoding of its own
concatenation. So the encoding of a longer prefix ends with a token that fits behind the last token of a shorter one, and a
deterministic transducer reads a word letter by letter: its state is, for each end of the read part that may still begin a
token, the last token before it and how many tokens fewer it has. A transition is annotated with the change of the count.
States and transitions are compiled when they are first met and kept; so are the counts of short words.

The splitter has states of its own: between pieces, or in a run of letters or of other signs, with the transducer's state.
A chunk of text maps the state before it to a count and the state behind it. From the first place on where a piece begins
whatever stands before, neither depends on the state before the chunk, so the map is (head, count, state behind); a chunk
without such a place is all head. Maps compose associatively, by running a head from the state before it; a long text is cut
into chunks, and the up-sweep of a prefix scan composes their maps. A map holds places and a state, never text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, per_text, table

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
#: Characters of a chunk; words whose counts a task keeps; states of the transducer that it keeps.
CHUNK, KEPT_WORDS, KEPT_STATES = 1 << 16, 1 << 20, 1 << 17

# The tokenizer's white space and its split pattern.
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}]+|[\\p{{N}}]|[^{_SPACE}\\p{{L}}\\p{{N}}]+"
_ASCII_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\x09-\\x0D\\x20a-z0-9]+"
# A piece begins here whatever stands before: behind white space and digits, and where letters end or, but for an apostrophe, begin.
_OTHER = f"[^{_SPACE}\\p{{L}}\\p{{N}}]"
_FRESH = f"(?<=[{_SPACE}\\p{{N}}])|(?<=\\p{{L}})(?!\\p{{L}})|(?<={_OTHER})(?=[{_SPACE}\\p{{N}}])|(?<=[^{_SPACE}\\p{{L}}\\p{{N}}'])(?=\\p{{L}})"


def _byte_letters() -> dict[int, str]:
    """Each byte's stand-in letter: itself where it prints in Latin-1, else the next letter from code point 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printing)]
    return {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(rest)}


State = tuple[tuple[str, str, int], ...]


class BpeTransducer:
    """Number of tokens of a word. A state is a tuple of (end of the read part, last token before it, tokens fewer), longest end first.

    Merges happen in the order of their ranks. A token's right spine holds the parts that stand at its right end while it
    is merged, each with the rank at which it is used up; its left spine likewise. Two neighbours hold as a pair exactly if
    no merge of a part of the one's right spine with a part of the other's left spine comes before either part is used up.
    """

    def __init__(self, merges: list[tuple[str, str]], vocab: set[str]):
        self.rank = {tuple(m): k for k, m in enumerate(merges)}
        self.letters = _byte_letters()
        self.end = "</w>"
        self.holds: dict[tuple[str, str], bool] = {}
        never = len(merges)
        self.right: dict[str, list[tuple[str, int]]] = {}
        self.left: dict[str, list[tuple[str, int]]] = {}
        for c in self.letters.values():
            for t in (c, c + self.end):
                self.right[t] = self.left[t] = [(t, never)]
        # A merge's product is a token that can be met if its two parts can and nothing between them comes earlier.
        for k, (a, b) in enumerate(merges):
            if a in self.right and b in self.left and a + b not in self.right and not self._crosses(a, b, k):
                self.right[a + b] = [*self.right[b][:-1], (b, k), (a + b, never)]
                self.left[a + b] = [*self.left[a][:-1], (a, k), (a + b, never)]
        self.tokens = self.right.keys() & vocab
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t.removesuffix(self.end)) + 1)}
        self.bytes = dict(self.letters)
        self.start: State = (("", "", 0),)
        self.steps: dict[State, dict[str, tuple]] = {}
        self.ends: dict[State, int] = {}

    def _crosses(self, a: str, b: str, before: int) -> bool:
        """Whether a part of a's right end and one of b's left end merge, and with a rank less than `before`.

        Equal merges go from the left: one inside `a` comes before, one inside `b` after the one across.
        """
        rank = self.rank
        for x, x_used in self.right[a]:
            for y, y_used in self.left[b]:
                r = rank.get((x, y))
                if r is not None and r < before and r < x_used and r <= y_used:
                    return True
        return False

    def _follows(self, a: str, b: str) -> bool:
        key = (a, b)
        held = self.holds.get(key)
        if held is None:
            if len(self.holds) >= 4 * KEPT_WORDS:
                self.holds.clear()
            held = self.holds[key] = not self._crosses(a, b, len(self.rank))
        return held

    def _step(self, state: State, letter: str) -> tuple[State, int]:
        """The transition over a letter: next state, change of the count."""
        for end, last, fewer in state:
            token = end + letter
            if token in self.tokens and (not last or self._follows(last, token)):
                change = 1 - fewer
                break
        kept = [(end + letter, last, fewer + change) for end, last, fewer in state if end + letter in self.prefixes]
        return (*kept, ("", token, 0)), change

    def finish(self, state: State) -> int:
        """Change of the count where the word ends: its last token is one that ends words. 0 for an empty word."""
        got = self.ends.get(state)
        if got is None:
            got = 0
            for end, last, fewer in state:
                if end and end + self.end in self.tokens and (not last or self._follows(last, end + self.end)):
                    got = 1 - fewer
                    break
            if len(self.ends) >= KEPT_STATES:
                self.ends.clear()
            self.ends[state] = got
        return got

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state behind a part of a word, and the change of the count."""
        letters = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes)
        total, steps = 0, self.steps
        own = steps.get(state)
        if own is None:
            own = steps.setdefault(state, {})
        for c in letters:
            to = own.get(c)
            if to is None:
                if len(steps) >= KEPT_STATES:
                    steps.clear()
                nxt, change = self._step(state, c)
                to = own[c] = (nxt, change, steps.setdefault(nxt, {}))
            state, change, own = to
            total += change
        return state, total

    def count(self, word: str) -> int:
        state, n = self.run(self.start, word)
        return n + self.finish(state)


class _Counts(dict):
    """Counts of the words read before; a word is run through the transducer when it is first met."""

    def __init__(self, run: Callable[[str], int]):
        self.run = run

    def __missing__(self, word: str) -> int:
        n = self.run(word)
        if len(word) < 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does: its head, places [start, stop) of the text, is run from the state before; `count` tokens follow.

    `behind` is the splitter's state behind the chunk, (kind of the open run, the transducer's state), or None where the
    chunk is all head.
    """

    start: int
    stop: int
    count: int
    behind: tuple[str, State] | None


class Splitter:
    """Maps of the chunks of one normalised text, and their composition."""

    def __init__(self, counter: TokenCounter, text: str):
        self.text, self.counter = text, counter
        self.split = counter.ascii_split if text.isascii() else counter.split

    def _fresh(self, at: int) -> bool:
        return at in (0, len(self.text)) or self.counter.fresh.match(self.text, at, at + 1) is not None

    def edges(self, size: int) -> list[int]:
        """Ends of chunks; none is within a contraction."""
        t, out, at = self.text, [0], 0
        while at + size < len(t):
            at += size
            if self.counter.kind(t[at]) == "letter":
                if t[at - 1] == "'":
                    at -= 1
                elif t[at - 2] == "'" and self.counter.kind(t[at - 1]) == "letter":
                    at -= 2
            out.append(at)
        return [*out, len(t)]

    def _advance(self, state: tuple[str, State], start: int, stop: int) -> tuple[int, tuple[str, State]]:
        """Tokens that end in [start, stop) and the state behind, from the state before."""
        kind, word = state
        bpe, done, n = self.counter.word, self._fresh(stop), 0
        if kind:
            m = self.counter.runs[kind].match(self.text, start, stop)
            for at in range(start, m.end(), CHUNK):
                word, k = bpe.run(word, self.text[at : min(at + CHUNK, m.end())])
                n += k
            start = m.end()
            if start == stop and not done:
                return n, (kind, word)
            n += bpe.finish(word)
        pieces = self.split.findall(self.text, start, stop)
        behind = ("", bpe.start)
        if pieces and not done:
            kind = self.counter.kind(pieces[-1][0])
            if kind == "letter" or (kind == "other" and not (len(pieces[-1]) > 1 and self.counter.kind(pieces[-1][-1]) == "letter")):
                word, k = bpe.run(bpe.start, pieces.pop())
                behind, n = (kind, word), n + k
        return n + sum(map(self.counter.known.__getitem__, pieces)), behind

    def map_of(self, start: int, stop: int) -> ChunkMap:
        head = start
        if not self._fresh(start):
            m = self.counter.fresh.search(self.text, start + 1, min(stop + 1, len(self.text)))
            if stop == len(self.text) and m is None:
                return ChunkMap(start, stop, 0, ("", self.counter.word.start))
            if m is None or m.start() > stop:
                return ChunkMap(start, stop, 0, None)
            head = m.start()
        return ChunkMap(start, head, *self._advance(("", self.counter.word.start), head, stop))

    def then(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of both chunks, a before b."""
        if a.behind is None:
            return ChunkMap(a.start, b.stop, b.count, b.behind)
        n, behind = self._advance(a.behind, b.start, b.stop)
        return ChunkMap(a.start, a.stop, a.count + n + b.count, behind if b.behind is None else b.behind)

    def composed(self, size: int) -> ChunkMap:
        """The map of the whole text: the up-sweep of a prefix scan, neighbours by neighbours."""
        edges = self.edges(size)
        maps = [self.map_of(s, e) for s, e in zip(edges, edges[1:], strict=False)]
        while len(maps) > 1:
            maps = [self.then(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]


class TokenCounter:
    def __init__(self, path: str, chunk: int = CHUNK):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("a word-level BPE tokenizer with </w> is expected")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.word = BpeTransducer(merges, set(spec["model"]["vocab"]))
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.split, self.ascii_split = regex.compile(_SPLIT), re.compile(_ASCII_SPLIT)
        self.fresh = regex.compile(_FRESH)
        self.runs = {"letter": regex.compile("\\p{L}*"), "other": regex.compile(f"{_OTHER}*")}
        self.chunk = max(chunk, 4)
        self.known = _Counts(self.word.count)

    def _pieces(self, text: str) -> int:
        """Tokens of a normalised text whose ends are word ends."""
        return sum(map(self.known.__getitem__, (self.ascii_split if text.isascii() else self.split).findall(text)))

    def kind(self, sign: str) -> str:
        """letter, other, or "" for digits and white space, behind which a piece begins."""
        return next((k for k, r in self.runs.items() if r.fullmatch(sign)), "")

    def _plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        if "Σ" in text:  # lower-cased letter by letter: a final sigma gets no form of its own
            text = text.replace("Σ", "σ")
        text = text.lower()
        if len(text) <= self.chunk:
            return self._pieces(text)
        whole = Splitter(self, text).composed(self.chunk)
        return whole.count + self.word.finish(whole.behind[1])

    def count(self, text: str) -> int:
        if self.special is None or "<|" not in text:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total, at = total + self._plain(text[at : m.start()]) + 1, m.end()
        return total + self._plain(text[at:])


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens; texts of only white space have bytes and no tokens. Repeated rows give
    repeated rows, a null id stays null, extra columns are ignored, and an empty table gives no rows. A text is read by one
    task in memory that is a few times its size, white space or not. The tokenizer file must be readable on the executors.
    """

    def make() -> Callable[[str], tuple]:
        counter = TokenCounter(tokenizer_path, chunk)

        def one(text: str) -> tuple:
            n = counter.count(text)
            return len(text.encode("utf-8", "surrogatepass")), n, n > limit

        return one

    schema = pa.schema([("__id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return per_text(id_and_text(docs, id_col, text_col), id_col, make, schema, "__id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the word-level tokenizer; odd rows as in count_tokens."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
