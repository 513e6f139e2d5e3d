"""Token counts from a BPE vocabulary compiled to a deterministic transducer.

Compilation.  A text is read left to right.  After each character the last token of the BPE of what was
read is the one suffix t for which the pair (last token before t, t) stays apart under BPE; the count is
one more than before t.  Only positions where a piece that is still growing may begin matter, so a state
is that longest growing suffix with the last token and the relative count at each of its positions:
finitely many.  Each transition (state, character) is annotated with the number of tokens it emits
(negative where a merge takes some back).  States, transitions and pair checks are made on first use.

Synchronisation.  No piece holds a space mark after another character, so before a space mark that
follows one the transducer is back in its start state, as it is around characters that are in no longer
piece.  Runs between such points (units, nearly words) are paths from start to start; their sums are kept
as single transitions.

Chunks.  A chunk of text is a state map: from the state in which the transducer enters it to the state in which it leaves it and the tokens it
emits.  A chunk with a synchronising point leaves in one state whatever it was entered in, so its map is that state, the tokens from the
point on, and the few characters before the point, which are walked once the entry state is known; a chunk without one is walked
whole.  Maps compose associatively, and a prefix scan (log2(chunks) rounds up and down) gives the map of every beginning of the text; the last
one, applied to the start state, is the count.

Edge cases: null and empty texts have 0 tokens; unknown characters cost a token for each UTF-8 byte; texts
of any length are counted whole; repeated rows are counted each; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, table, texts, tidy

MARK = "▁"
START = ""
#: Units kept as single transitions, and states, before the tables are begun anew.
MAX_UNITS, MAX_STATES = 700_000, 300_000
CHUNK = 1 << 14  # characters of a chunk
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_SYNC = re.compile(f"(?<=[^{MARK}]){MARK}")


class Vocabulary:
    """Pieces with their merge order (the lower, the earlier; ties merge leftmost first)."""

    def __init__(self, order: dict[str, float], unknown_cost=lambda c: len(c.encode("utf-8", "surrogatepass"))):
        self.order, self.unknown_cost = order, unknown_cost
        self.heads = {p[:i] for p in order for i in range(1, len(p) + 1)}
        self.inside = {c for p in order if len(p) > 1 for c in p}  # characters that may merge
        self._apart: dict[tuple[str, str], bool] = {}

    @classmethod
    def sentencepiece(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        out = cls({sp.id_to_piece(i): -sp.get_score(i) for i in ids})
        bad = [p for p in out.order if MARK in p.lstrip(MARK)]
        if bad:
            raise ValueError(f"a space mark inside pieces such as {bad[0]!r}: no synchronising points")
        return out

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string, for compiling."""
        parts, order = list(text), self.order
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                o = order.get(parts[i] + parts[i + 1])
                if o is not None and (best is None or o < best):
                    best, at = o, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether BPE leaves left and right as two tokens side by side."""
        key = (left, right)
        if key not in self._apart:
            if len(self._apart) > 4 * MAX_STATES:
                self._apart.clear()
            self._apart[key] = self.merge(left + right) == ([left, right] if left else [right])
        return self._apart[key]


class State:
    __slots__ = ("suffix", "lasts", "counts", "next")

    def __init__(self, suffix: str, lasts: tuple[str, ...], counts: tuple[int, ...]):
        self.suffix, self.lasts, self.counts = suffix, lasts, counts
        self.next: dict[str, tuple[State, int]] = {}


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.start = State("", (START,), (0,))
        self.states: dict[tuple, State] = {}

    def step(self, state: State, char: str) -> tuple[State, int]:
        """The transition on a character that may merge, and its emitted tokens."""
        v, s = self.v, state.suffix + char
        for k in range(len(s)):
            t = s[k:]
            if (len(t) == 1 or t in v.order) and v.apart(state.lasts[k], t):
                break
        emitted = state.counts[k] + 1
        lasts, counts = (*state.lasts, t), (*state.counts, emitted)
        first = next((i for i in range(len(s)) if s[i:] in v.heads), len(s))
        key = (s[first:], lasts[first:], tuple(c - emitted for c in counts[first:]))
        if key not in self.states:
            self.states[key] = State(*key)
        state.next[char] = (self.states[key], emitted)
        return state.next[char]

    def count(self, unit: str) -> int:
        """Tokens of a run between synchronising points."""
        if len(self.states) > MAX_STATES:
            self.reset()
        state, total, v = self.start, 0, self.v
        for c in unit:
            if c in v.inside:
                state, emitted = state.next.get(c) or self.step(state, c)
                total += emitted
            else:  # nothing merges across it
                total += 1 if c in v.order else v.unknown_cost(c)
                state = self.start
        return total


class Units(dict):
    """Tokens of a text without spaces that follows a space, by that text; made on first use."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.t = transducer

    def __missing__(self, word: str) -> int:
        if not word:  # two spaces in a row: not a unit of its own
            raise _Runs
        if "\n" in word and "\n" not in self.t.v.inside:  # nothing merges across a line's end
            first, *rest = word.split("\n")
            cost = 1 if "\n" in self.t.v.order else self.t.v.unknown_cost("\n")
            return (self[first] if first else self.t.count(MARK)) + sum(self.bare(x) + cost for x in rest)
        if len(self) >= MAX_UNITS:
            self.clear()
        self[word] = n = self.t.count(MARK + word)
        return n

    def bare(self, word: str) -> int:
        """Tokens of a text that follows a line's end."""
        key = " " + word  # no unit has a space
        n = self.get(key)
        if n is None:
            self[key] = n = self.t.count(word)
        return n


class _Runs(Exception):
    pass


class Place(NamedTuple):
    """Where the transducer is: its state, and whether the character before was no space mark (so that a mark synchronises)."""

    state: State
    after: bool


class ChunkMap:
    """What a chunk does from any entry: the characters up to its first synchronising point, then tokens and the exit, which are the same
    for all entries.  Without such a point, ``exit`` is None and ``head`` is the whole chunk (or several)."""

    __slots__ = ("head", "body", "exit")

    def __init__(self, head: tuple[str, ...], body: int = 0, exit: Place | None = None):
        self.head, self.body, self.exit = head, body, exit

    @classmethod
    def of(cls, text: str, counter: Counter) -> ChunkMap:
        first = _SYNC.search(text)
        if first is None:
            return cls((text,))
        last = max(first.start(), *(m.start() for m in _SYNC.finditer(text, first.start())))
        place, n = counter.walk(counter.begin(), text[last:])
        return cls((text[: first.start()],), counter.closed(text[first.start() : last]) + n, place)

    def apply(self, entry: Place, counter: Counter) -> tuple[Place, int]:
        """(exit, tokens) from an entry."""
        total = 0
        for text in self.head:
            entry, n = counter.walk(entry, text)
            total += n
        return (entry, total) if self.exit is None else (self.exit, total + self.body)

    def then(self, other: ChunkMap, counter: Counter) -> ChunkMap:
        if self.exit is None:
            return ChunkMap(self.head + other.head, other.body, other.exit)
        place, n = other.apply(self.exit, counter)
        return ChunkMap(self.head, self.body + n, place)


def prefix_scan(maps: list[ChunkMap], counter: Counter) -> list[ChunkMap]:
    """Inclusive scan: pairs are composed, their scan taken, and what lies between filled in; about two compositions a map, and those of one
    round are independent of one another."""
    if len(maps) < 2:
        return maps
    inner = prefix_scan([maps[i].then(maps[i + 1], counter) for i in range(0, len(maps) - 1, 2)], counter)
    return [maps[0], *(inner[i // 2] if i % 2 else inner[i // 2 - 1].then(maps[i], counter) for i in range(1, len(maps)))]


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.units = Units(Transducer(vocabulary))

    def closed(self, marked: str) -> int:
        """Tokens of text (with space marks) between two synchronising points."""
        return sum(self.units.t.count(u) for u in _UNIT.findall(marked))

    def begin(self) -> Place:
        return Place(self.units.t.start, False)

    def walk(self, place: Place, text: str) -> tuple[Place, int]:
        """(where a text leads from a place, tokens on the way), character by character."""
        t, (state, after), total = self.units.t, place, 0
        for c in text:
            if after and c == MARK:
                state = t.start
            after = c != MARK
            if c in t.v.inside:
                state, emitted = state.next.get(c) or t.step(state, c)
                total += emitted
            else:
                total += 1 if c in t.v.order else t.v.unknown_cost(c)
                state = t.start
        return Place(state, after), total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(text) <= CHUNK and MARK not in text:  # one chunk from the start state: its units side by side
            try:
                return sum(map(self.units.__getitem__, text.split(" ")))
            except _Runs:
                pass
        marked = MARK + text.replace(" ", MARK)
        maps = [ChunkMap.of(marked[i : i + CHUNK], self) for i in range(0, len(marked), CHUNK)]
        return prefix_scan(maps, self)[-1].apply(self.begin(), self)[1]


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(Vocabulary.sentencepiece(path))


def count_tokens(documents: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; ``model`` is the path of a vocabulary file present on every executor."""


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for b in batches:
            raw = texts(b.column(1))
            n = [counter.count(t.decode()) for t in raw]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(t) for t in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        tidy()

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(bounded(spark), sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
