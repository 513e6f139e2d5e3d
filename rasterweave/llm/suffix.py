"""Generalised suffix automaton over sequences of integers (word ids or hashes)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np


class SuffixAutomaton:
    """The smallest automaton of all runs of the sequences added."""

    def __init__(self, sequences: Iterable[Sequence[int]] = ()):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for x in sequences:
            self.add(x)

    def add(self, sequence: Sequence[int]) -> list[int]:
        """Add a sequence; the states of its beginnings."""
        last, out = 0, []
        for w in sequence:
            last = self._extend(last, w)
            out.append(last)
        return out

    def _new(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the runs that reach it through p by its shortest way."""
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:  # there from an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def cover(self, sequence: Sequence[int], least: int) -> list[tuple[int, int]]:
        """Stream a sequence for its matching statistics: maximal (begin, end) covered by matches of ``least`` or more."""
        nxt, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        begin = end = -1
        s = n = 0
        for i, w in enumerate(sequence, 1):
            t = nxt[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(w)
            if t is None:
                n = 0
                continue
            s = t
            n += 1
            if n >= least:
                if i - n > end:
                    if end >= 0:
                        out.append((begin, end))
                    begin = i - n
                end = i
        if end >= 0:
            out.append((begin, end))
        return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching (begin, end) rows as maximal ones."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    high = np.maximum.accumulate(spans[:, 1])
    first = np.ones(len(spans), bool)
    first[1:] = spans[1:, 0] > high[:-1]
    at = np.flatnonzero(first)
    return np.stack([spans[at, 0], high[np.append(at[1:] - 1, len(spans) - 1)]], 1)
