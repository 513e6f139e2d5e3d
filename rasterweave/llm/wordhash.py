"""Vectorised 64-bit word and n-gram hashes over UTF-8 buffers.

A word's hash is a polynomial in an odd base over a random 64-bit value for each byte, modulo 2**64,
mixed with its length.  Prefix sums give all words of a buffer in a few passes; sums over word
hashes give n-grams the same way.  Distinct words share a hash with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_SEED = 20240611
_rng = np.random.default_rng(_SEED)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, GRAM_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes hashed in one go; longer texts are cut between words.
PIECE = 1 << 20
SPAN_PIECE = 1 << 17

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of letters-and-digits words: ASCII other than 0-9, a-z (after lower-casing).
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 1024), b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 4 * PIECE:
            return out[0], out[1]  # too large to keep
        _powers[base] = (out[0], out[1])
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _words(piece: np.ndarray, cut: np.ndarray, lower: bool, prefix: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words of one piece; with ``prefix``, hashes of the words' first bytes in further rows."""
    if lower:
        piece = LOWER[piece]
    inside = np.empty(len(piece) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~cut[piece]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros((1 + len(prefix), 0) if prefix else 0, np.uint64), starts
    up, down = powers(BASE, len(piece) + 1)
    total = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(BYTE[piece] * up[: len(piece)], out=total[1:])
    whole = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if not prefix:
        return whole, starts
    parts = [mix((total[np.minimum(ends, starts + n)] - total[starts]) * down[starts] ^ np.uint64(0x5851F42D4C957F2D * n % (1 << 64))) for n in prefix]
    return np.stack([whole, *parts]), starts


def hash_words(offsets: np.ndarray, data: np.ndarray, cut: np.ndarray = SPACE, lower: bool = False, prefix: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, in order; for each text the number of words before it, and in the end of all).

    With ``prefix``, the hashes have a further row for each of its numbers, of each word's first bytes.
    """
    hashes: list[np.ndarray] = []
    count = np.zeros(len(offsets), np.int64)
    done, i, n = 0, 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        if j == i + 1:  # one text, long perhaps
            at, end, words = int(offsets[i]), int(offsets[j]), 0
            while at < end:
                stop = min(end, at + PIECE)
                while stop < end and not cut[LOWER[data[stop]] if lower else data[stop]]:
                    far = min(end, stop + PIECE)
                    seps = np.flatnonzero(cut[LOWER[data[stop:far]] if lower else data[stop:far]])
                    stop = stop + int(seps[0]) if len(seps) else far
                h, _ = _words(data[at:stop], cut, lower, prefix)
                hashes.append(h)
                words += h.shape[-1]
                at = stop
            done += words
            count[j] = done
        else:  # several texts, with a separator after each
            lo, lengths = int(offsets[i]), np.diff(offsets[i : j + 1])
            room = np.full(int(offsets[j]) - lo + (j - i), 0x20, np.uint8)
            into = np.ones(len(room), bool)
            ends = np.cumsum(lengths) + np.arange(j - i)
            into[ends] = False
            room[into] = data[lo : int(offsets[j])]
            h, starts = _words(room, cut, lower, prefix)
            hashes.append(h)
            count[i + 1 : j + 1] = done + np.searchsorted(starts, ends)
            done += h.shape[-1]
        i = j
    return (np.concatenate(hashes, -1) if hashes else np.zeros((1 + len(prefix), 0) if prefix else 0, np.uint64)), count


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes (none is 0) of data[begin : end]; spans ascend and do not overlap."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + SPAN_PIECE, "right")))
        lo, hi = int(begin[i]), int(end[j - 1])
        up, down = powers(BASE, hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        a, z = begin[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((total[z] - total[a]) * down[a] + (z - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        i = j
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; shorter inputs give none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    if n <= 8:
        c = 1
        for j in range(n):
            out += words[j : len(words) - n + 1 + j] * np.uint64(c)
            c = c * GRAM_BASE % (1 << 64)
        return mix(out)
    up, down = powers(GRAM_BASE, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(out)])
