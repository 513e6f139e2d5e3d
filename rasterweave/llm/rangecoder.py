"""Adaptive context-mixing range coder for token ids, vectorised over lanes.

A block of ids is cut into lanes of equal length.  In each round every lane codes its next id, so numpy
works on all lanes at once; the lanes of a block share one model, which is updated after each round, and
each lane has a range coder of its own.  Blocks are reset independently and carry a checksum.

Prediction.  Order 2 and order 1 each hold, for their context (the two ids before, hashed; the id before), the id they
expect and how sure they are; order 0 is the block's adaptive frequency table.  They are mixed into one
distribution, P(x) = (a2 [x = e2] + a1 [x = e1] + a0 f0(x)), where the weights come from how often such
predictions (by sureness of both and whether they agree) have been right in this block so far.
All arithmetic is on integers, so encoder and decoder agree everywhere.

Record: magic, ids, lanes, alphabet, crc32 of the ids (little-endian unsigned 32 bits), length of each lane, lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# take(..., mode="clip") with indices that are in range is numpy's fastest lookup
MAGIC = b"RWC1"
HEADER = struct.Struct("<4sIIII")
LANES, LANE_IDS = 8192, 64  # most lanes; fewest ids in a lane of a block with several
BLOCK_IDS = 1 << 21
_W0, _WEIGHTS = 22, 8  # bits of the order-0 total and of the weights
_TOTAL = _W0 + _WEIGHTS
_TABLE2 = 1 << 20
_SURE = 15
_TOP, _LOW = np.uint64(1 << 48), np.uint64(1 << 32)
_U = np.uint64


class Model:
    """The shared predictor of a block.  An expected id and its sureness are one number, id << 4 | sureness."""

    def __init__(self, alphabet: int):
        n = alphabet
        self.n = n
        self.count = np.ones(n, np.int64)
        self.t1, self.t2 = np.zeros(n + 1, np.int32), np.zeros(_TABLE2, np.int32)
        bins = 2 * (_SURE + 1) ** 2  # by sureness of both and whether they agree
        self.seen, self.right2, self.right1 = (np.zeros(bins, np.int64) for _ in range(3))
        self.round, self.new = 0, []
        self._frequencies()

    def _frequencies(self) -> None:
        total, room = int(self.count.sum()), (1 << _W0) - self.n
        f = 1 + self.count * room // total
        f[int(self.count.argmax())] += (1 << _W0) - int(f.sum())
        self.f = f.astype(np.int32)
        self.cum = np.zeros(self.n + 1, np.int32)
        np.cumsum(f, out=self.cum[1:])
        self.near = None

    def find(self, y: np.ndarray) -> np.ndarray:
        """The ids whose share of the order-0 line holds y."""
        if self.near is None:  # the id at each 64th place of the line: how many shares have ended there
            places = 1 << _W0 - 6
            self.near = np.cumsum(np.bincount(self.cum[1:] + 63 >> 6, minlength=places + 1)[:places]).astype(np.int32)
        x = self.near.take(y >> 6, mode="clip")
        x += self.cum.take(x + 1, mode="clip") <= y
        late = np.flatnonzero(self.cum.take(x + 1, mode="clip") <= y)
        if len(late):
            x[late] = np.searchsorted(self.cum, y[late], "right") - 1
        return x

    def predict(self, before: np.ndarray, before2: np.ndarray):
        """Contexts and their entries, expected ids, bins, and weights of the lanes (of expected ids in places of the line)."""
        c2 = before * 0x9E3779B1
        c2 += before2 * 0x85EBCA6B
        c2 >>= 7
        c2 &= _TABLE2 - 1
        p2, p1 = self.t2.take(c2, mode="clip"), self.t1.take(before, mode="clip")
        e2, e1 = p2 >> 4, p1 >> 4
        b = ((p2 & _SURE) << 5 | (p1 & _SURE) << 1 | (e1 == e2)).astype(np.int64)
        room, tried = (1 << _WEIGHTS) - 8, 2 * self.seen + 3
        w2 = (2 * self.right2 + 1) * room // tried
        w1 = np.minimum((2 * self.right1 + 1) * room // tried, room - w2)
        w1[1::2] = 0  # one id expected twice has one weight
        a0 = ((1 << _WEIGHTS) - w2 - w1).take(b, mode="clip")
        return c2, p2, p1, e2, e1, b, a0, (w2 << _W0).take(b, mode="clip"), (w1 << _W0).take(b, mode="clip")

    def update(self, x: np.ndarray, before: np.ndarray, p, hit2: np.ndarray, hit1: np.ndarray) -> None:
        c2, p2, p1, _, _, b, *_ = p
        bins = len(self.seen)
        hits = np.bincount(b << 2 | hit1 << 1 | hit2, minlength=4 * bins).reshape(bins, 4)
        self.seen += hits.sum(axis=1)
        self.right2 += hits[:, 1] + hits[:, 3]
        self.right1 += hits[:, 2] + hits[:, 3]
        fresh = x.astype(np.int32) << 4
        # of lanes with one context, the last one's update stays, in both directions of coding
        self.t2[c2] = _learned(p2, hit2, fresh)
        self.t1[before] = _learned(p1, hit1, fresh)
        self.round += 1
        self.new.append(x)
        if self.round & (self.round - 1) == 0 or self.round % 16 == 0:
            self.count += np.bincount(np.concatenate(self.new), minlength=self.n) * 32
            self.new.clear()
            self._frequencies()


# what a miss (first half) or a hit adds to an entry, by its sureness: a miss halves it, a hit adds one
_STEP = np.array([s // 2 - s for s in range(_SURE + 1)] + [s < _SURE for s in range(_SURE + 1)], np.int32)


def _learned(entry: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The entries after an id; one that missed and was hardly sure expects the new id."""
    kind = entry & _SURE
    kind |= hit.astype(np.int32) << 4
    return np.where(kind < 2, fresh, entry + _STEP.take(kind, mode="clip"))


def _shape(n: int) -> tuple[int, int]:
    """Lanes and ids of a lane."""
    lanes = min(LANES, max(1, n // LANE_IDS))
    each = -(-n // lanes) if n else 0
    return (-(-n // each) if n else 0), each


def _moving(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Index of the lanes that move 16 bits out next; narrows ranges that straddle a carry."""
    settled = (low ^ (low + size)) < _TOP
    tight = size < _LOW
    narrow = np.flatnonzero(tight > settled)
    if len(narrow):
        size[narrow] = (_U(0) - low[narrow]) & (_LOW - _U(1))
    return np.flatnonzero(settled | tight)


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    ids = np.ascontiguousarray(ids, np.int64)
    n = len(ids)
    lanes, each = _shape(n)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return HEADER.pack(MAGIC, 0, 0, alphabet, crc)
    model = Model(alphabet)
    # a row holds what is next in each lane, so that lanes read and write side by side
    rounds = np.zeros(lanes * each, np.int32)
    rounds[:n] = ids
    rounds = np.ascontiguousarray(rounds.reshape(lanes, each).T)
    out = np.zeros((2 * each + 8, lanes), "<u2")
    flat = out.reshape(-1)
    used = np.zeros(lanes, np.int64)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    before, before2 = np.full(lanes, alphabet, np.int64), np.full(lanes, alphabet, np.int64)
    for r in range(each):
        m = lanes if (lanes - 1) * each + r < n else lanes - 1
        y = rounds[r, :m]
        x = y.astype(np.int64)
        p = model.predict(before[:m], before2[:m])
        _, _, _, e2, e1, _, a0, a2, a1 = p
        hit2, hit1 = e2 == y, e1 == y
        lo, sz = low[:m], size[:m]
        sz >>= _U(_TOTAL)
        lo += (a0 * model.cum.take(x, mode="clip") + (e2 < y) * a2 + (e1 < y) * a1).view(np.uint64) * sz
        sz *= (a0 * model.f.take(x, mode="clip") + hit2 * a2 + hit1 * a1).view(np.uint64)
        k = _moving(lo, sz)
        while len(k):  # only lanes that have moved can move again
            l, w, u = lo[k], sz[k], used[k]
            flat[u * lanes + k] = l >> _U(48)
            used[k] = u + 1
            l <<= _U(16)
            w <<= _U(16)
            again = _moving(l, w)
            lo[k], sz[k] = l, w
            k = k[again]
        model.update(x, before[:m], p, hit2, hit1)
        before2[:m] = before[:m]
        before[:m] = x
    every = np.arange(lanes)
    for shift in (48, 32, 16, 0):
        out[used, every] = (low >> _U(shift)) & _U(0xFFFF)
        used += 1
    body = np.ascontiguousarray(out.T)[np.arange(len(out)) < used[:, None]]
    return HEADER.pack(MAGIC, n, lanes, alphabet, crc) + used.astype("<u4").tobytes() + body.tobytes()


def decode_block(record: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(ids, where the next record starts); ValueError where the record is damaged."""
    magic, n, lanes, alphabet, crc = HEADER.unpack_from(record, at)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at += HEADER.size
    if not n:
        return np.zeros(0, np.int64), at
    each = -(-n // lanes)
    used = np.frombuffer(record, "<u4", lanes, at).astype(np.int64)
    at += 4 * lanes
    words = np.concatenate([np.frombuffer(record, "<u2", int(used.sum()), at), np.zeros(8, "<u2")])
    at += 2 * int(used.sum())
    pos = np.cumsum(used) - used
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << _U(16) | words[pos].astype(np.uint64)
        pos += 1
    model = Model(alphabet)
    ids = np.zeros((each, lanes), np.int64)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    before, before2 = np.full(lanes, alphabet, np.int64), np.full(lanes, alphabet, np.int64)
    for r in range(each):
        m = lanes if (lanes - 1) * each + r < n else lanes - 1
        p = model.predict(before[:m], before2[:m])
        _, _, _, e2, e1, _, a0, a2, a1 = p
        lo, sz, co = low[:m], size[:m], code[:m]
        sz >>= _U(_TOTAL)
        v = np.minimum((co - lo) // sz, _U((1 << _TOTAL) - 1)).view(np.int64)
        # an expected id's part of the line, with the parts of both expected ids in place
        begin2 = a0 * model.cum.take(e2, mode="clip") + (e1 < e2) * a1
        begin1 = a0 * model.cum.take(e1, mode="clip") + (e2 < e1) * a2
        width2, width1 = a0 * model.f.take(e2, mode="clip") + a2, a0 * model.f.take(e1, mode="clip") + a1
        after2, after1 = v - begin2, v - begin1
        # where both expect one id, order 2 has the weight
        hit2 = after2.view(np.uint64) < width2.view(np.uint64)
        hit1 = after1.view(np.uint64) < width1.view(np.uint64)
        x = np.where(hit2, e2, e1).astype(np.int64)
        begin, width = np.where(hit2, begin2, begin1), np.where(hit2, width2, width1)
        o = np.flatnonzero(~(hit2 | hit1))
        if len(o):  # by order 0
            a = a0[o]
            skip = (after2[o] >= 0) * a2[o] + (after1[o] >= 0) * a1[o]
            y = model.find(((v[o] - skip) / a).astype(np.int64))  # exact: 30 bits by 9
            x[o], begin[o], width[o] = y, a * model.cum.take(y, mode="clip") + skip, a * model.f.take(y, mode="clip")
        lo += begin.view(np.uint64) * sz
        sz *= width.view(np.uint64)
        k = _moving(lo, sz)
        while len(k):
            l, w, u = lo[k], sz[k], pos[k]
            co[k] = co[k] << _U(16) | words.take(u, mode="clip")
            pos[k] = u + 1
            l <<= _U(16)
            w <<= _U(16)
            again = _moving(l, w)
            lo[k], sz[k] = l, w
            k = k[again]
        ids[r, :m] = x
        model.update(x, before[:m], p, e2 == x, e1 == x)
        before2[:m] = before[:m]
        before[:m] = x
    out = ids.T.reshape(-1)[:n]
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum mismatch")
    return out, at


def encode(ids: np.ndarray, alphabet: int, block: int = BLOCK_IDS) -> bytes:
    return b"".join(encode_block(ids[i : i + block], alphabet) for i in range(0, max(1, len(ids)), block))


def decode(record: bytes) -> np.ndarray:
    out, at = [], 0
    while at < len(record):
        ids, at = decode_block(record, at)
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.int64)
