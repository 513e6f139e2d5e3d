"""N-gram Jaccard join: T-occurrence search in DivideSkip form, over a partitioned inverted index.

Two documents link when their sets of distinct n-word shingles have a Jaccard similarity of ``num/den`` or
more, so one must hold T shingles or more of the other.  DivideSkip merges a query's short inverted lists and
probes the long ones only for what the short ones bring up.  Here:

1. One pass over the texts gives each document's set signature; documents with equal sets are one class from here on.
   It also counts frequent shingles (lossy counting, at most 2**20 of them by the choice of the bound); they define "long".
2. All shingles are ordered: rare ones by hash, then frequent ones by frequency.  Documents that link share at
   least l of the first n - T + l of theirs in that order (the short lists); only those are indexed.  l grows with n, so that
   a few shingles shared by chance bring nothing up.  The index is dealt by shingle, packed as arrays.
3. Documents that share enough of the index are put into search blocks of at most BLOCK, neighbours on a long list
   together.  First each document searches its own block and those of its neighbours by size on its lists; that joins most of a large group
   of near copies at a cost in proportion to the postings.  Then documents of smaller components search every block
   that shares enough of their index entries and holds a document of a larger component, whatever their number.
   A query goes to a block once, not once for each pair.
4. A block is an inverted index.  A search splits the lists of the query's shingles into short and long, merges the
   short ones, and probes the long ones by binary search for what the short ones brought up often enough.
5. Components of the links by star rounds; each document gets the smallest doc_id of its component.

A shingle is a 64-bit hash; two different shingles meet with a chance near 2**-64.

Edge cases: null texts and texts without words have empty sets and link with nothing; texts with fewer than n
words have one shingle, the whole sequence; rows with a null id get a null component unless a linked row has an
id; repeated rows link with each other; rows are never capped; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, partitions, private, release, table, tidy, utf8
from .components import components, contract
from .wordhash import grams, hash_words, mix

CHUNK = 1 << 21  # shingles counted at a time; one that a chunk holds once is not counted
MOST_FREQUENT = 1 << 20
LEAST_FREQUENT = 64
FLUSH = 1 << 18  # index entries packed at a time
BLOOM_BITS = 1 << 27  # 16 MB at most
BUCKET = 1 << 23  # shingles a bucket of the index, about
SHARD = 1 << 12  # documents of a search shard, about
ASKED = 1 << 9  # queries that one copy of a block answers, about
GROUP = 1 << 20  # bytes of text hashed in one go
MU = 0.5  # DivideSkip's cost ratio of probing and merging
FEW = 2048  # postings that are merged by a heap
BLOCK = 512  # documents of a search block
SHORT = 8  # members of a list whose pairs are counted
SUB_LIST = 256  # members of a part of a long list, about
PART = 20  # one more shared index entry is asked for with this many shingles


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    offsets, data = utf8(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
        words, at = hash_words(offsets[i : j + 1], data, lower=True)
        all_grams, at = grams(words, n), at.tolist()
        for a, z in zip(at[:-1], at[1:], strict=True):
            if z - a >= n:
                yield np.unique(all_grams[a : z - n + 1])
            elif z > a:
                s = np.full(1, z - a, np.uint64)
                for w in words[a:z]:
                    s = mix(s * np.uint64(0x9E3779B97F4A7C15) + w)
                yield s
            else:
                yield np.zeros(0, np.uint64)
        i = j


def signature(s: np.ndarray) -> int:
    """Of a whole set, as a signed 64-bit number."""
    return int(mix(np.array([mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


class Rule:
    """Sizes, overlaps and prefixes for a similarity of num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """Overlap that any partner of a set of n needs."""
        return -(-self.num * n // self.den)

    def overlap(self, a, b):
        """Overlap that sets of a and b need."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def shared(self, n: int) -> int:
        """l: index entries that two sets of n share if they link."""
        return 1 + n // PART

    def prefix(self, n: int) -> int:
        return n - self.least(n) + min(self.shared(n), self.least(n))

    def fits(self, a: Column, b: Column) -> Column:
        return (a * self.num <= b * self.den) & (b * self.num <= a * self.den)

    def shared_column(self, n: Column) -> Column:
        return F.least(F.floor(n / PART) + 1, self.least_column(n))

    def least_column(self, n: Column) -> Column:
        return F.ceil(n * self.num / self.den)

    def few(self, n: Column) -> Column:
        """Index entries that a set of n shares with any partner; the smallest partner asks for least."""
        return F.least(F.floor(self.least_column(n) / PART) + 1, self.least_column(self.least_column(n)))

    def least_shared(self, a: Column, b: Column) -> Column:
        """Index entries that linked sets of a and b share: up to where the earlier index prefix ends, all but what lies behind."""
        behind = F.greatest(self.least_column(a) - self.shared_column(a), self.least_column(b) - self.shared_column(b))
        return F.greatest(F.lit(1), F.ceil((a + b) * self.num / (self.num + self.den)) - behind)


def divide_skip(lists: Sequence[np.ndarray], t: int, mu: float = MU) -> tuple[np.ndarray, np.ndarray]:
    """(ids on t lists or more, on how many); each list ascends.

    The longest lists, fewer than t, are set aside.  The rest are merged, by a heap where they are short in all; an id met
    often enough there to reach t with all long lists is looked up in each long list by binary search.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = sorted((x for x in lists if len(x)), key=len)
    if t <= 0 or len(lists) < t:
        return none
    n_long = min(t - 1, int(t / (mu * np.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    if sum(map(len, short)) <= FEW:
        merged = np.fromiter(heapq.merge(*[x.tolist() for x in short]), np.int64)
    else:
        merged = np.sort(np.concatenate(short), kind="stable")  # merges ascending runs
    ids, count = np.unique(merged, return_counts=True)
    able = count >= t - n_long
    ids, count = ids[able], count[able]
    for x in long:
        if not len(ids):
            return none
        at = np.searchsorted(x, ids)
        at[at == len(x)] = 0
        count += x[at] == ids
    done = count >= t
    return ids[done], count[done]


class Block:
    """An inverted index over a few documents' sets."""

    def __init__(self, sets_: Sequence[np.ndarray]):
        self.size = np.array([len(x) for x in sets_], np.int64)
        every, owner = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), self.size)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.key, self.start = np.unique(every[order], return_index=True)
        self.end = np.append(self.start[1:], len(every))

    def search(self, query: np.ndarray, rule: Rule) -> np.ndarray:
        """Places of the documents that link with the query set."""
        fit = (self.size * rule.den >= len(query) * rule.num) & (self.size * rule.num <= len(query) * rule.den)
        if not fit.any():
            return np.zeros(0, np.int64)
        need = rule.overlap(len(query), self.size)
        at = np.searchsorted(self.key, query)
        at[at == len(self.key)] = 0
        at = at[self.key[at] == query]
        lists = [self.owner[a:z] for a, z in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]
        ids, count = divide_skip(lists, max(1, int(need[fit].min())))
        return ids[fit[ids] & (count >= need[ids])]


def _scan(documents: DataFrame, n: int) -> DataFrame:
    """kind 0: a document's doc_id, th (a hash of its text), n, sig; kind 1: a shingle h met c times in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "th", "n", "sig", "h", "c"]
        held: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c > 1], c[c > 1]
            no = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), no, no, no, no, pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=names)

        for b in batches:
            each = []
            for s in sets(b.column(1), n):
                each.append((len(s), signature(s) if len(s) else 0))
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield counts()
                    held, size = [], 0
            no = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), b.column(2), pa.array([x for x, _ in each], pa.int64()), pa.array([x for _, x in each], pa.int64()), no, no], names=names)
        if size:
            yield counts()
        tidy()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return rows.mapInArrow(run, "kind int, doc_id long, th long, n long, sig long, h long, c long")


class Frequent:
    """The frequent shingles and their counts."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.h & np.uint64((1 << 20) - 1)] = True

    def ways(self, h: np.ndarray) -> np.ndarray:
        """Into how many sub-lists each shingle's list is dealt."""
        out = np.ones(len(h), np.uint64)
        at = np.flatnonzero(self.maybe[h & np.uint64((1 << 20) - 1)])
        if len(at):
            p = np.searchsorted(self.h, h[at])
            p[p == len(self.h)] = 0
            ok = self.h[p] == h[at]
            out[at[ok]] = np.minimum(-(-self.c[p[ok]] // SUB_LIST), (1 << 24) - 1)
        return out

    def order(self, s: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` of a sorted set in the global order."""
        at = np.flatnonzero(self.maybe[s & np.uint64((1 << 20) - 1)])
        if not len(at):
            return s[:most]
        p = np.searchsorted(self.h, s[at])
        p[p == len(self.h)] = 0
        ok = self.h[p] == s[at]
        at, p = at[ok], p[ok]
        rare = np.delete(s, at)
        if len(rare) >= most:
            return rare[:most]
        by = np.argsort(self.c[p], kind="stable")
        return np.concatenate([rare, s[at][by][: most - len(rare)]])


def _index(documents: DataFrame, n: int, rule: Rule, frequent: Frequent, buckets: int) -> DataFrame:
    """key, part, sig, n, m of index entries whose list, of m entries, has another entry of a fitting size.

    Long lists (of frequent shingles) are dealt into parts by the documents' size, then by hash; their entries all stay.
    """
    sent = documents.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT shingles
    width = np.log(rule.den / rule.num)  # documents that link lie in one class of sizes or in neighbouring ones

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        held: list[np.ndarray] = []
        sig: list[int] = []
        size = 0
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _ in held])
            times = [len(x) for x, _ in held]
            s, m = np.repeat(np.array(sig, np.int64), times), np.repeat(np.array([k for _, k in held], np.uint32), times)
            key = mix(h ^ np.uint64(0xE7037ED1A0B428DB))
            ways = f.ways(h)
            part = np.zeros(len(h), np.uint64)
            hot = np.flatnonzero(ways > 1)
            part[hot] = np.uint64(1 << 62) | (np.log(m[hot]) / width).astype(np.uint64) << np.uint64(48) | ways[hot] << np.uint64(24) | mix(s[hot].view(np.uint64)) % ways[hot]
            bucket = (mix(key + part) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ids, start = np.unique(bucket[order], return_index=True)
            ends = [*start[1:].tolist(), len(bucket)]
            cut = lambda a: pa.array([a[x:y].tobytes() for x, y in zip(start.tolist(), ends, strict=True)], pa.binary())
            # parts are few: only hot entries carry theirs, by place
            some = part[order]
            parts = pa.array([np.flatnonzero(some[x:y]).astype(np.uint32).tobytes() for x, y in zip(start.tolist(), ends, strict=True)], pa.binary())
            which = pa.array([some[x:y][some[x:y] > 0].tobytes() for x, y in zip(start.tolist(), ends, strict=True)], pa.binary())
            count = pa.array([y - x for x, y in zip(start.tolist(), ends, strict=True)], pa.int32())
            held.clear()
            sig.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), count, cut(key[order]), cut(s[order]), cut(m[order]), parts, which], names=["bucket", "count", "keys", "sigs", "ns", "hot", "parts"])

        for b in batches:
            for s in sets(b.column(0), n):
                if not len(s):
                    continue
                g = signature(s)
                if g in seen:  # a copy met before in this task
                    continue
                if len(seen) < 1 << 20:
                    seen.add(g)
                held.append((f.order(s, rule.prefix(len(s))), len(s)))
                sig.append(g)
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        tidy()

    def lists(frame: pd.DataFrame) -> pd.DataFrame:
        key, s, m = (np.frombuffer(b"".join(frame.pop(c)), k) for c, k in (("keys", np.uint64), ("sigs", np.int64), ("ns", np.uint32)))
        part, at = np.zeros(len(key), np.uint64), 0
        for places, values, count in zip(frame["hot"], frame["parts"], frame["count"].tolist(), strict=True):
            part[at + np.frombuffer(places, np.uint32).astype(np.int64)] = np.frombuffer(values, np.uint64)
            at += count
        # lists of one entry are most: drop them before the costlier sort
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        many = np.zeros(len(k), bool)
        many[1:] |= same
        many[:-1] |= same
        order = order[many | (part[order] > 0)]
        key, s, m, part = key[order], s[order], m[order].astype(np.int64), part[order]
        order = np.lexsort((s, m, part, key))
        key, s, m, part = key[order], s[order], m[order], part[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1])
        key, s, m, part = key[fresh], s[fresh], m[fresh], part[fresh]
        near = (key[1:] == key[:-1]) & (m[:-1] * rule.den >= m[1:] * rule.num)
        keep = part > 0
        keep[1:] |= near
        keep[:-1] |= near
        key, s, m, part = key[keep], s[keep], m[keep], part[keep]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))[: len(key)])
        times = np.diff(np.append(first, len(key)))
        length = np.repeat(times, times)
        length[part > 0] += SHORT  # its other parts have more
        tidy()
        return pd.DataFrame({"key": key.view(np.int64), "part": part.view(np.int64), "sig": s, "n": m, "m": length})

    packed = documents.select("text").mapInArrow(pack, "bucket int, count int, keys binary, sigs binary, ns binary, hot binary, parts binary")
    return packed.groupBy("bucket").applyInPandas(lists, "key long, part long, sig long, n long, m long")


def _enough(entries: DataFrame, rule: Rule) -> DataFrame:
    """Entries of the classes that can share enough of the index with one partner.

    On lists of at most SHORT members the shared entries are counted for each pair (a list gives a bounded number); an entry on
    a longer list may be shared with anyone.  A class stays if its best partner's count and its entries on long lists
    together are enough, so classes that meet many others once each by chance go.
    """
    lists = entries.where(F.col("m") <= SHORT).groupBy("key").agg(F.collect_list(F.struct("sig", "n")).alias("l"))
    after = lambda a, i: F.transform(F.slice("l", i + 2, F.lit(SHORT)), lambda b: F.struct(a.alias("a"), b.alias("b")))
    pairs = lists.select(F.explode(F.flatten(F.transform("l", after))).alias("p")).where(rule.fits(F.col("p.a.n"), F.col("p.b.n")))
    pairs = pairs.groupBy(F.least("p.a.sig", "p.b.sig").alias("u"), F.greatest("p.a.sig", "p.b.sig").alias("v")).agg(F.count("*").alias("c"))
    best = pairs.select(F.explode(F.array("u", "v")).alias("sig"), "c").groupBy("sig").agg(F.max("c").alias("best"))
    long = entries.groupBy("sig", "n").agg(F.count_if(F.col("m") > SHORT).alias("long"))
    able = long.join(best, "sig", "left").where(F.coalesce("best", F.lit(0)) + F.col("long") >= rule.few(F.col("n"))).select("sig")
    return entries.join(able, "sig", "left_semi")


def _probes(x: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mix(x ^ np.uint64(k)) & np.uint64(bits - 1) for k in (0x9E37, 0x85EB)]


def _bloom(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A filter over a column of longs, as 64-bit words, and its bits: some 16 an id, at most BLOOM_BITS.

    Each task sends the words that it sets, once each; they are united before they reach the driver.
    """
    bits = min(BLOOM_BITS, 1 << max(20, (16 * ids.count()).bit_length()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                at = np.sort(np.concatenate(_probes(f.iloc[:, 0].to_numpy(np.int64).view(np.uint64), bits)))
                word = at >> np.uint64(6)
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                yield pd.DataFrame({"word": word[first].astype(np.int64), "mask": np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first).view(np.int64)})
        tidy()

    got = ids.mapInPandas(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return out, bits


class _Filter:
    """A Bloom filter on the executors; nulls pass."""

    def __init__(self, spark: SparkSession, ids: DataFrame):
        self.sent = spark.sparkContext.broadcast(_bloom(ids))  # BLOOM_BITS

    def passing(self, column: pa.Array) -> pa.Array:
        (words, bits), x = self.sent.value, np.asarray(column.fill_null(0)).view(np.uint64)
        ok = np.ones(len(x), bool)
        for at in _probes(x, bits):
            ok &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.array(ok | np.asarray(column.is_null()))


def _passing(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose id may be among ``ids`` or is null; all that are, and few others."""
    only, at = _Filter(df.sparkSession, ids), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(only.passing(b.column(at)))
        tidy()

    return df.mapInArrow(run, df.schema)


def _sets_of(documents: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """sig, blk, set (packed) of the wanted classes (sig, doc_id, blk), from one document of each."""
    only = _Filter(documents.sparkSession, wanted.where("doc_id IS NOT NULL").select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(signature(s), s.tobytes()) for s in sets(b.column(1).filter(only.passing(b.column(0))), n) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], names=["sig", "set"])
        tidy()

    some = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "sig long, set binary")
    return some.join(wanted.select("sig", "blk"), "sig").dropDuplicates(["sig"])


def _blocks(entries: DataFrame) -> DataFrame:
    """sig, n, blk: at most BLOCK documents a block, neighbours by size on the longest (part of a) list that they are on."""
    long = entries.groupBy("sig", "n").agg(F.max(F.struct("m", "key", "part")).alias("home")).select("sig", "n", "home.key", "home.part")
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("n", "sig")) - 1
    return long.withColumn("cut", F.floor(place / BLOCK)).select("sig", "n", F.xxhash64("key", "part", "cut").alias("blk"))


def _search(queries: DataFrame, packed: DataFrame, rule: Rule, shards: int, own: bool) -> DataFrame:
    """A spanning forest u, v of the links of queries (u, blk) with a block's documents, and if ``own``, of a block's with each other.

    A block that many documents ask for is there several times, and they are dealt among its copies.
    """
    asked = queries.groupBy("blk").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("ways")).where("ways > 1")
    held = packed if own else _passing(packed, "blk", queries.select("blk"))
    held = held.join(asked, "blk", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)))
    held = held.select(F.pmod(F.xxhash64("blk", "copy"), F.lit(shards)).alias("shard"), "blk", "copy", "sig", "set")
    sets_ = _passing(packed.select("sig", "set"), "sig", queries.select("u"))
    dealt = queries.join(asked, "blk", "left").withColumn("copy", F.pmod(F.xxhash64("u"), F.coalesce("ways", F.lit(1))).cast("int"))
    asking = dealt.join(sets_.select(F.col("sig").alias("u"), F.col("set").alias("q")), "u").select(F.pmod(F.xxhash64("blk", "copy"), F.lit(shards)).alias("to"), F.col("blk").alias("at"), "copy", "u", "q")

    def run(blocks: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        by = dict(iter(some.groupby(["at", "copy"], sort=False)))
        for at, rows in blocks.groupby(["blk", "copy"], sort=False):
            asked = [(q, np.frombuffer(raw, np.uint64)) for q, raw in zip(by[at]["u"].tolist(), by[at]["q"], strict=True)] if at in by else []
            sig, held_sets = rows["sig"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["set"]]
            if own and at[1] == 0 and len(sig) > 1:
                asked += list(zip(sig.tolist(), held_sets, strict=True))
            if not asked:
                continue
            index = Block(held_sets)
            for q, query in asked:
                got = sig[index.search(query, rule)]
                got = got[got != q]
                u += [q] * len(got)
                v += got.tolist()
        # a forest says as much about components
        out = next(contract(iter([pd.DataFrame({"u": u, "v": v}, dtype="int64")])))
        tidy()
        return out

    return held.groupBy("shard").cogroup(asking.groupBy("to")).applyInPandas(run, "u long, v long")


def _linked(documents: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, sig of every row; sig, doc_id (the smallest with that set), g (the component) of every class)."""
    spark, rule = documents.sparkSession, Rule(num, den)
    scanned = materialize(_scan(documents, n), "jaccard-scan")
    docs = scanned.where("kind = 0").select("doc_id", "th", "n", "sig")
    total = docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t
    bound = max(LEAST_FREQUENT, total // MOST_FREQUENT)  # so at most MOST_FREQUENT can reach it
    often = scanned.where("kind = 1").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= bound).toArrow()
    frequent = Frequent(often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy())
    classes = docs.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    found = materialize(_index(documents, n, rule, frequent, max(8, partitions(spark), total // BUCKET)), "jaccard-index")
    entries = materialize(_enough(found, rule), "jaccard-entries")
    release(found)
    docs_in = materialize(_blocks(entries), "jaccard-blocks")
    packed = materialize(_sets_of(documents, docs_in.join(classes, "sig"), n), "jaccard-sets")
    shards = max(4 * partitions(spark), docs_in.count() // SHARD)
    # neighbours by size on each list
    # a long list is dealt for this otherwise than for blocks, so that neighbours are of different blocks
    ways = F.shiftright("part", 24).bitwiseAND(F.lit((1 << 24) - 1))
    dealt = entries.withColumns({"class": F.shiftright("part", 48), "turn": F.when(F.col("part") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("sig"), ways))})
    on_list = Window.partitionBy("key", "class", "turn").orderBy("n", "sig")
    chain = dealt.select("sig", "n", F.lead("sig").over(on_list).alias("v"), F.lead("n").over(on_list).alias("n2")).where(F.col("v").isNotNull() & rule.fits(F.col("n"), F.col("n2")))
    chain = chain.groupBy(F.col("sig").alias("u"), "v").agg(F.count("*").alias("c"), rule.least_shared(F.min("n"), F.min("n2")).alias("least")).where(F.col("c") * 2 >= F.col("least"))
    home = docs_in.select(F.col("sig").alias("u"), F.col("blk").alias("own"))
    first = chain.join(docs_in.select(F.col("sig").alias("v"), "blk"), "v").join(home, "u").where("blk <> own").select("u", "blk").distinct()
    first = materialize(first, "jaccard-chain")
    linked = materialize(_search(first, packed, rule, shards, True), "jaccard-links")
    group = components(linked)
    # what is left: documents of smaller components against blocks that hold others
    member = docs_in.join(group.select(F.col("u").alias("sig"), F.col("v").alias("g")), "sig", "left").withColumn("g", F.coalesce("g", "sig"))
    # the larger component has the higher rank
    rank = member.groupBy("g").agg(F.struct(F.count("*").alias("size"), F.col("g").alias("id")).alias("rank"))
    member = materialize(member.join(rank, "g"), "jaccard-members")
    known = entries.select("key", "sig").join(member, "sig")
    held = known.groupBy("key", "blk").agg(F.max("rank").alias("top"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = held.groupBy("key").agg(F.max("top").alias("best"))
    asking = known.join(other, "key").where("rank < best").select("key", F.col("sig").alias("u"), "n", "rank")
    met = asking.join(held, "key").where((F.col("top") > F.col("rank")) & (F.col("hi") * den >= F.col("n") * num) & (F.col("lo") * num <= F.col("n") * den))
    # the smallest partner that fits asks for least
    met = met.join(home, "u").where("blk <> own").groupBy("u", "blk").agg(F.count("*").alias("c"), F.min("n").alias("n")).where(F.col("c") >= rule.few(F.col("n"))).select("u", "blk")
    rest = materialize(met.join(first, ["u", "blk"], "left_anti"), "jaccard-rest")
    more = materialize(_search(rest, packed, rule, shards, False), "jaccard-links")
    release(packed, entries, rest, first, member)
    joined = components(group.union(more))
    release(linked, more, group)
    return docs, classes.join(joined.select(F.col("u").alias("sig"), F.col("v").alias("g")), "sig", "left").select("sig", "doc_id", F.coalesce("g", "sig").alias("g"))


def link(documents: DataFrame, *, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), class_id."""
    docs, named = _linked(documents, n, num, den)
    smallest = named.groupBy("g").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "g").select("sig", "component_id", F.col("doc_id").alias("class_id"))
    out = docs.join(named, "sig", "left")
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(documents: DataFrame, *, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``documents`` with one row of each component: the one with the smallest id (none comes last), then the smallest text hash, then
    the smallest other columns.  Rows without words stay.  Rows are told apart by id and text (a 64-bit hash), so unlinked rows of
    one id all stay, as do rows without an id; column names may be any."""
    names = documents.columns
    docs, named = _linked(documents, n, num, den)
    rows = docs.where("n > 0").join(named.select("sig", "g"), "sig").select("g", "doc_id", "th")
    best = rows.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("b")).select("g", "b.doc_id", "b.th")
    times = rows.groupBy("doc_id", "th").agg(F.count("*").alias("times"))
    own_id, own_th, id_, th, times_ = private(names, "own_id", "own_th", "id", "th", "times")
    keys = best.join(times, best.doc_id.eqNullSafe(times.doc_id) & (best.th == times.th)).select(best.doc_id.alias(id_), best.th.alias(th), F.col("times").alias(times_))
    keyed = documents.withColumns({own_id: F.col("doc_id").cast("long"), own_th: F.xxhash64("text")})
    met = keyed.join(keys, F.col(own_id).eqNullSafe(F.col(id_)) & (F.col(own_th) == F.col(th)))
    quoted = [F.col(f"`{c}`") for c in names]
    once = met.where(F.col(times_) == 1).select(*quoted)
    again = met.where(F.col(times_) > 1).groupBy(own_id, own_th).agg(F.min(F.struct(*quoted)).alias("r")).select("r.*")
    bare = documents.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return once.union(again).union(bare)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(bounded(spark), sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, b AS m FROM both_ways UNION SELECT r.doc_id, both_ways.b FROM r JOIN both_ways ON r.m = both_ways.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.m), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""
