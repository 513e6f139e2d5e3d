"""Benchmark decontamination with a generalised suffix automaton.

Items are normalised (A-Z lower-cased; words are runs of characters other than ASCII ones that are not
0-9 or a-z), and a generalised suffix automaton is built over their words.

A benchmark of at most ``shard_words`` words is one automaton, which is broadcast, and documents stream through it in one narrow pass.
A larger one is dealt to shards of about that size.  A filter of a fixed size over all windows then finds, in one pass, the
documents that can hit; only those are written, and each goes to the shards whose windows it has.  A task there builds its shard's
automaton and streams its documents through it.  A shard that many documents ask for is built several times, and they are dealt among
its copies.

Words stream as ids; stretches whose neighbouring words stand side by side in no item leave the automaton at
length one and are jumped over without walking it.

The longest match at each word gives the hits: a match of ``window`` words or more covers its last ``window``
words, and the state of those words names the items that hold them; an item shorter than the window hits
where the match ends with the whole item.

Edge cases: null texts have no words, and items without words never occur; rows of one item_id are one item, with the windows of all
its rows; an item with a null id hits, but is in no count or list of items; equal items with different ids all count; repeated documents are judged each for itself; no items or no documents give no hits or no
rows; texts are streamed whole; columns other than those named are passed through or ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .common import bounded, materialize, table, tidy, utf8
from .jaccard import _bloom, _probes
from .wordhash import PUNCT, grams, hash_words, mix

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHARD_WORDS = 200_000
GROUP = 1 << 20  # bytes of text hashed in one go
ASKED = 1 << 9  # documents that one copy of a shard streams, about


def normalised(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton over word sequences."""

    def __init__(self, items: Sequence[tuple[str | None, Sequence[int]]], window: int):
        self.window, self.names = window, [n for n, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        at: list[set[int]] = [set()]  # items whose words end here
        for no, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w, at)
                at[last].add(no)
        order = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        #: items that hold the last ``window`` words, for the one state on each path of links that has that length
        for s in order:
            p = self.link[s]
            if p > 0 and self.length[p] >= window:
                at[p] |= at[s]
            elif self.length[s] < window:
                at[s] = set()
        self.items = [frozenset(x) if x and self.length[i] >= window else frozenset() for i, x in enumerate(at)]
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for no, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                s = 0
                for w in words:
                    s = self.next[s][w]
                self.short[s] = (*self.short[s], (len(words), no))
        for s in reversed(order):  # by rising length
            self.short[s] = self.short[s] + self.short[self.link[s]]

    def _new(self, at: list[set[int]], length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        at.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int, at: list[set[int]]) -> int:
        """A copy of q for the words that reach it through p by its shortest way."""
        c = self._new(at, self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int, at: list[set[int]]) -> int:
        if (q := self.next[last].get(w)) is not None:  # the words are there from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, at)
        new, p = self._new(at, self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, at)
        return new

    def stream(self, words: Sequence[int], hit: np.ndarray, found: set[int], offset: int = 0) -> None:
        """Mark hits of one stretch of words in ``hit`` (from ``offset``) and add the items that occur."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        s = n = 0
        for i, w in enumerate(words):
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if w in nxt[s]:
                s = nxt[s][w]
                n += 1
            else:
                s = n = 0
            if n >= window:
                v = s
                while length[link[v]] >= window:
                    v = link[v]
                found |= self.items[v]
                hit[offset + i + 1 - window : offset + i + 1] = True
            if self.short[s]:
                for m, no in self.short[s]:
                    if m <= n:
                        found.add(no)
                        hit[offset + i + 1 - m : offset + i + 1] = True


class Shard:
    """An automaton with what is needed to jump to the stretches that can hit."""

    def __init__(self, items: Sequence[tuple[str | None, Sequence[int]]], window: int):
        self.vocabulary = np.unique(np.array([w for _, x in items for w in x], np.uint64))
        ids = [(n, np.searchsorted(self.vocabulary, np.array(x, np.uint64)).tolist()) for n, x in items]
        size = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * size + b for _, x in ids for a, b in zip(x, x[1:], strict=False)], np.int64))
        self.automaton = Automaton(ids, window)
        self.least = min([window, *(len(x) for _, x in ids)])

    def called(self, found: set[int]) -> list[str]:
        """Names of the items found, each once."""
        return sorted({self.automaton.names[x] for x in found} - {None})

    def scan(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, set[int]]]:
        """(text, hits by word, items) of the texts that have a stretch long enough to hit."""
        size = len(self.vocabulary)
        if not size or not len(hashes):
            return
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == size] = 0
        known = self.vocabulary[at] == hashes
        joined = np.zeros(len(hashes), bool)  # a word that goes on from the word before
        if len(self.pairs):
            second = np.flatnonzero(known[1:] & known[:-1]) + 1
            key = at[second - 1] * size + at[second]
            p = np.searchsorted(self.pairs, key)
            p[p == len(self.pairs)] = 0
            joined[second[self.pairs[p] == key]] = True
        joined[counts[:-1][counts[:-1] < len(hashes)]] = False  # no stretch goes on into the next text
        begins = np.flatnonzero(known & ~joined)
        ends = np.append(np.flatnonzero(~joined), len(hashes))
        ends = ends[np.searchsorted(ends, begins, "right")]
        long = ends - begins >= self.least
        begins, ends = begins[long], ends[long]
        text = np.searchsorted(counts, begins, "right") - 1
        i = 0
        while i < len(begins):
            t = int(text[i])
            hit, found = np.zeros(int(counts[t + 1] - counts[t]), bool), set()
            while i < len(begins) and text[i] == t:
                self.automaton.stream(at[begins[i] : ends[i]].tolist(), hit, found, int(begins[i] - counts[t]))
                i += 1
            if found:
                yield t, hit, found


def item_words(items: DataFrame, most: int, window: int) -> DataFrame:
    """name, words (packed hashes), n of the items that have words; a longer item than ``most`` words is cut into overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, at = hash_words(*utf8(b.column(1)), cut=PUNCT, lower=True)
            names, words = [], []
            for name, a, z in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for i in range(a, max(a + 1, z - window + 1), most):
                    if z > a:
                        names.append(name)
                        words.append(hashes[i : min(z, i + most + window - 1)])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64())], names=["name", "words", "n"])

    return items.select(F.col("item_id").cast("string").alias("name"), F.col("text")).mapInArrow(run, "name string, words binary, n long")


def _unpacked(rows) -> list[tuple[str | None, list[int]]]:
    return [(name, np.frombuffer(words, np.uint64).tolist()) for name, words in rows]


MARKS = "_text string, _n_words int, _hit binary, _items array<string>"


def mark(documents: DataFrame, items: DataFrame, *, window: int = 10, text: str = "text", keep: Sequence[str] = ("doc_id",), shard_words: int = SHARD_WORDS) -> DataFrame:
    """``keep``'s columns (none named as the others) and _text, _n_words, _hit, _items as ``_mark`` says."""
    return _mark(documents, items, window, text, keep, shard_words).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def _mark(documents: DataFrame, items: DataFrame, window: int, text: str, keep: Sequence[str], shard_words: int, finish=None, schema=None) -> DataFrame:
    """``finish`` (a function of a batch, with the ``schema`` it makes) is applied in the same pass to
    ``keep``'s columns as k0, k1, ... and _text, _n_words int, _hit binary (a bit for each word; empty: none), _items array<string>."""
    spark = documents.sparkSession
    rows = documents.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("_text"))
    marked = StructType([*rows.schema.fields[:-1], *DataType.fromDDL(MARKS).fields])
    schema, finish = schema or marked, finish or (lambda b: b)
    words = materialize(item_words(items, shard_words // 4, window), "items")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    if total > shard_words:
        return _dealt(rows, words, window, -(-total // shard_words), finish, schema)
    sent = spark.sparkContext.broadcast(Shard(_unpacked(words.select("name", "words").collect()), window))  # at most shard_words words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for b in batches:
            n, hit, found = np.zeros(b.num_rows, np.int64), [b""] * b.num_rows, [[]] * b.num_rows
            for i, hashes, counts in _pieces(b.column(b.num_columns - 1)):
                n[i : i + len(counts) - 1] = np.diff(counts)
                for t, marks, occurring in s.scan(hashes, counts):
                    hit[i + t], found[i + t] = np.packbits(marks).tobytes(), s.called(occurring)
            yield finish(_with_marks(b, n, hit, found))
        tidy()

    return rows.mapInArrow(run, schema)


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, words before each text), some megabytes of text at a time."""
    offsets, data = utf8(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
        yield i, *hash_words(offsets[i : j + 1], data, cut=PUNCT, lower=True)
        i = j


def _with_marks(b: pa.RecordBatch, n: np.ndarray, hit: list[bytes], found: list[list[str]]) -> pa.RecordBatch:
    """The batch (its last column the texts) with the marks behind it."""
    return pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32()), pa.array(hit, pa.binary()), pa.array(found, pa.list_(pa.string()))], names=[*b.schema.names, "_n_words", "_hit", "_items"])


def _windows(words: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the runs of m words, different for each m."""
    return mix(grams(words, m) + np.uint64(m * 0x9E3779B97F4A7C15 % (1 << 64)))


def _dealt(rows: DataFrame, words: DataFrame, window: int, shards: int, finish, schema) -> DataFrame:
    """``_mark`` for benchmarks of several shards."""
    spark = rows.sparkSession
    words = words.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard, raw in zip(f["shard"].tolist(), f["words"], strict=True):
                w = np.frombuffer(raw, np.uint64)
                yield pd.DataFrame({"gram": _windows(w, min(window, len(w))).view(np.int64), "shard": shard})

    at = materialize(words.select("shard", "words").mapInPandas(cut, "gram long, shard long").distinct(), "item-windows")
    sizes = [r.m for r in words.select(F.least("n", F.lit(window)).alias("m")).distinct().collect()]  # at most window numbers
    sent = spark.sparkContext.broadcast(_bloom(at.select("gram")))  # BLOOM_BITS

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, size = sent.value
        for b in batches:
            n, met = np.zeros(b.num_rows, np.int64), [b""] * b.num_rows
            for i, hashes, counts in _pieces(b.column(b.num_columns - 1)):
                n[i : i + len(counts) - 1] = np.diff(counts)
                for t in range(len(counts) - 1):
                    mine = [_windows(hashes[counts[t] : counts[t + 1]], m) for m in sizes]
                    every = np.unique(np.concatenate(mine))
                    ok = np.ones(len(every), bool)
                    for p in _probes(every, size):
                        ok &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
                    met[i + t] = every[ok].tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32()), pa.array(met, pa.binary())], names=[*b.schema.names, "_n_words", "_met"])
        tidy()

    first = rows.mapInArrow(meet, StructType([*rows.schema.fields, *DataType.fromDDL("_n_words int, _met binary").fields]))
    able = materialize(first.where(F.length("_met") > 0).withColumn("_row", F.monotonically_increasing_id()), "candidates")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row, raw in zip(f["_row"].tolist(), f["_met"], strict=True):
                yield pd.DataFrame({"_row": row, "gram": np.frombuffer(raw, np.int64)})

    asking = materialize(able.select("_row", "_met").mapInPandas(spread, "_row long, gram long").join(at, "gram").select("_row", "shard").distinct(), "asking")
    ways = asking.groupBy("shard").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("ways"))
    copies = words.join(ways, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).select("shard", "copy", "name", "words")
    texts_ = asking.join(ways, "shard").withColumn("copy", F.pmod(F.xxhash64("_row"), F.col("ways")).cast("int")).join(able.select("_row", "_text"), "_row").select("shard", "copy", "_row", "_text")

    def search(held: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(some):
            s = Shard(_unpacked(zip(held["name"], held["words"], strict=True)), window)
            for i, hashes, counts in _pieces(pa.array(some["_text"], pa.string())):
                out += [(int(some["_row"].iloc[i + t]), np.packbits(marks).tobytes(), s.called(found)) for t, marks, found in s.scan(hashes, counts)]
        return pd.DataFrame(out, columns=["_row", "hit", "items"]).astype({"_row": "int64"})

    hits = copies.groupBy("shard", "copy").cogroup(texts_.groupBy("shard", "copy")).applyInPandas(search, "_row long, hit binary, items array<string>")
    hits = hits.groupBy("_row").agg(F.collect_list(F.struct("hit", "items")).alias("_hits"))  # at most a row for each shard

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, found = [], []
            for got in b.column(b.num_columns - 1).to_pylist():
                bits = [np.frombuffer(g["hit"], np.uint8) for g in got or ()]
                hit.append(np.bitwise_or.reduce(bits).tobytes() if bits else b"")
                found.append(sorted({x for g in got or () for x in g["items"]}))
            k = b.num_columns - 2
            yield finish(_with_marks(b.select(range(k)), np.asarray(b.column(k)), hit, found))
        tidy()

    rest = first.where(F.length("_met") == 0).drop("_met").withColumn("_hits", F.lit(None).cast("array<struct<hit:binary,items:array<string>>>"))
    return able.join(hits, "_row", "left").drop("_row", "_met").unionByName(rest).mapInArrow(unite, schema)


def clean(documents: DataFrame, items: DataFrame, *, window: int = 10, min_span: int = 1, max_coverage: float = 0.8, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``documents`` without leaked passages.

    Spans of hit words (as long as they go on, over several items perhaps) that are at least ``min_span`` words long are cut
    out of the text with the characters between their words; a document goes entirely where hits cover
    more than ``max_coverage`` of its words.  n_chars, if there, follows the text.  Null texts and texts without hits stay as they are,
    repeated rows are treated alike, and the other columns pass through under any names.
    """
    keep = [c for c in documents.columns if c != "text"]

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.schema.names
        hit, text, kept = b.column(names.index("_hit")).to_pylist(), b.column(names.index("_text")), np.ones(b.num_rows, bool)
        changed = [i for i, h in enumerate(hit) if h]
        if changed:
            out = text.to_pylist()
            for i in changed:
                raw = out[i].encode()
                spots = [m.span() for m in WORD.finditer(raw.lower())]
                marks = np.unpackbits(np.frombuffer(hit[i], np.uint8), count=len(spots)).astype(np.int8)
                kept[i] = marks.mean() <= max_coverage
                edge = np.diff(marks, prepend=0, append=0)
                parts, at = [], 0
                for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                    if z - a >= min_span:
                        parts.append(raw[at : spots[a][0]])
                        at = spots[z - 1][1]
                out[i] = b"".join([*parts, raw[at:]]).decode()
            text = pa.array(out, text.type)
        return pa.RecordBatch.from_arrays([text if c == "_text" else b.column(j) for j, c in enumerate(names)], names=names).filter(pa.array(kept))

    out = _mark(documents, items, window, "text", keep, shard_words, cut)
    place = {c: F.col(f"k{i}") for i, c in enumerate(keep)} | {"text": F.col("_text")}
    if "n_chars" in keep:
        place["n_chars"] = F.length("_text").cast(documents.schema["n_chars"].dataType)
    return out.select(*[place[c].alias(c) for c in documents.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.schema.names
        n = [int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) if h else 0 for h in b.column(names.index("_hit")).to_pylist()]
        items = [sorted(set(x), key=str.encode) for x in b.column(names.index("_items")).to_pylist()]
        columns = [b.column(0).cast(pa.int64()), b.column(names.index("_n_words")).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([x > 0 for x in n], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return _mark(table(bounded(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, "text", ("doc_id",), SHARD_WORDS, digest, schema)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
dg AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT dg.doc_id, dg.i, dg.m, win.item_id FROM dg JOIN win ON win.m = dg.m AND win.g = dg.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
