"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

A window is ``window`` consecutive words.  Every word that lies in a window whose words also start anywhere else
is removed; windows are judged on the input.  Comparing all documents with automata of all others would be
quadratic, so what has to meet is found first:

1. One pass hashes words and samples minimizers: of each window's runs of ``RUN`` words, the one with the least hash.
   Equal windows have equal minimizers, so a minimizer met once brings nothing.  Documents with equal word sequences are
   one class from here on; where a class has several documents, all their windows repeat.
2. Repeated minimizers are hits; a hit's route is the least class that has its minimizer.  Stretches around
   consecutive hits of one route go to the route's shard, so all places of a repeated window meet in one shard.
   Routes with very many hits are dealt on by minimizer, which keeps that property.
3. A shard's reference is its repeated material, each piece once (window fingerprints pick it).  Its
   suffix automaton is built, all stretches of the shard stream through it, and matches of ``window`` words or
   more are the spans to remove.
4. Spans are united by document and cut out.

A shard's automaton holds only distinct repeated words of the shard, and shards grow in number, not in size, with
the data.  A word is a 64-bit hash; distinct words meet with a chance near 2**-64.

Edge cases: null and empty texts have no words and keep nothing; texts with fewer words than a window stay whole; repeated rows
repeat each other; rows are told apart by id and text together, so null or repeated ids cost nothing; texts are read whole;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialize, partitions, table, texts, utf8
from .jaccard import _passing
from .suffix import SuffixAutomaton, merged
from .wordhash import GRAM_BASE, grams, hash_words, mix, powers

RUN = 12
FLUSH = 1 << 19  # minimizers packed at a time
HOT_HITS = 100_000  # hits of a route that go to one shard at most
SHARD_HITS = 20_000  # hits in a shard, about
BUCKET_BYTES = 64 << 20  # of text whose minimizers a bucket holds, about


def word_class(words: np.ndarray) -> int:
    """Of a word sequence, as a signed 64-bit number."""
    up, _ = powers(GRAM_BASE, len(words) + 1)
    return int(mix(np.array([(words * up[: len(words)]).sum(dtype=np.uint64) ^ np.uint64(len(words) * 0x9E3779B97F4A7C15 % (1 << 64))], np.uint64)).view(np.int64)[0])


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over each run of w, in log2(w) passes."""
    n, have, y = len(x) - w + 1, 1, x
    while 2 * have <= w:
        y = f(y[: len(y) - have], y[have:])
        have *= 2
    return f(y[:n], y[w - have : w - have + n])


def minimizers(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs that are least in some window."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, w = grams(words, RUN), window - RUN + 1
    least = _slide(a, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), w, np.maximum) == a)
    return at, a[at]


def _each(column: pa.Array) -> Iterator[np.ndarray]:
    offsets, data = utf8(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 22), "right")) - 1)
        words, at = hash_words(offsets[i : j + 1], data)
        at = at.tolist()
        for a, z in zip(at[:-1], at[1:], strict=True):
            yield words[a:z]
        i = j


def _scan(documents: DataFrame, window: int, buckets: int) -> DataFrame:
    """kind 0: a document's key, cls, n; kind 1: packed minimizers of a bucket.  documents: key, text."""
    names = ["kind", "key", "cls", "n", "bucket", "keys", "classes", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        seen: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate([x for x, _, _ in held])
            place, cls = np.concatenate([x for _, x, _ in held]).astype(np.uint32), np.repeat(np.array([c for _, _, c in held], np.int64), [len(x) for x, _, _ in held])
            h = mix(h ^ np.uint64(0x8BB84B93962EACC9))
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, place, cls, bucket = h.astype(np.uint32)[order], place[order], cls[order], bucket[order]
            ids, start = np.unique(bucket, return_index=True)
            ends = [*start[1:].tolist(), len(bucket)]
            part = lambda a: pa.array([a[x:y].tobytes() for x, y in zip(start.tolist(), ends, strict=True)], pa.binary())
            held.clear()
            no = pa.nulls(len(ids), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(ids), np.int32)), no, no, no, pa.array(ids.astype(np.int32)), part(h), part(cls), part(place)], names=names)

        for b in batches:
            n, classes = [], []
            for words in _each(b.column(1)):
                n.append(len(words))
                classes.append(c := word_class(words))
                if len(words) < window or c in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(c)
                place, h = minimizers(words, window)
                held.append((h, place, c))
                size += len(h)
                if size >= FLUSH:
                    yield flush()
                    size = 0
            no, empty = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int32)), b.column(0), pa.array(classes, pa.int64()), pa.array(n, pa.int64()), no, empty, empty, empty], names=names)
        if held:
            yield flush()

    return documents.select("key", "text").mapInArrow(run, "kind int, key long, cls long, n long, bucket int, keys binary, classes binary, places binary")


def _hits(packed: DataFrame) -> DataFrame:
    """cls, place, key, route of each place of a minimizer met more than once."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        key, cls, place = (np.frombuffer(b"".join(frame[c]), k) for c, k in (("keys", np.uint32), ("classes", np.int64), ("places", np.uint32)))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        many = np.zeros(len(k), bool)
        many[1:] |= same
        many[:-1] |= same
        order = order[many]
        key, cls, place = key[order], cls[order], place[order]
        order = np.lexsort((place, cls, key))
        key, cls, place = key[order], cls[order], place[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]) | (place[1:] != place[:-1])
        key, cls, place = key[fresh], cls[fresh], place[fresh]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(first)
        times = np.diff(np.append(start, len(key)))
        route, keep = np.repeat(cls[start], times), np.repeat(times > 1, times)
        return pd.DataFrame({"cls": cls[keep], "place": place[keep].astype(np.int64), "key": key[keep].astype(np.int64) | (bucket << 32), "route": route[keep]})

    return packed.groupBy("bucket").applyInPandas(run, "cls long, place long, key long, route long")


def _first_of_each(rows: DataFrame) -> DataFrame:
    """One row of each key (the first column) that a task reads, as far as it can tell; further ones are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keys = b.column(0).to_pylist()
            new = []
            for k in keys:
                new.append(k not in seen)
                if len(seen) < 1 << 20:
                    seen.add(k)
            yield b.filter(pa.array(new, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def _stretches(rows: DataFrame, window: int, shards: int) -> DataFrame:
    """shard, cls, first, words of the stretches around consecutive hits of one route; rows: text, cls, hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, of, first, out = [], [], [], []
            hits = b.column(b.schema.names.index("hits"))
            wanted = b.column(b.schema.names.index("cls")).to_pylist()
            for i, words in enumerate(_each(b.column(b.schema.names.index("text")))):
                if word_class(words) != wanted[i]:  # another row with this key
                    continue
                h = hits[i].values
                place, key, route, ways = (h.field(c).to_numpy() for c in ("place", "key", "route", "ways"))
                order = np.argsort(place, kind="stable")
                place, key, route, ways = place[order], key[order], route[order], ways[order].astype(np.uint64)
                sub = mix(key.view(np.uint64)) % ways
                g = mix(route.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sub)
                cut = np.flatnonzero((g[1:] != g[:-1]) | (np.diff(place) > 2 * window)) + 1
                for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
                    lo = max(0, int(place[a]) - (window - RUN))
                    hi = min(len(words), int(place[z - 1]) + window)
                    shard.append(int(g[a] % np.uint64(shards)))
                    of.append(wanted[i])
                    first.append(lo)
                    out.append(words[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(of, pa.int64()), pa.array(first, pa.int64()), pa.array(out, pa.binary())], names=["shard", "cls", "first", "words"])

    return rows.mapInArrow(run, "shard int, cls long, first long, words binary")


def reference(stretches: list[np.ndarray], identity: list[tuple[int, int]], window: int) -> list[np.ndarray]:
    """The repeated material of the stretches, each piece once; identity: (class, first place) of each."""
    long = [i for i, x in enumerate(stretches) if len(x) >= window]
    if not long:
        return []
    h = [grams(stretches[i], window) for i in long]
    n = np.array([len(x) for x in h])
    which, offset = np.repeat(np.array(long), n), np.concatenate([np.arange(k) for k in n])
    every = np.concatenate(h)
    cls = np.repeat(np.array([identity[i][0] for i in long], np.int64), n).view(np.uint64)
    place = mix(cls * np.uint64(0xD6E8FEB86659FD93) + (np.repeat(np.array([identity[i][1] for i in long]), n) + offset).astype(np.uint64))
    order = np.argsort(every, kind="stable")
    start = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
    p = place[order]
    repeated = np.minimum.reduceat(p, start) != np.maximum.reduceat(p, start)  # at two places at least
    pick = np.sort(order[start[repeated]])  # the first of each
    if not len(pick):
        return []
    run = np.flatnonzero(np.append(True, (which[pick][1:] != which[pick][:-1]) | (offset[pick][1:] != offset[pick][:-1] + 1)))
    out = []
    for a, z in zip(run.tolist(), [*run[1:].tolist(), len(pick)], strict=True):
        out.append(stretches[which[pick[a]]][offset[pick[a]] : offset[pick[z - 1]] + window])
    return out


def _spans(stretches: DataFrame, window: int) -> DataFrame:
    """cls, spans (packed pairs of places)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(x, np.uint64) for x in frame["words"]]
        identity = list(zip(frame["cls"].tolist(), frame["first"].tolist(), strict=True))
        automaton = SuffixAutomaton(x.tolist() for x in reference(words, identity, window))
        found: dict[int, list[np.ndarray]] = {}
        done: dict[bytes, np.ndarray] = {}  # a passage comes as the same stretch again and again
        for x, raw, (cls, first) in zip(words, frame["words"], identity, strict=True):
            if raw not in done:
                done[raw] = np.array(automaton.cover(x.tolist(), window), np.int64).reshape(-1, 2)
            if len(done[raw]):
                found.setdefault(cls, []).append(done[raw] + first)
        return pd.DataFrame({"cls": list(found), "spans": [merged(np.concatenate(x)).tobytes() for x in found.values()]}).astype({"cls": "int64"})

    return stretches.groupBy("shard").applyInPandas(run, "cls long, spans binary")


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def remove_repeats(documents: DataFrame, *, window: int = 35, view=None, schema: str = KEPT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words kept, joined by one space) of every row, or what ``view`` makes of such a batch."""
    spark = documents.sparkSession
    # a row's key stands for its id and text: null or repeated ids don't bring different texts together
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    buckets = max(8, partitions(spark), size // BUCKET_BYTES)
    scanned = materialize(_scan(rows, window, buckets), "substrings-scan")
    docs = scanned.where("kind = 0").select("key", "cls", "n").where(F.col("n") >= window)
    hits = materialize(_hits(scanned.where("kind = 1").select("bucket", "keys", "classes", "places")), "substrings-hits")
    hot = hits.groupBy("route").count().where(F.col("count") > HOT_HITS).select("route", F.ceil(F.col("count") / HOT_HITS).cast("long").alias("ways"))
    # at most one route in HOT_HITS hits is hot
    dealt = hits.join(F.broadcast(hot), "route", "left").select("cls", F.struct("place", "key", "route", F.coalesce("ways", F.lit(1).cast("long")).alias("ways")).alias("hit"))
    by_class = dealt.groupBy("cls").agg(F.collect_list("hit").alias("hits"))
    # a class is read from the rows of one key: one row, but where id and text are repeated together
    classes = docs.groupBy("cls", "key").agg(F.count("*").alias("same")).groupBy("cls").agg(F.min(F.struct("key", "same")).alias("of"), F.sum("same").alias("copies"))
    wanted = materialize(by_class.join(classes, "cls").select("cls", "of.key", "of.same", "hits"), "substrings-wanted")
    once, several = wanted.where("same = 1").drop("same"), wanted.where("same > 1").drop("same")
    text_of = rows.select("key", "text")
    joined = _passing(text_of, "key", once.select("key")).join(once, "key").select("text", "cls", "hits")
    if several.limit(1).count():
        alike = _first_of_each(_passing(text_of, "key", several.select("key"))).groupBy("key").agg(F.first("text").alias("text"))
        joined = joined.unionByName(alike.join(several, "key").select("text", "cls", "hits"))
    n_hits = hits.count()
    shards = max(buckets, -(-n_hits // SHARD_HITS))
    spans = materialize(_spans(_stretches(joined, window, shards), window), "substrings-spans")
    spans = spans.groupBy("cls").agg(F.collect_list("spans").alias("spans"))
    found = docs.join(classes.select("cls", "copies"), "cls").join(spans, "cls", "left").where("copies > 1 OR spans IS NOT NULL")
    # one cut a key (hashes aside): the rows that share it share their text
    cuts = found.select("key", F.struct("cls", (F.col("copies") > 1).alias("all"), "spans").alias("cut")).distinct().groupBy("key").agg(F.collect_list("cut").alias("cuts")).withColumnRenamed("key", "_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = b.column(2)
            has = np.flatnonzero(~np.asarray(cuts.is_null()))
            of = dict(zip(has.tolist(), _each(b.column(1).take(pa.array(has))), strict=True))
            n, gone, kept = [], [], []
            for i, raw in enumerate(texts(b.column(1))):
                words = raw.split()
                n.append(len(words))
                mine = [c for c in cuts[i].as_py() if c["cls"] == word_class(of[i])] if i in of and len(words) >= window else []
                if any(c["all"] for c in mine):
                    keep: list[bytes] = []
                elif mine:
                    keep, at = [], 0
                    for a, z in merged(np.concatenate([np.frombuffer(s, np.int64).reshape(-1, 2) for c in mine for s in c["spans"]])).tolist():
                        keep += words[at:a]
                        at = z
                    keep += words[at:]
                else:
                    keep = words
                gone.append(len(words) - len(keep))
                kept.append(b" ".join(keep))
            made = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
            yield view(made) if view else made

    out = rows.join(cuts, rows["key"] == cuts["_key"], "left").select("doc_id", "text", "cuts")
    return out.mapInArrow(cut, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([hashlib.sha256(x).hexdigest() for x in texts(b.column(3))], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return remove_repeats(table(bounded(spark), sf_dir, "documents"), view=digest, schema="doc_id long, n_words long, n_removed long, kept_sha256 string")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE g IN (SELECT g FROM rep)),
k AS (SELECT doc_id, w, list(p) AS ps FROM d JOIN gone USING (doc_id) GROUP BY doc_id, w),
r AS (SELECT doc_id, len(ps) AS n_removed, array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ') AS kept FROM k)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(r.kept, array_to_string(w, ' '))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
