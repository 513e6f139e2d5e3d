"""Token-id output: documents to id files under the adaptive range coder, and back.

Writing.  Documents are range-partitioned by doc_id and sorted within each partition, which is a shard of the
file.  A shard is a sequence of records; a record holds whole documents (their ids, token counts and place in
the shard) and their ids as independently reset, checksummed blocks.  Records are rows of a Parquet
container, so any store that Spark reaches can hold them, commits are atomic and lost executors are redone.

Reading.  Each record is decoded by itself, checksums verified.  A document's place among all ids is its
shard's place (a sum over one number for each shard) plus its place in the shard.

Tokenising.  Texts are cut where the tokenizer's own pre-tokenizer cuts in any case; the tokenizers library encodes each
piece when it is first met, and numpy puts the pieces' ids side by side.

Edge cases: null and empty texts hold the end id only; null ids come first; rows with one doc_id follow each other
by a hash of the text, then the text;
texts of any length are encoded whole, in as many blocks as needed; no documents give an empty file; only doc_id and
text are read.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shared_dir, table, tidy, utf8
from .rangecoder import BLOCK_IDS, decode, encode
from .wordhash import hash_spans

PIECE = 1 << 20  # bytes of text (or one text) that are encoded in one go
SLOTS = 1 << 20  # places of the table of pieces, half of them used at most
PART = SLOTS // 4  # pieces that are looked up in one go
LINES = 512  # words that the library gets as one text
POOL = 1 << 23  # ids that the table's pieces have, about
FILE_SCHEMA = "shard int, record int, first long, alphabet int, doc_ids binary, doc_nulls binary, n_tokens binary, ids binary"
_SOLID = np.zeros(256, bool)  # visible ASCII characters
_SOLID[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# fixed values: the characters by which byte-level vocabularies write bytes; visible ones stand for themselves, others follow U+0100
_SHOWN = np.zeros(256, bool)
_SHOWN[[*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]] = True
_WRITTEN = np.where(_SHOWN, np.arange(256), 0xFF + np.cumsum(~_SHOWN)).astype("<u4")


def _letters(text: np.ndarray) -> np.ndarray:
    """Which bytes are of Latin letters: ASCII, and of the characters of two bytes C3 to C9 all but U+00D7 and U+00F7."""
    latin = _LETTER[text]
    lead = (text[:-1] >= 0xC3) & (text[:-1] <= 0xC9) & ~((text[:-1] == 0xC3) & ((text[1:] == 0x97) | (text[1:] == 0xB7)))
    latin[:-1] |= lead
    latin[1:] |= lead
    return latin


class Encoder:
    """Ids by the tokenizers library, which sees each piece of text once as long as the table of pieces lasts.

    Text is cut where the byte-level pre-tokenizer begins a word in any case: before a single space or around a single line
    end between visible characters (ASCII, or of two bytes from U+00C0 on), and between a Latin letter and ASCII punctuation
    that no special string holds.  So the pieces' ids side by side are the text's.  A tokenizer of another kind gets whole texts.
    A piece of Latin letters, with or without a space before them, is one word of that pre-tokenizer and goes to the library's model.
    When the table is full, pieces met again since the last time stay and the others go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.size = self.tk.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        special = "".join(t["content"] for t in parts["added_tokens"])
        plain = special.isascii() and not any(c.isspace() for c in special) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"])
        self.stops = _SOLID & ~_LETTER  # punctuation that ends a word
        self.stops[[*range(0x30, 0x3A), *special.encode()]] = False
        self.words = all(not _letters(np.frombuffer(t["content"].encode(), np.uint8)).all() for t in parts["added_tokens"])
        self.cuts = bool(plain and parts.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"))
        line = self.tk.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.start, self.count = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.again = np.zeros(SLOTS, bool)
        self.pool, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0

    def _prune(self) -> None:
        stay = np.flatnonzero(self.again)
        if len(stay) > SLOTS // 4 or int(self.count[stay].sum()) > POOL // 2:
            stay = stay[:0]
        h, start, count, pool = self.key[stay], self.start[stay], self.count[stay].astype(np.int64), self.pool
        self._clear()
        self._put(h, pool[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))], count)

    def _library(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out, each = array("I"), []
        for e in self.tk.encode_batch_fast(some, add_special_tokens=False):
            ids = e.ids
            each.append(len(ids))
            out.extend(ids)
        return np.frombuffer(out, np.uint32) if len(out) else np.zeros(0, np.uint32), np.array(each, np.int64)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is in the table; -1 where it is not."""
        at, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            k = self.key[slot]
            hit = k == h[left]
            at[left[hit]] = slot[hit]
            on = ~hit & (k != 0)
            left, slot = left[on], (slot[on] + 1) & (SLOTS - 1)
        return at

    def _learn(self, h: np.ndarray, text: np.ndarray, latin: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Put pieces (distinct, not in the table yet) into it: words of letters go to the library's model, other words to the
        library as lines, LINES at a time, others one by one."""
        if self.words:
            odd = np.flatnonzero(~latin)
            solid = begin + (text[begin] == 0x20)
            pure = (solid < end) & (np.searchsorted(odd, solid) == np.searchsorted(odd, end))
            at = np.flatnonzero(pure)
            size = end[at] - begin[at]
            stop = np.cumsum(size)
            shown = _WRITTEN[text[np.repeat(begin[at] - (stop - size), size) + np.arange(int(size.sum()))]].tobytes().decode("utf-32-le")
            out, each, tokenize = [], [], self.tk.model.tokenize
            for a, z in zip((stop - size).tolist(), stop.tolist(), strict=True):
                ids = [t.id for t in tokenize(shown[a:z])]
                each.append(len(ids))
                out += ids
            self._put(h[at], np.array(out, np.uint32), np.array(each, np.int64))
            h, begin, end = h[~pure], begin[~pure], end[~pure]
            if not len(h):
                return
        blank = np.flatnonzero(text <= 0x20)
        first, last, before = text[begin], text[end - 1], text[np.maximum(end - 2, 0)]
        word = (np.searchsorted(blank, end) - np.searchsorted(blank, begin) == (first == 0x20)) & (_SOLID[last] | ((end - begin > 2) & (before >= 0xC3) & (before < 0xE0))) & (self.line >= 0)
        at, rest = np.flatnonzero(word), np.flatnonzero(~word)
        size = end[at] - begin[at] + 1
        stop = np.cumsum(size)
        lines = text[np.minimum(np.repeat(begin[at] - (stop - size), size) + np.arange(int(size.sum())), len(text) - 1)]
        lines[stop - 1] = 0x0A
        cut = [0, *stop[LINES - 1 :: LINES].tolist(), len(lines)]
        ids, _ = self._library([lines[a:z].tobytes().decode() for a, z in zip(cut[:-1], cut[1:], strict=True) if z > a])
        ends = np.flatnonzero(ids == self.line)
        if len(ends) == len(at):
            self._put(h[at], np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)
        else:  # another vocabulary may hold the line end in a longer token
            rest = np.arange(len(h))
        raw = text.tobytes() if len(rest) else b""
        self._put(h[rest], *self._library([raw[a:z].decode() for a, z in zip(begin[rest].tolist(), end[rest].tolist(), strict=True)]))

    def _put(self, h: np.ndarray, ids: np.ndarray, each: np.ndarray) -> None:
        """Put pieces (distinct, not in the table yet) into it."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(each) - each
        self.used += len(ids)
        self.held += len(h)
        left, slot = np.arange(len(h)), (h & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.key[slot] == 0
            put = np.flatnonzero(free)
            _, first = np.unique(slot[put], return_index=True)  # of pieces that meet in a slot, one takes it
            put = put[first]
            who, where = left[put], slot[put]
            self.key[where], self.start[where], self.count[where] = h[who], start[who], each[who]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], slot[rest]
            slot = np.where(self.key[slot] != 0, (slot + 1) & (SLOTS - 1), slot)

    def _cuts(self, text: np.ndarray, latin: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where pieces begin, ``places`` among them."""
        begins = np.zeros(len(text) + 1, bool)
        begins[places] = True
        if len(text) < 3:
            return np.flatnonzero(begins)
        solid = _SOLID[text]
        two = (text >= 0xC3) & (text < 0xE0)  # begins a character of two bytes, none of them white space
        opens = solid | two
        closes = solid.copy()
        closes[1:] |= two[:-1]
        closed, opened = closes[:-2], opens[2:]
        between = closed & opened  # of the byte in the middle
        middle = text[1:-1]
        line = between & (middle == 0x0A)
        begins[1:-2] |= (between & (middle == 0x20)) | line
        begins[2:-1] |= line
        begins[1:-1] |= latin[:-1] & self.stops[text[1:]]
        return np.flatnonzero(begins)

    def _pieces(self, text: np.ndarray, latin: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids one after another) of at most PART pieces, which the table can hold whatever they are."""
        begin, end = cut[:-1], cut[1:]
        h = hash_spans(text, begin, end)
        at = self._slots(h)
        self.again[at[at >= 0]] = True
        new = np.flatnonzero(at < 0)
        if len(new):
            hashes, first = np.unique(h[new], return_index=True)
            if self.held + len(hashes) > SLOTS // 2 or self.used > POOL:
                self._prune()
                at = self._slots(h)
                new = np.flatnonzero(at < 0)
                hashes, first = np.unique(h[new], return_index=True)
            some = new[first]
            self._learn(hashes, text, latin, begin[some], end[some])
            at[new] = self._slots(h[new])
        count = self.count[at].astype(np.int64)
        return count, self.pool[np.repeat(self.start[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]

    def encode(self, offsets: np.ndarray, data: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, number of each text), each text ended by ``end_id``; texts are data[offsets[i] : offsets[i + 1]]."""
        lo, n = int(offsets[0]), len(offsets) - 1
        text = data[lo : int(offsets[-1])]
        places = offsets - lo
        if not self.cuts:
            raw, cut = text.tobytes(), places.tolist()
            ids, each = self._library([raw[a:z].decode() for a, z in zip(cut[:-1], cut[1:], strict=True)])
            ends = np.cumsum(each)
            return np.insert(ids, ends, end_id), each + 1
        latin = _letters(text)
        cut = self._cuts(text, latin, places)  # empty texts share a place
        got = [self._pieces(text, latin, cut[i : i + PART + 1]) for i in range(0, len(cut) - 1, PART)]
        count = np.concatenate([c for c, _ in got]) if got else np.zeros(0, np.int64)
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        each = np.diff(before[np.searchsorted(cut, places)]) + 1
        ends = np.cumsum(each)
        out = np.empty(int(before[-1]) + n, np.uint32)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[~keep] = end_id
        if got:
            out[keep] = np.concatenate([i for _, i in got])
        return out, each


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", record_ids: int = BLOCK_IDS) -> None:
    """Write all documents' ids to ``path``, in ascending id order."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("spread"))
    # the hash deals rows of one id (or without any) to several ranges
    rows = rows.repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        held_ids: list[np.ndarray] = []
        held_n: list[np.ndarray] = []
        held_doc: list[np.ndarray] = []
        held_null: list[np.ndarray] = []
        n = record = first = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held_ids)
            arrays = [[shard], [record], [first], [enc.size], [np.concatenate(held_doc).astype("<i8").tobytes()], [np.packbits(np.concatenate(held_null)).tobytes()], [np.concatenate(held_n).astype("<i8").tobytes()], [encode(ids, max(enc.size, end_id + 1))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            for x in (held_ids, held_n, held_doc, held_null):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=[f.split()[0] for f in FILE_SCHEMA.split(", ")])

        for b in batches:
            doc = b.column(0)
            nulls, doc = np.asarray(doc.is_null()), np.asarray(doc.fill_null(0))
            offsets, data = utf8(b.column(1))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
                ids, each = enc.encode(offsets[i : j + 1], data, end_id)
                at = 0
                a = 0
                # records are cut between documents
                ends = np.cumsum(each)
                while a < j - i:
                    z = max(a + 1, int(np.searchsorted(ends, at + record_ids - n, "right")))
                    held_ids.append(ids[at : ends[z - 1]])
                    held_n.append(each[a:z])
                    held_doc.append(doc[i + a : i + z])
                    held_null.append(nulls[i + a : i + z])
                    n += int(ends[z - 1]) - at
                    at, a = int(ends[z - 1]), z
                    if n >= record_ids or a < j - i:
                        yield flush()
                        first, n, record = first + n, 0, record + 1
                i = j
        if held_ids:
            yield flush()
        tidy()

    rows.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, shard, place (ids before it in its shard), ids (array of int) of every document in the file."""
    return _read(spark, path, lambda ids, n, cuts: {"ids": [x.tolist() for x in np.split(ids, cuts[:-1])]}, "ids array<int>")


def _read(spark: SparkSession, path: str, view, columns: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                n = np.frombuffer(r.n_tokens, "<i8")
                doc = pd.array(np.frombuffer(r.doc_ids, "<i8"), "Int64")
                doc[np.unpackbits(np.frombuffer(r.doc_nulls, np.uint8), count=len(n)).astype(bool)] = pd.NA
                ids = decode(r.ids)
                cuts = np.cumsum(n)
                if len(n) and cuts[-1] != len(ids):
                    raise ValueError("token counts and ids disagree")
                yield pd.DataFrame({"doc_id": doc, "shard": r.shard, "place": r.first + cuts - n, "n_tokens": n} | view(ids, n, cuts))
        tidy()

    # one record is some megabytes of ids: a batch of few rows keeps memory bounded
    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInPandas(run, f"doc_id long, shard int, place long, n_tokens long, {columns}")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the file."""

    def crc(ids: np.ndarray, n: np.ndarray, cuts: np.ndarray) -> dict:
        raw = memoryview(ids.astype("<u4").tobytes())
        return {"ids_crc32": [zlib.crc32(raw[4 * (z - k) : 4 * z]) for z, k in zip(cuts.tolist(), n.tolist(), strict=True)]}

    docs = _read(spark, path, crc, "ids_crc32 long")
    shard_ids = docs_per_shard(spark, path)
    starts, total = [], 0
    for shard, n in shard_ids:
        starts.append((shard, total))
        total += n
    side = F.broadcast(spark.createDataFrame(starts, "shard int, shard_start long"))  # one row for each shard
    return docs.join(side, "shard").select("doc_id", (F.col("shard_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def docs_per_shard(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(shard, number of its ids), by shard: from the counts alone, one row for each shard to the driver."""

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"shard": f["shard"], "n": [int(np.frombuffer(x, "<i8").sum()) for x in f["n_tokens"]]})

    counts = spark.read.schema(FILE_SCHEMA).parquet(path).select("shard", "n_tokens").mapInPandas(total, "shard int, n long")
    return [(r.shard, r.n) for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()]


def encode_and_read(documents: DataFrame, tokenizer: str) -> DataFrame:
    import uuid

    spark = documents.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write_ids(documents, path, tokenizer)
    return digests(spark, path)


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_read(table(bounded(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
