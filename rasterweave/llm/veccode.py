"""Vector code compression: product codes whose entries are found by partial-distance search.

Vectors become integers floor(scale * x) and are cut into ``parts`` equal runs of components.  Each run has a codebook of at most
``entries`` entries.  It starts as that run of the smallest ids; in each of ``rounds`` passes, tasks assign the vectors they read and add up
the components by entry, these sums (their number does not depend on the rows) are added over all tasks, and each entry becomes
the floor of its mean; unused ones stay.  A last pass assigns all vectors again.

Partial-distance search.  Components of a run are gone through in descending variance over its codebook.  After the first, each vector's
entry with the least distance so far is followed to its complete distance, which bounds the search; an entry whose accumulated
distance strictly exceeds the bound is dropped by a mask over all (vector, entry) pairs of a batch, and only pairs left take the
next component.  After each component the bound is lowered by the complete distance of the entry that leads then.  Distances are
integers, so the entry found is exactly the nearest, the smaller index among equals.

Edge cases: rows whose vector is null or holds a null or non-finite component are dropped, and an empty vector is one of zeros; the smallest ids are taken with nulls
last, equal ids by their vectors; fewer rows than entries give shorter codebooks; vectors shorter than the longest, and runs of unequal length, are filled up
with zeros; components saturate where the sum of squares over a vector could pass a long (2**27 after scaling at 64 components);
repeated rows are coded each for itself; null labels are one label; no rows give no rows.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tidy

CELLS = 1 << 18  # (vector, entry) pairs looked at in one go


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, by partial distances."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    step = max(1, CELLS // len(book))
    for first in range(0, len(x), step):
        v = x[first : first + step]
        n = len(v)
        d = (v[:, order[0], None] - book[None, :, order[0]]) ** 2
        lead = d.argmin(axis=1)
        bound = ((v - book[lead]) ** 2).sum(axis=1)
        row, entry = np.nonzero(d <= bound[:, None])  # ascending by row, then entry; each row keeps its leader
        d = d[row, entry]
        for c in order[1:]:
            d += (v[row, c] - book[entry, c]) ** 2
            at = np.searchsorted(row, np.arange(n))
            least = np.minimum.reduceat(d, at)
            leads = np.flatnonzero(d == least[row])
            lead = entry[leads[np.searchsorted(row[leads], np.arange(n))]]
            bound = np.minimum(bound, ((v - book[lead]) ** 2).sum(axis=1))
            keep = d <= bound[row]
            row, entry, d = row[keep], entry[keep], d[keep]
        least = np.minimum.reduceat(d, np.searchsorted(row, np.arange(n)))
        best = np.flatnonzero(d == least[row])
        best = best[np.searchsorted(row[best], np.arange(n))]
        index[first : first + n], error[first : first + n] = entry[best], d[best]
    return index, error


@dataclass
class Books:
    """(parts, entries, width) integers; all runs have as many entries."""

    entries: np.ndarray

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) indexes and distances of (rows, parts * width) vectors."""
        parts, _, width = self.entries.shape
        got = [nearest(x[:, p * width : (p + 1) * width], self.entries[p]) for p in range(parts)]
        return np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def integers(rows: DataFrame, id_col: str, vec_col: str, scale: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """id, v (array of double, whole numbers), further columns; rows without a sound vector are gone."""
    x = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"), *[F.col(f"`{c}`").alias(c) for c in extra]).where("x IS NOT NULL")
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return x.where(~F.exists("x", odd)).select("id", F.transform("x", lambda e: e * float(scale)).alias("v"), *extra)


def matrix(column: pa.Array, width: int, most: int) -> np.ndarray:
    """Lists of doubles as floored, saturated integers, filled up with zeros."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), width), np.int64)
    held = np.floor(np.clip(values[offsets[0] : offsets[-1]], -most, most)).astype(np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = held
    return out


def fit(vectors: DataFrame, *, parts: int, entries: int, rounds: int) -> tuple[Books | None, int, int]:
    """(codebooks, width of a padded vector, bound of a component) of ``integers``' rows; None without rows."""
    longest = vectors.agg(F.max(F.size("v")).alias("n")).first().n
    if longest is None:
        return None, 0, 0
    wide = max(1, -(-longest // parts))
    width, most = parts * wide, math.isqrt((1 << 62) // (parts * wide)) // 2
    seed = vectors.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()  # the codebooks' size
    start = matrix(pa.array([list(r.v) for r in seed], pa.list_(pa.float64())), width, most)
    books = Books(np.ascontiguousarray(start.reshape(len(seed), parts, wide).transpose(1, 0, 2)))
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: Books = books) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(books.entries.shape, np.int64), np.zeros(books.entries.shape[:2], np.int64)
            for b in batches:
                x = matrix(b.column(0), width, most)
                if len(x):
                    index, _ = books.assign(x)
                    for p in range(parts):
                        np.add.at(total[p], index[:, p], x[:, p * wide : (p + 1) * wide])
                        n[p] += np.bincount(index[:, p], minlength=n.shape[1])
            used = np.flatnonzero(np.repeat(n.reshape(-1), wide))
            yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total.reshape(-1)[used], pa.int64()), pa.array(np.repeat(n.reshape(-1), wide)[used], pa.int64())], ["slot", "total", "n"])
            tidy()

        added = vectors.select("v").mapInArrow(sums, "slot long, total long, n long").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        moved = books.entries.copy().reshape(-1)
        for r in added.collect():  # a row for each component of the codebooks at most
            moved[r.slot] = r.total // r.n
        books = Books(moved.reshape(books.entries.shape))
    return books, width, most


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, Books | None]:
    """(id, label, code, error, label_error), and the codebooks; two hex digits stand for an index, so ``entries`` is at most 256."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256")
    vectors = integers(rows, id_col, vec_col, scale)
    books, width, most = fit(vectors, parts=parts, entries=entries, rounds=rounds)
    (label,) = [f.dataType.simpleString() for f in rows.schema if f.name == label_col]
    if books is None:
        return rows.sparkSession.createDataFrame([], f"id long, label {label}, code string, error long, label_error long"), None

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), width, most)
            index, error = books.assign(x) if len(x) else (np.zeros((0, parts), np.int64), np.zeros((0, parts), np.int64))
            code = [r.tobytes().hex() for r in index.astype(np.uint8)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(code, pa.string()), pa.array(error.sum(axis=1), pa.int64())], ["id", "label", "code", "error"])
        tidy()

    labelled = integers(rows, id_col, vec_col, scale, (label_col,)).select("id", "v", F.col(f"`{label_col}`").alias("label"))
    out = materialize(labelled.mapInArrow(coded, f"id long, label {label}, code string, error long"), "vector-codes")
    per_label = out.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    per_label = per_label.select("of", F.least(F.col("sum"), F.lit((1 << 63) - 1)).cast("long").alias("label_error"))
    return out.join(per_label, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _round_sql(before: str, after: str) -> str:
    return f"""
a_{after} AS (
  SELECT row, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist
  FROM (SELECT p.row, p.part, c.entry, list_sum(list_transform(list_zip(p.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM p JOIN {before} c USING (part))
  GROUP BY row, part),
m_{after} AS (
  SELECT a.part, a.entry, g.i, sum(p.w[g.i])::BIGINT AS s, count(*) AS n FROM a_{after} a JOIN p USING (row, part), (SELECT unnest(range(1, 5)) AS i) g GROUP BY ALL),
n_{after} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM m_{after} GROUP BY part, entry),
{after} AS (SELECT c.part, c.entry, coalesce(n.w, c.w) AS w FROM {before} c LEFT JOIN n_{after} n USING (part, entry))"""


#: For vectors of 64 components.
OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT row, part, e[4 * part + 1 : 4 * part + 4] AS w FROM v, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, row - 1 AS entry, w FROM p WHERE row <= 64),{_round_sql("c0", "c1")},{_round_sql("c1", "c2")},
f AS (
  SELECT row, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist
  FROM (SELECT p.row, p.part, c.entry, list_sum(list_transform(list_zip(p.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM p JOIN c2 c USING (part))
  GROUP BY row, part),
r AS (SELECT row, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM f GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM r JOIN v USING (row)
"""
