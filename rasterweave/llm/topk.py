"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers floor(scale * x).  Candidates are packed into blocks; a block holds, for every
dimension, its rows in ascending order of that dimension.  A query reads each dimension's list from the
end its own sign prefers, in growing steps.  The bound is the sum of the best products still unread in
each dimension; reading stops when it cannot beat the k-th score found so far.  The k-th score found in
earlier blocks of the same task carries over, so later blocks stop sooner.  Each (query block,
candidate block) gives at most k rows a query; a last top-k over those, partly done before the shuffle,
gives the answer.

Memory is bounded by ``BLOCK`` rows and ``CELLS`` components of candidates and of queries.  The query set is stated (ids divisible by
``every``) and meets all rows in blocks; the query blocks are broadcast where they have at most QUERY_BYTES, else blocks are shuffled to
each other.

Edge cases: vectors that are null or hold a null or a non-finite component take no part, nor do rows without an id; of two vectors of different length, the
components that both have count, and an empty vector scores 0 with all; ties go to the smaller id; two rows of one id are distinct candidates and, if asked
for, distinct queries (each with its own ranks), and only the query's own row is left out; fewer than k candidates give fewer rows; no rows
give no rows.  Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

BLOCK = 4096
CELLS = 1 << 22  # components of a block, or one vector
QUERY_BYTES = 64 << 20
STEP = 32  # rows of each list read at first; then twice as many each time


class SortedLists:
    """Candidates of a block with one ascending list of rows for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        self.rows = self.ids if rows is None else rows[order]
        self.rank = np.argsort(self.x, axis=0, kind="stable")  # rows by dimension
        self.sorted = np.take_along_axis(self.x, self.rank, axis=0)

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows but ``own``, best first; scores under ``floor`` may be left out."""
        n, d = self.x.shape
        query = np.pad(query[:d], (0, max(0, d - len(query))))
        up = query >= 0
        seen = np.zeros(n, bool)
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STEP
        used = np.flatnonzero(query != 0)
        while depth < n:
            upto = min(n, depth + step)
            if len(used):
                rows = np.concatenate([self.rank[n - upto : n - depth, up & (query != 0)].ravel(), self.rank[depth:upto, ~up].ravel()])
                fresh = np.zeros(n, bool)
                fresh[rows] = True
                fresh &= ~seen
            else:
                fresh, upto = ~seen, n
            new = np.flatnonzero(fresh)
            seen |= fresh
            new = new[self.rows[new] != own]
            if len(new):
                s, i = np.concatenate([best_s, self.x[new] @ query]), np.concatenate([best_i, self.ids[new]])
                top = np.lexsort((i, -s))[:k]
                best_s, best_i = s[top], i[top]
            depth, step = upto, step * 2
            if depth < n:
                # no unread row can score above the bound; one equal to it may still win a tie by its id
                bound = int((np.where(up, self.sorted[n - 1 - depth], self.sorted[depth]) * query).sum())
                if (len(best_s) >= k and bound < best_s[-1]) or (floor is not None and bound < floor):
                    break
        return best_s, best_i


def _pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of rows, shorter vectors padded with zeros; a row's number is the task's and its place."""
    held: list[tuple[int, np.ndarray]] = []
    width = done = 0
    task = TaskContext.get().partitionId() << 40

    def out() -> pd.DataFrame:
        nonlocal width, done
        x = np.zeros((len(held), width), "<i8")
        for i, (_, v) in enumerate(held):
            x[i, : len(v)] = v
        made = pd.DataFrame({"ids": [np.array([k for k, _ in held], "<i8").tobytes()], "vectors": [x.tobytes()], "n": [len(held)], "first": [task + done]})
        done += len(held)
        held.clear()
        width = 0
        return made

    for f in frames:
        for k, v in zip(f["id"].tolist(), f["v"], strict=True):
            w = max(width, len(v))
            if held and (len(held) == BLOCK or (len(held) + 1) * w > CELLS):
                yield out()
                w = len(v)
            held.append((k, np.asarray(v, np.int64)))
            width = w
    if held:
        yield out()


def _opened(ids: bytes, vectors: bytes, n: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors, row numbers of a block."""
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(n, -1), first + np.arange(n)


def top_k(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 10, scale: int = 1024, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every`` against all rows."""
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    clean = clean.where(~F.exists("x", odd))
    clean = clean.select("id", F.transform("x", lambda e: F.floor(e * float(scale)).cast("long")).alias("v"))
    blocks = materialize(clean.mapInPandas(_pack, "ids binary, vectors binary, n int, first long"), "topk-blocks")

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                ids, x, row = _opened(r.ids, r.vectors, r.n, r.first)
                mine = np.flatnonzero(ids % every == 0)
                if len(mine):
                    yield pd.DataFrame({"q_ids": [ids[mine].tobytes()], "q_vectors": [x[mine].tobytes()], "q_rows": [row[mine].tobytes()], "q_n": [len(mine)]})

    queries = materialize(blocks.mapInPandas(asked, "q_ids binary, q_vectors binary, q_rows binary, q_n int"), "topk-queries")
    size = queries.agg(F.sum(F.length("q_vectors")).alias("b")).first().b or 0

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[int]] = {}  # of this task's queries: each one's k best scores so far
        last: tuple[int, SortedLists | None] = (-1, None)
        for f in frames:
            for r in f.itertuples(index=False):
                if last[0] != r.first or last[1] is None:
                    last = (r.first, SortedLists(*_opened(r.ids, r.vectors, r.n, r.first)))
                ids, own, x = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.q_rows, "<i8"), np.frombuffer(r.q_vectors, "<i8").reshape(r.q_n, -1)
                got = []
                for q, row, v in zip(ids.tolist(), own.tolist(), x, strict=True):
                    had = best.get(row, [])
                    s, i = last[1].search(v, row, k, had[-1] if len(had) >= k else None)
                    if len(had) >= k:
                        keep = s >= had[-1]
                        s, i = s[keep], i[keep]
                    if len(s):
                        got.append((np.full(len(s), q), np.full(len(s), row), i, s))
                        if len(best) > 4 * BLOCK:
                            best.clear()
                        best[row] = sorted([*had, *s.tolist()], reverse=True)[:k]
                if got:
                    yield pd.DataFrame({c: np.concatenate([g[j] for g in got]) for j, c in enumerate(("query_id", "query_row", "vec_id", "score"))})

    met = blocks.crossJoin(queries.hint("broadcast" if size <= QUERY_BYTES else "shuffle_replicate_nl")).mapInPandas(meet, "query_id long, query_row long, vec_id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
