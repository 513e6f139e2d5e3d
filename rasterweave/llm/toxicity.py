"""Toxicity with a factorization machine over hashed terms.

A text's terms are the hashes of its distinct words (A-Z lower-cased, ASCII punctuation apart) and of their
first ``PREFIX`` bytes, which catch inflected forms.  The machine adds to the linear weights the inner products
of all pairs of terms' factors, so two terms together can weigh what neither does alone:
score = sigmoid(b + sum w_i + ((sum v_i)^2 - sum v_i^2) / 2).

Training reads text and label only: at most ``train_docs`` different labelled texts of each class (drawn by a
hash of the text; loss weights restore the classes' shares), of these the terms that MIN_DOCS texts have, the MAX_TERMS most frequent
of them, and at most ``train_terms`` of a text (by hash).  The vocabulary is counted on the executors.  Of these terms, those take part
that lean to a label, and the FREQUENT most frequent, which may weigh in pairs only: with some thousand texts, factors of all terms learn noise
(held-out AUC 0.83 against 0.98 on 10,000 documents).  Those bounds do not grow with the data; scoring covers all rows and whole texts.

Edge cases: null and empty texts score by the intercept; texts without known terms too; null labels are no
labels; an id labelled more than once takes its highest label; without rows of both classes the score is
the share of label 1 (0 without any); repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialize, table, tidy, utf8
from .langid import drawn, fold
from .wordhash import PUNCT, hash_words, mix

PREFIX, FACTORS = (4, 6), 4
#: Terms that take part: in MIN_DOCS training texts at least, among the MAX_TERMS most frequent, and with a chi-squared to the label over
#: LEAN (one neutral term in a thousand has that) or among the FREQUENT most frequent.
MIN_DOCS, LEAN, MAX_TERMS, FREQUENT = 4, 10.8, 50_000, 300
GROUP = 1 << 20  # bytes of text whose terms are made in one go


def terms(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 32-bit terms of all texts one after another, for each text the number before it)."""
    words, counts = hash_words(offsets, data, cut=PUNCT, lower=True, prefix=PREFIX)
    text = np.repeat(np.arange(len(counts) - 1, dtype=np.uint64), np.diff(counts))
    pair = np.concatenate([text << np.uint64(32) | (h >> np.uint64(32)) for h in words])
    pair = np.unique(pair)
    return pair.astype(np.uint32), np.searchsorted(pair >> np.uint64(32), np.arange(len(counts), dtype=np.uint64))


class Machine:
    def __init__(self, vocabulary: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.vocabulary, self.bias, self.w, self.v = vocabulary, bias, w, v
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[vocabulary & np.uint32((1 << 20) - 1)] = True

    def places(self, found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known terms' places in the vocabulary, the text of each)."""
        at = np.flatnonzero(self.maybe[found & np.uint32((1 << 20) - 1)])
        p = np.searchsorted(self.vocabulary, found[at])
        p[p == len(self.vocabulary)] = 0
        ok = self.vocabulary[p] == found[at] if len(self.vocabulary) else np.zeros(len(p), bool)
        return p[ok], np.searchsorted(counts, at[ok], "right") - 1

    def scores(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        p, text = self.places(found, counts)
        n = len(counts) - 1
        z = self.bias + np.bincount(text, self.w[p], n)
        for f in range(self.v.shape[1]):
            x = self.v[p, f]
            z += 0.5 * (np.bincount(text, x, n) ** 2 - np.bincount(text, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(found: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray, *, epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 2e-4, seed: int = 9) -> Machine:
    """AdaGrad over shuffled batches."""
    share = float(np.average(y, weights=weight)) if len(y) else 0.0
    bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    values, inverse, docs = np.unique(found, return_inverse=True, return_counts=True)
    ones = np.bincount(inverse, np.repeat(y, np.diff(counts)), len(values))
    total, positive = len(y), float(y.sum())
    chi = (ones * total - docs * positive) ** 2 * total / np.maximum(docs * (total - docs) * positive * (total - positive), 1e-9)
    often = np.argsort(-docs, kind="stable")[:FREQUENT]
    values = values[np.union1d(often, np.flatnonzero(chi >= LEAN))]
    rng = np.random.default_rng(seed)
    m = Machine(values, bias, np.zeros(len(values)), rng.normal(0, 0.01, (len(values), FACTORS)))
    if not len(values) or share in (0.0, 1.0):
        return Machine(values[:0], bias, m.w[:0], m.v[:0])
    p, text = m.places(found, counts)
    begin = np.searchsorted(text, np.arange(len(y) + 1))
    gw, gv, gb = np.full(len(values), 1e-2), np.full((len(values), FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            at = np.concatenate([p[begin[r] : begin[r + 1]] for r in rows])
            own = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows])
            v = m.v[at]
            sums = np.stack([np.bincount(own, v[:, f], len(rows)) for f in range(FACTORS)], 1)
            z = m.bias + np.bincount(own, m.w[at], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(own, (v * v).sum(1), len(rows)))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows]
            each = d[own]
            ids, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, each) + decay * m.w[ids]
            dv = np.stack([np.bincount(inverse, each * (sums[own, f] - v[:, f])) for f in range(FACTORS)], 1) + decay * m.v[ids]
            gw[ids] += dw**2
            m.w[ids] -= rate * dw / np.sqrt(gw[ids])
            gv[ids] += dv**2
            m.v[ids] -= 0.2 * rate * dv / np.sqrt(gv[ids])
            gb += d.sum() ** 2
            m.bias -= rate * d.sum() / gb**0.5
    return m


def fit(documents: DataFrame, labels: DataFrame, *, train_docs: int = 4000, train_terms: int = 4096, seed: int = 8) -> Machine:
    """Train on documents (doc_id, text) with labels (doc_id, toxic): at most train_docs texts of each class and train_terms terms of each
    (4 bytes a term, so 131 MB at most, reach the driver)."""
    one = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    nothing = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0), np.zeros(0)
    counts = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    if not counts:
        return train(*nothing)
    # ids first, by a hash: some three times as many as wanted, for those that are copies or have no text
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 3 * train_docs / n))])
    some = one.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20) < share[F.col("label")])
    met = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id").select("text", "label")  # two numbers an id
    met = materialize(drawn(met, "label", dict.fromkeys(counts, train_docs), seed), "toxicity-drawn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, before = terms(*utf8(b.column(1)))
            raw = [found[a:z].tobytes() for a, z in zip(before[:-1], before[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), b.column(0).cast(pa.int32())], names=["terms", "label"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, n = np.unique(terms(*utf8(b.column(1)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    often = met.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS)
    known = np.sort(often.orderBy(F.desc("n"), "term").limit(MAX_TERMS).toArrow().column(0).to_numpy().astype(np.uint32))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            short = []
            for raw in b.column(0).to_pylist():
                t = np.frombuffer(raw, np.uint32)
                at = np.searchsorted(known, t)
                t = t[known[np.minimum(at, len(known) - 1)] == t] if len(known) else t[:0]
                short.append(np.sort(t[np.argsort(mix(t.astype(np.uint64)))[:train_terms]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.binary()), b.column(1)], names=b.schema.names)

    got = sorted((r.label, bytes(r.terms)) for r in met.mapInArrow(chosen, "terms binary, label int").collect())
    if not got:
        return train(*nothing)
    y = np.array([k for k, _ in got], float)
    found = [np.frombuffer(t, np.uint32) for _, t in got]
    drawn_of = np.bincount(y.astype(int), minlength=2)
    weight = np.array([counts[k] / drawn_of[k] for k, _ in got])
    return train(np.concatenate(found), np.cumsum([0, *map(len, found)]), y, weight / weight.mean())


@lru_cache(2)
def _machine(model: bytes) -> Machine:
    import pickle

    return pickle.loads(model)


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    import pickle

    model = pickle.dumps(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _machine(model)
        for b in batches:
            offsets, data = utf8(b.column(1))
            out, i = [], 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
                out.append(m.scores(*terms(offsets[i : j + 1], data)))
                i = j
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=["doc_id", "score"])
        tidy()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(bounded(spark), sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    machine = fit(docs, labels)
    out = score(docs, machine)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
