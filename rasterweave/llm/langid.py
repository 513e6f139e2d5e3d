"""Language identification with a byte convolutional network, trained and run in numpy.

Filters of several widths slide over the bytes (A-Z lower-cased) of fixed-length windows; each filter's
maximum over the window, rectified, feeds a softmax over the languages.  A document is cut into
windows that overlap by the widest filter less one, so the whole text is read and no n-gram is lost; its
score is the softmax of the windows' mean log-probabilities.

Training reads text and lang only: at most ``train_docs`` different texts a language (chosen by a hash of the
text, so no id has a say) with ``train_windows`` windows each, from anywhere in the text.  That bound does
not grow with the data; prediction covers all rows.  For speed, prediction adds rows of two tables
indexed by byte pairs, which hold the sums of the filters' weights.

Edge cases: texts that are null or have no letter (Unicode) are ``und`` with score 0; without any training row
all are ``und``; short texts are padded with spaces; ties go to the first language in code point order;
repeated rows are judged each; other columns are passed through only by ``identify``'s ``keep``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, each_text, private, table, texts, tidy
from .wordhash import LOWER

UND = "und"
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
WIDEST = max(WIDTHS)
STRIDE, PLACES = WINDOW - WIDEST + 1, WINDOW - WIDEST + 1
GROUP = 1024  # windows scored in one go
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, overlapping by the widest filter less one."""
    n = max(1, -(-max(1, len(raw) - (WIDEST - 1)) // STRIDE))
    room = np.full((n - 1) * STRIDE + WINDOW, 0x20, np.uint8)
    room[: len(raw)] = LOWER[np.frombuffer(raw, np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(room, WINDOW)[::STRIDE]


class Network:
    """Byte filters, max pooling, softmax."""

    def __init__(self, labels: Sequence[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = list(labels)
        self.p = {f"k{w}": rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.p["b"] = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.p["w"] = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, of: Sequence[np.ndarray], steps: int = 900, batch: int = 64, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        rows, filters = np.arange(batch)[:, None], np.arange(FILTERS)
        for step in range(1, steps + 1):
            pick = np.array([of[k][int(u * len(of[k]))] for k, u in zip(rng.integers(0, len(of), batch).tolist(), rng.random(batch).tolist(), strict=True)])
            a, t = x[pick].astype(np.intp), y[pick]
            peaks, where = [], []
            for w in WIDTHS:
                out = sum(self.p[f"k{w}"][j][a[:, j : j + PLACES]] for j in range(w))
                at = out.argmax(1)
                where.append(at)
                peaks.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0])
            pre = np.concatenate(peaks, 1) + self.p["b"]
            h = np.maximum(pre, 0)
            z = h @ self.p["w"] + self.p["c"]
            e = np.exp(z - z.max(1, keepdims=True))
            d = e / e.sum(1, keepdims=True)
            d[np.arange(batch), t] -= 1
            d /= batch
            g = {"w": h.T @ d + 1e-4 * self.p["w"], "c": d.sum(0)}
            dh = (d @ self.p["w"].T) * (pre > 0)
            g["b"] = dh.sum(0)
            for i, w in enumerate(WIDTHS):
                gk, part = np.zeros_like(self.p[f"k{w}"]), dh[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    np.add.at(gk[j], (a[rows, where[i] + j], np.broadcast_to(filters, part.shape)), part)
                g[f"k{w}"] = gk
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                self.p[k] -= rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters' sums by the first two bytes, and by the two after."""
        k, pairs = self.p, np.arange(1 << 16)
        hi, lo = pairs >> 8, pairs & 255
        one = np.concatenate([k[f"k{w}"][0][hi] + k[f"k{w}"][1][lo] for w in WIDTHS], 1)
        zero = np.zeros((1 << 16, FILTERS), np.float32)
        two = np.concatenate([(k[f"k{w}"][2][hi] if w > 2 else zero) + (k[f"k{w}"][3][lo] if w > 3 else zero) for w in WIDTHS], 1)
        return np.ascontiguousarray(one, np.float32), np.ascontiguousarray(two, np.float32)


class Scorer:
    def __init__(self, network: Network):
        self.n = network
        self.one, self.two = network.tables()

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each window."""
        out = np.empty((len(x), len(self.n.labels)))
        for i in range(0, len(x), GROUP):
            a = x[i : i + GROUP].astype(np.int32)
            pair = a[:, :-1] << 8 | a[:, 1:]
            s = self.one[pair[:, :PLACES]]
            s += self.two[pair[:, 2 : PLACES + 2]]
            z = np.maximum(s.max(1) + self.n.p["b"], 0) @ self.n.p["w"] + self.n.p["c"]
            z = z.astype(np.float64)
            z -= z.max(1, keepdims=True)
            out[i : i + GROUP] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def predict(self, some: Iterable[bytes | None], n: int) -> tuple[list[str], list[float]]:
        lang, score = [UND] * n, [0.0] * n
        at, groups, held = [], [], 0

        def flush() -> None:
            nonlocal held
            if at:
                logs = self.log_probabilities(np.concatenate(groups))
                ends = np.cumsum([len(g) for g in groups])
                for no, a, z in zip(at, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    mean = logs[a:z].mean(0)
                    p = np.exp(mean - mean.max())
                    p /= p.sum()
                    best = int(p.argmax())
                    lang[no], score[no] = self.n.labels[best], float(p[best])
            at.clear()
            groups.clear()
            held = 0

        for no, raw in enumerate(some):
            if raw and self.n.labels and has_letter(raw.decode()):
                w = windows(raw)
                at.append(no)
                groups.append(w)
                held += len(w)
                if held >= GROUP * 8:
                    flush()
        flush()
        return lang, score


@lru_cache(2)
def _scorer(model: bytes) -> Scorer:
    import pickle

    return Scorer(pickle.loads(model))


def drawn(rows: DataFrame, group: str, most: dict, seed: int) -> DataFrame:
    """At most most[g] rows (text, group) of each group g, with different texts, by a hash of the text.

    A hash picks somewhat more texts than are wanted, by a count of different texts; copies of one text count once, and a last rank by
    hash cuts what is too many, over the few that were picked.
    """
    h = F.xxhash64(F.lit(seed), F.col("text"))
    counts = {r[0]: r[1] for r in rows.groupBy(group).agg(F.approx_count_distinct(h, 0.02)).collect()}  # one row for each key of ``most``
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * most[k] / max(n, 1)))])
    some = rows.select(F.col(group), "text", h.alias("_h")).where(F.pmod(F.col("_h"), F.lit(1 << 20)) / float(1 << 20) < share[F.col(group)])
    one = some.groupBy(group, "_h").agg(F.min("text").alias("text"))
    limit = F.create_map(*[F.lit(x) for k in counts for x in (k, most[k])])
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_h"))
    return one.withColumn("_rank", rank).where(F.col("_rank") <= limit[F.col(group)]).select(group, "text")


def fit(labelled: DataFrame, *, train_docs: int = 1500, train_windows: int = 6, max_languages: int = 512, max_windows: int = 120_000, seed: int = 3) -> Network:
    """Train on rows (text, lang) with both present.

    At most ``train_docs`` different texts a language and ``train_windows`` windows of each reach the driver, and at most
    ``max_windows`` windows (of WINDOW bytes, 30 MB) in all: with many languages, each has fewer texts.
    """
    labelled = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    names = [r.lang for r in labelled.select("lang").distinct().limit(max_languages + 1).collect()]
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not names:
        return Network([])
    each = max(1, min(train_docs, max_windows // (train_windows * len(names))))
    chosen = drawn(labelled, "lang", dict.fromkeys(names, each), seed).select("text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_w, out_l = [], []
            for raw, lang in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                if raw and has_letter(raw.decode()):
                    w = windows(raw)
                    rng = np.random.default_rng([seed, len(raw), *raw[:8]])
                    out_w += [x.tobytes() for x in w[np.sort(rng.permutation(len(w))[:train_windows])]]
                    out_l += [lang] * min(len(w), train_windows)
            yield pa.RecordBatch.from_arrays([pa.array(out_w, pa.binary()), pa.array(out_l, pa.string())], names=["w", "lang"])

    got = sorted((r.lang.encode(), bytes(r.w)) for r in chosen.mapInArrow(cut, "w binary, lang string").collect())
    labels = sorted({k for k, _ in got})
    net = Network([k.decode() for k in labels])
    if len(labels) > 1:
        x, y = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, WINDOW), np.array([labels.index(k) for k, _ in got])
        # languages alike often, however many rows they have
        of = [np.flatnonzero(y == i) for i in range(len(labels))]
        net.train(x, y, of)
    return net


def _told(model: bytes, text: Column) -> Column:
    """A struct of lang and score; only the texts go to Python."""

    @F.arrow_udf("lang string, score double")
    def tell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _scorer(model)
        for b in batches:
            lang, score = scorer.predict(each_text(b), len(b))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])
        tidy()

    return tell.asNondeterministic()(text)  # else a filter on the result would run it twice


def identify(documents: DataFrame, network: Network, keep: Sequence[str] = ("doc_id",), lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``keep``'s columns, then the predicted language and its score, named ``lang`` and ``score``."""
    import pickle

    (told,) = private(documents.columns, "told")
    out = documents.withColumn(told, _told(pickle.dumps(network), F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col(f"{told}.lang").alias(lang), F.col(f"{told}.score").alias(score))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(bounded(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    out = identify(docs, net)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
