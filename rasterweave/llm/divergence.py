"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

Sketch.  Each task counts, for every term of a language, the documents that hold it, in a count-min sketch whose counters stop at
``min_docs``.  Sums of stopped counters stop alike, so the merged sketch still never underestimates below that bound.  A sketch has
``width`` times ``depth`` counters of a byte whatever the input; it is merged in segments, each by a task that streams them, and sent to all
tasks.  A wider one lets fewer rare terms pass on a larger corpus; the results do not depend on it.

Counting.  In a second pass a term is shuffled only if its estimate reaches ``min_docs``; tasks add up what they read before that.
Survivors are counted exactly, and those in enough documents are kept.

Pairs.  A term that neither source has costs both their least probability, so only the terms that a source has are gone through:
each source's distinct probabilities are laid in one order with the other sources' least ones (running sums give all distances to
those), and terms that two sources share are corrected by a join on the term.

All probabilities are integers in billionths, by exact division; nothing is rounded.

Edge cases: null text, language and source read as empty; rows of one id are documents of their own; a group without terms has the
least probability everywhere; a language without kept terms has pairs of value 0 and no terms; a single source has no pairs; texts of any length are read
in pieces cut between terms; no rows give no rows.  Only text, lang and source are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import each_text, materialize, table, tidy
from .wordhash import hash_words, mix

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NO_TERM = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
PIECE = 4 << 20  # bytes of a text gone through at once
SEGMENT = 1 << 15  # counters that are merged as one
HELD = 600_000  # different terms that a task holds before it passes them on
UNIT = 1_000_000_000


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about PIECE bytes, cut where no term is."""
    at = 0
    while len(text) - at > PIECE:
        cut = NO_TERM.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    for piece in pieces(text):
        yield TERM.findall(piece.lower())


class Sketch:
    """Count-min sketch with counters that stop at ``top``."""

    def __init__(self, width: int, depth: int, top: int):
        self.width, self.top = width, top
        self.counts = np.zeros((depth, width), np.min_scalar_type(top))

    def keys(self, lang: str, terms: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b" ".join(terms), np.uint8)
        own = int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return mix(hash_words(np.array([0, len(data)]), data)[0] ^ np.uint64(own))

    def _at(self, keys: np.ndarray, row: int) -> np.ndarray:
        return (mix(keys + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(self.width)).astype(np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        for row, held in enumerate(self.counts):
            where, inverse = np.unique(self._at(keys, row), return_inverse=True)
            held[where] = np.minimum(self.top, held[where] + np.bincount(inverse, weights=counts)).astype(held.dtype)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        return np.min([held[self._at(keys, row)] for row, held in enumerate(self.counts)], axis=0)

    def segments(self) -> Iterator[tuple[int, bytes]]:
        flat = self.counts.reshape(-1)
        for no, first in enumerate(range(0, len(flat), SEGMENT)):
            if flat[first : first + SEGMENT].any():
                yield no, zlib.compress(flat[first : first + SEGMENT].tobytes(), 1)

    def merge(self, no: int, packed: bytes) -> None:
        flat = self.counts.reshape(-1)[no * SEGMENT : (no + 1) * SEGMENT]
        flat[:] = np.minimum(self.top, flat.astype(np.int64) + np.frombuffer(zlib.decompress(packed), flat.dtype)).astype(flat.dtype)


def document_sketch(rows: DataFrame, *, width: int, depth: int, top: int) -> Sketch:
    """The merged sketch of (lang, text) rows: documents by language and term."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, held = Sketch(width, depth, top), defaultdict(Counter), 0

        def settle() -> None:
            for lang, docs in seen.items():
                if docs:
                    sketch.add(sketch.keys(lang, list(docs)), np.fromiter(docs.values(), np.int64, len(docs)))
            seen.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), each_text(b.column(1)), strict=True):
                words = set()
                for some in terms_of(text):
                    words.update(some)
                docs = seen[lang]
                before = len(docs)
                docs.update(words)
                held += len(docs) - before + 1
                if held > HELD:
                    settle()
                    held = 0
        settle()
        tidy()
        got = list(sketch.segments())
        yield pa.record_batch([pa.array([k for k, _ in got], pa.int32()), pa.array([v for _, v in got], pa.binary())], ["segment", "packed"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        kind = np.min_scalar_type(top)
        for b in batches:
            for no, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(packed), kind)
                sums[no] = np.minimum(top, sums[no].astype(np.int64) + got).astype(kind) if no in sums else got
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["segment", "packed"])

    shape = "segment int, packed binary"
    out = Sketch(width, depth, top)
    for r in rows.select("lang", "text").mapInArrow(local, shape).repartition("segment").mapInArrow(merged, shape).collect():  # width * depth bytes at most
        out.merge(r.segment, r.packed)
    return out


def _counted(rows: DataFrame, sketch: Sketch) -> DataFrame:
    """lang, source, term, docs, n of the terms that may be in enough documents."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held = shared.value, 0
        docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
        times: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), had in docs.items():
                words = list(had)
                words = [words[i] for i in np.flatnonzero(sketch.estimate(sketch.keys(lang, words)) >= sketch.top)] if words else []
                if words:
                    each = times[lang, source]
                    n = len(words)
                    numbers = [pa.array([c[w] for w in words], pa.int64()) for c in (had, each)]
                    yield pa.record_batch([pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array(words, pa.binary()).view(pa.string()), *numbers], ["lang", "source", "term", "docs", "n"])
            docs.clear()
            times.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), each_text(b.column(2)), strict=True):
                had, each, words = docs[lang, source], times[lang, source], set()
                before = len(had)
                for some in terms_of(text):
                    each.update(some)
                    words.update(some)
                had.update(words)
                held += len(had) - before + 1
                if held > HELD:
                    yield from passed()
                    held = 0
        yield from passed()
        tidy()

    parts = rows.select("lang", "source", "text").mapInArrow(local, "lang string, source string, term string, docs long, n long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _share(count: Column, total: Column, terms: Column, plus: int) -> Column:
    """1 + floor(UNIT * (count + plus) / (total + plus * terms)); 0 where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    top, below = wide(count + plus) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + F.lit(plus) * terms)
    return F.when(terms > 0, F.call_function("div", top, below) + 1).otherwise(0).cast("long")


def divergence(documents: DataFrame, *, min_docs: int = 30, plus: int = 5, top: int = 50, width: int = 1 << 21, depth: int = 3) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    rows = documents.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    sketch = document_sketch(rows, width=width, depth=depth, top=min_docs)
    counted = materialize(_counted(rows, sketch), "divergence-counts")
    terms = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("q_n")).where(F.col("docs") >= min_docs).drop("docs")
    terms = materialize(terms, "divergence-terms")
    own = materialize(counted.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "divergence-kept")

    per_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("q_n").alias("q_total"))
    per_group = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("has"))
    groups = rows.select("lang", "source").distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0)
    groups = materialize(groups.withColumn("least", _share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), plus)), "divergence-groups")
    p = own.join(groups, ["lang", "source"])
    p = p.select("lang", "source", "term", "least", _share(F.col("n"), F.col("total"), F.col("terms"), plus).alias("p"), _share(F.col("q_n"), F.col("q_total"), F.col("terms"), plus).alias("q"))
    p = materialize(p, "divergence-shares")

    # each source's probabilities and the others' least ones in one order
    side = lambda df, no: df.select("lang", *[F.col(c).alias(c + no) for c in df.columns if c != "lang"])
    met = side(groups, "1").join(side(groups, "2").withColumnRenamed("terms2", "terms"), "lang").where("source1 <> source2")
    marks = met.select("lang", F.col("source1").alias("source"), F.col("least2").alias("p"), F.lit(0).cast("long").alias("m"), F.struct("source2", F.when(F.col("source1") < F.col("source2"), (F.col("terms") - F.col("has1") - F.col("has2")) * F.abs(F.col("least1") - F.col("least2"))).otherwise(0).alias("neither")).alias("mark"))
    steps = p.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    line = marks.unionByName(steps, allowMissingColumns=True)
    all_of = Window.partitionBy("lang", "source")
    upto = all_of.orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    mp = F.col("m") * F.col("p")
    below, mass = F.sum("m").over(upto), F.sum(mp).over(upto)
    away = F.sum(mp).over(all_of) - F.sum("m").over(all_of) * F.col("p") + 2 * (below * F.col("p") - mass)  # sum of |p of a term - the other's least|
    to_least = line.withColumn("away", away).where("mark IS NOT NULL")
    other = F.col("mark.source2")
    to_least = to_least.select("lang", F.least("source", other).alias("a"), F.greatest("source", other).alias("b"), (F.col("away") + F.col("mark.neither")).alias("v"))

    both = side(p.drop("q"), "1").withColumnRenamed("term1", "term").join(side(p.drop("q"), "2").withColumnRenamed("term2", "term"), ["lang", "term"]).where("source1 < source2")
    far = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = both.groupBy("lang", F.col("source1").alias("a"), F.col("source2").alias("b")).agg(F.sum(far("p1", "p2") - far("p1", "least2") - far("p2", "least1") + far("least1", "least2")).alias("v"))
    pair = to_least.union(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    pair = pair.select("lang", "value", F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])).alias("way"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pair.select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(ranked))
    term = p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pair.union(term.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS q_n FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(q_n)::HUGEINT AS q_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (t.total + 5 * l.v) AS p, 1 + (1000000000 * (kept.q_n + 5)) // (l.q_total + 5 * l.v) AS q
  FROM t JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
