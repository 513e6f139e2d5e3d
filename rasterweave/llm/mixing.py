"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets.  Sources in code point order (null last) weigh ``weights`` in turn.  A pool of ``share``
times all words is dealt by weight; a source's target stops at ``repeat`` times its words and the
excess is dealt again by weight among the others until no target is above its stop.

Quotas.  The mix is made of equal blocks of ``block`` words.  Sources get whole blocks by highest
quotients v/(2s+1) (Sainte-Lague, with the stop as upper limit), and each source's blocks go to its
shards in the same way, by shard size.  A shard is a hash class of a source's documents, so a source
with a third of the rows has many shards.  The highest quotients are found by bisection on the
divisor, not seat by seat, so the cost does not grow with the number of blocks.

Selection.  In a shard, documents lie in a seeded order on a line of words cut into blocks.  A line longer than ``shard_words`` is
laid out in parts, hash classes again, whose beginnings are sums over the parts before, so no task holds more than about that.  A quota
of q out of b blocks takes the whole line q // b times, then q % b blocks in a row (cyclic) from a
seeded one.  What a document gives is the overlap of its interval with the blocks taken.

Edge cases: null and empty texts have size 0 and give 0 words; no rows give no rows; a null source is a
source of its own; repeated rows are documents of their own, in one order or the other; rows of one id
(or without any) are dealt by their texts as well; further columns are not read by ``mix`` and travel in a struct in ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import cycle

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, materialize, table

WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 1_000_000  # rows that the driver may hold


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, repeat: float) -> list[float]:
    """Water-filling: each source's target, in the order given."""
    pool, out, free = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free and pool > 0:
        unit = pool / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] >= repeat * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(repeat * sizes[i])
            pool -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def sainte_lague(votes: Sequence[float], seats: int, limits: Sequence[int]) -> list[int]:
    """Seats by highest quotients v/(2s+1), at most limits[i] each; ties go to the earlier."""
    seats = min(seats, sum(limits))
    given = lambda d: [min(m, int(v / d + 0.5)) if v > 0 else 0 for v, m in zip(votes, limits, strict=True)]
    high = max(votes, default=0) * 2 + 1.0
    if seats <= 0 or max(votes, default=0) <= 0:
        return [0] * len(votes)
    low = high
    while sum(given(low)) < seats and low > 1e-12:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(given(mid)) >= seats:
            low = mid
        else:
            high = mid
    out = given(high)  # fewer than seats; the rest by their next quotient
    rest = seats - sum(out)
    order = sorted((i for i in range(len(votes)) if out[i] < limits[i]), key=lambda i: (-votes[i] / (2 * out[i] + 1), i))
    while rest > 0 and order:
        for i in order[:rest]:
            out[i] += 1
        rest = seats - sum(out)
        order = sorted((i for i in range(len(votes)) if out[i] < limits[i]), key=lambda i: (-votes[i] / (2 * out[i] + 1), i))
    return out


def _taken(
    documents: DataFrame,
    row: Column | None = None,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    repeat: int = 2,
    block: int = 32,
    seed: int = 17,
    max_shards: int = 4096,
    shard_words: int = 1 << 18,
) -> DataFrame:
    """doc_id, source, size, source_size, target, quota_blocks and shard of the document's shard, taken, and ``row`` if given."""
    spark = documents.sparkSession
    own = [F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("spread")]
    numbers = materialize(documents.select(*own), "mix-sizes")  # four numbers a document, read below instead of the texts
    per_source = numbers.groupBy("source").agg(F.sum("size").alias("source_size")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per_source.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    sizes, w = [r.source_size for r in per_source], [x for x, _ in zip(cycle(weights), per_source, strict=False)]
    goal = targets(sizes, w, share, repeat)
    each = max(shard_words, -(-sum(sizes) // max_shards))
    shards = [max(1, -(-s // each)) for s in sizes]
    parts = [max(1, -(-s // (n * shard_words))) for s, n in zip(sizes, shards, strict=True)]
    plan = spark.createDataFrame([(i, r.source, r.source_size, goal[i], shards[i], parts[i]) for i, r in enumerate(per_source)], "source_no int, name string, source_size long, target double, shards long, parts long")
    plan_side = F.broadcast(plan)  # one row for each source, at most MAX_SOURCES

    def place(rows: DataFrame) -> DataFrame:
        deal = lambda what: F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("spread"), F.lit(what))
        met = rows.join(plan_side, F.col("source").eqNullSafe(F.col("name"))).drop("name")
        return met.withColumns({"order": deal("order"), "shard": F.pmod(deal("shard"), F.col("shards")).cast("int"), "part": F.pmod(deal("part"), F.col("parts"))}).drop("shards", "parts")

    spot = ["source_no", "shard", "part"]
    per_part = materialize(place(numbers).groupBy(*spot).agg(F.sum("size").alias("words")), "mix-parts")
    per_shard = per_part.groupBy("source_no", "shard").agg(F.sum("words").alias("words")).collect()  # at most max_shards + sources rows
    blocks = {(r.source_no, r.shard): (-(-r.words // block), r.words) for r in per_shard}
    by_source: dict[int, list[int]] = {}
    for no, shard in sorted(blocks):
        by_source.setdefault(no, []).append(shard)
    room = [sum(repeat * blocks[i, s][0] for s in by_source.get(i, ())) for i in range(len(per_source))]
    seats = sainte_lague(goal, round(sum(goal) / block), room)
    quotas = []
    for i in range(len(per_source)):
        ids = by_source.get(i, [])
        got = sainte_lague([float(blocks[i, s][1]) for s in ids], seats[i], [repeat * blocks[i, s][0] for s in ids])
        quotas += [(i, s, blocks[i, s][0], q) for s, q in zip(ids, got, strict=True)]
    quota = spark.createDataFrame(quotas, "source_no int, shard int, blocks long, quota_blocks long")
    # where each part of a shard's line begins; a shard has about 1 / max_shards of the parts
    ahead = Window.partitionBy("source_no", "shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_part.select(*spot, F.coalesce(F.sum("words").over(ahead), F.lit(0).cast("long")).alias("begin")).join(F.broadcast(quota), ["source_no", "shard"])
    line = Window.partitionBy(*spot).orderBy("order", "doc_id", "spread", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(line), F.lit(0).cast("long"))
    rows = numbers if row is None else documents.select(*own, row.alias("row"))
    out = place(rows).withColumn("at", inside).join(begins, spot).withColumn("at", F.col("at") + F.col("begin"))
    rest, first = F.col("quota_blocks") % F.col("blocks"), F.pmod(F.xxhash64(F.lit(seed), F.col("source_no"), F.col("shard"), F.lit("first")), F.col("blocks"))
    has = F.col("blocks") > 0
    out = out.withColumn("rest", F.when(has, rest).otherwise(0)).withColumn("first", F.when(has, first).otherwise(0))
    end = F.col("at") + F.col("size")

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(end, hi) - F.greatest(F.col("at"), lo))

    last = F.col("first") + F.col("rest")
    some = overlap(F.col("first") * block, F.least(last, F.col("blocks")) * block) + overlap(F.lit(0).cast("long"), F.greatest(F.lit(0), last - F.col("blocks")) * block)
    whole = F.when(has, F.floor(F.col("quota_blocks") / F.col("blocks"))).otherwise(0)
    taken = F.coalesce(whole * F.col("size") + some, F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", "quota_blocks", "shard", taken.alias("taken"), *([] if row is None else ["row"]))


def mix(documents: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, quota_blocks and shard of the document's shard, and taken (words that the mix takes)."""
    return _taken(documents, **options)


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix itself, with ``documents``' columns: a row for each whole time a document is taken, and one with its first
    words (joined by one space) where a block's edge cuts it; n_chars, if there, follows the text.

    Documents without words are never taken; rows with one id, with or without one text, are taken each for itself; the columns travel in
    one struct, so that any names will do.
    """
    names = documents.columns
    out = _taken(documents, F.struct(*[F.col(f"`{c}`") for c in names]), **options).where("taken > 0")
    times, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    # -1 stands for the whole text
    cuts = F.concat(F.array_repeat(F.lit(-1), times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    each = out.select("row", F.explode(cuts).alias("cut"))
    field = lambda c: F.col(f"row.`{c}`")
    first = F.array_join(F.slice(F.regexp_extract_all(field("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.col("cut"), F.lit(0))), " ")
    whole = F.col("cut") < 0
    put = {"text": F.when(whole, field("text")).otherwise(first)}
    if "n_chars" in names:
        put["n_chars"] = F.when(whole, field("n_chars")).otherwise(F.length(first).cast(documents.schema["n_chars"].dataType))
    return each.select(*[put.get(c, field(c)).alias(c) for c in names])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(bounded(spark), sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")
