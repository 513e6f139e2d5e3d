"""Normalisation, surprisal, ranks and regions of interest.

Everything here works on images (rows keyed by ``by`` columns) and on whole tables (``by`` empty).  Neither a table nor an image meets
in one task: a table's order statistics are found by counts of bins and then of the values in the wanted bins, its ranks by windows inside value
buckets plus the buckets' offsets, and those of images by ranges of (image, value) in the same way (``ordering``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import finite, group_quantiles, laid_out, statistic, value_counts
from .storage import few, materialize

EPS = 1e-12
FEW = 1_000_000  # different values, with two numbers each, that may be sent to all tasks


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def exact_quantiles(df: DataFrame, probs: dict[str, Sequence[float]], small: int = 5_000_000) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of finite values of whole columns.

    Beyond ``small`` rows values are counted by bin, and only those of the bins that hold wanted places one by one (``group_quantiles``): three
    passes of plain counts, however many quantiles are asked for.
    """
    cols = list(probs)
    keep = {c: F.when(finite(F.col(c)), F.col(c).cast("double")) for c in cols}
    n = df.agg(*[F.count(keep[c]).alias(c) for c in cols]).first().asDict()
    if max(n.values(), default=0) <= small:
        r = df.agg(*[F.percentile(keep[c], F.lit([float(p) for p in probs[c]])).alias(c) for c in cols]).first()
    else:
        r = group_quantiles(df, [], probs, True).first()
    return {c: list(r[c]) if r[c] is not None else [None] * len(probs[c]) for c in cols}


def scaled(c: Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    """(c - lo) / (hi - lo) in [0,1]; 0 where the range is empty."""
    if lo is None or hi is None:
        return F.lit(0.0)
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(hi <= lo + EPS, F.lit(0.0)).otherwise(clip01((c - lo) / (hi - lo)))


def robust01(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), lo: float = 1.0, hi: float = 99.0, suffix: str = "") -> DataFrame:
    """Columns scaled by their percentiles (1/99; 2/98 for measures), per image or over the table."""
    p = [lo / 100, hi / 100]
    if not by:
        q = exact_quantiles(df, dict.fromkeys(cols, p))
        return df.withColumns({c + suffix: scaled(F.col(c), *q[c]) for c in cols})
    df = materialize(df, "scaling")
    q = group_quantiles(df, by, dict.fromkeys(cols, p), True)
    # two plain numbers a column: code that takes arrays apart for many columns is too long to be compiled
    q = few(q.select(*by, *[F.col(c)[i].alias(f"{n}{c}") for c in cols for i, n in enumerate(("_lo_", "_hi_"))]), "scaling")
    out = df.join(q, list(by), "left").withColumns({c + suffix: scaled(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in cols})
    return out.drop(*[n + c for c in cols for n in ("_lo_", "_hi_")])


def buckets(df: DataFrame, value: str, n: int) -> Column:
    """A bucket number that rises with the value, from at most n approximate quantiles."""
    if n <= 1:
        return F.lit(0)
    got = df.agg(F.percentile_approx(F.when(finite(F.col(value)), F.col(value)), [i / n for i in range(1, n)], 1000).alias("q")).first().q
    cuts = sorted(set(got or []))
    return F.size(F.filter(F.lit([float(x) for x in cuts]), lambda c: c <= F.col(value))) if cuts else F.lit(0)


def running(df: DataFrame, value: str, amount: Column, n_buckets: int) -> tuple[DataFrame, Column]:
    """Sum of ``amount`` over smaller values of a whole table (rows have distinct values), as a column of the returned rows."""
    df = df.withColumn("_bucket", buckets(df, value, n_buckets)).withColumn("_amount", amount)
    w = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = sorted((r["_bucket"], r["_s"] or 0) for r in df.groupBy("_bucket").agg(F.sum("_amount").alias("_s")).collect())  # at most n_buckets rows
    out = df.withColumn("_in", F.coalesce(F.sum("_amount").over(w), F.lit(0))).withColumn("_o", _offsets(sums))
    return out.withColumn("_before", F.col("_in") + F.col("_o")).drop("_in", "_o", "_bucket", "_amount"), F.col("_before")


def surprisal(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "bits", quantile: float = 0.60, eps: float = 1e-9, max_samples: int | None = None, n_buckets: int = 64, seed: int = 0) -> DataFrame:
    """-log2 of the empirical upper tail against a background: the values up to a quantile.

    With fewer than 100 background values all finite ones are background.  The whole background counts; with
    ``max_samples`` a larger one is thinned on request, value by value (a value's share is rounded by its hash, so reruns and other
    partitionings agree).

    Values are counted once each; the table of distinct values is written, and all that follows, quantile, background and ranks, is read from
    it.  The background is the beginning of the sorted values, so a value's place in it is its place among all, or the background's end.
    """
    by, v = list(by), F.col(value)
    counts, n = value_counts(df, by, value)

    def placed(rows: DataFrame, amount: Column) -> DataFrame:
        if by:
            return laid_out(rows, by, ["_v"], amount, n)
        total = rows.agg(F.coalesce(F.sum(amount), F.lit(0)).alias("n")).first().n
        return running(rows, "_v", amount, n_buckets)[0].withColumn("_all", F.lit(total))

    ranked = placed(counts, F.col("_n"))
    if not by:
        ranked = materialize(ranked, "ranks")
    k = F.lit(quantile) * (F.col("_all") - 1)
    end = (F.col("_before") + F.col("_n")).alias("end")
    two = [statistic(f(k), F.col("_v").alias("v"), end).alias(name) for f, name in ((F.floor, "_low"), (F.ceil, "_high"))]
    stats = ranked.groupBy(*by).agg(*two, F.max(k - F.floor(k)).alias("_part"))
    cut = F.col("_low.v") + (F.col("_high.v") - F.col("_low.v")) * F.col("_part")
    stats = stats.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.when(cut >= F.col("_high.v"), F.col("_high.end")).otherwise(F.col("_low.end")).alias("_bg"))
    if by:
        same = [F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]
        ranked = ranked.join(few(stats, "background"), reduce(and_, same)).drop(*[f"_g{i}" for i in range(len(by))])
    else:
        ranked = ranked.withColumn("_bg", F.lit(stats.first()["_bg"]))
    size = F.when(F.col("_bg") < 100, F.col("_all")).otherwise(F.col("_bg"))
    place = F.least("_before", size)
    if max_samples is not None:
        share = F.least(F.lit(1.0), F.lit(float(max_samples)) / size)
        chance = F.pmod(F.xxhash64(F.lit(seed), "_v"), F.lit(1 << 20)) / float(1 << 20)
        thin = F.when(share >= 1, F.col("_n")).otherwise(F.floor(F.col("_n") * share + chance))
        thinned = ranked.withColumn("_thin", F.when(F.col("_before") < size, thin).otherwise(0)).drop("_before", "_all")
        ranked = placed(thinned, F.col("_thin"))
        place, size = F.col("_before"), F.col("_all")
    tail = (size - place + 1) / (size + 1.0)
    ranked = ranked.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.col("_v").alias("_w"), (-F.log2(F.greatest(tail, F.lit(eps)))).alias(out))
    same = [F.when(finite(v), v.cast("double")) == F.col("_w"), *[F.col(b).eqNullSafe(F.col(f"_g{i}")) for i, b in enumerate(by)]]
    # the rows keep their place where the different values are few, however many rows there are
    return df.join(F.broadcast(ranked) if n <= FEW else ranked, reduce(and_, same), "left").drop("_w", *[f"_g{i}" for i in range(len(by))])


def percentile_confidence(df: DataFrame, value: str, ties: Sequence[str], by: Sequence[str] = (), out: str = "conf", n_buckets: int = 64) -> DataFrame:
    """Ordinal rank in [0,1]; ties in the order of ``ties``."""
    order = [F.col(value), *[F.col(t) for t in ties]]
    if by:
        n = F.col("_all")
        return laid_out(df, by, order).withColumn(out, F.when(n > 1, F.col("_before") / (n - 1)).otherwise(0.0)).drop("_before", "_all")
    df = df.withColumn("_bucket", buckets(df, value, n_buckets))
    sizes = sorted((r["_bucket"], r["count"]) for r in df.groupBy("_bucket").count().collect())  # at most n_buckets rows
    total = sum(n for _, n in sizes)
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    place = (rank + _offsets(sizes)) / float(total - 1) if total > 1 else F.lit(0.0)
    return df.withColumn(out, place).drop("_bucket")


def _offsets(sizes: list[tuple[int, int]]) -> Column:
    """What lies in lower buckets, looked up by _bucket in a literal of as many entries as there are buckets."""
    most = max((b for b, _ in sizes), default=0)
    return F.get(F.lit([int(sum(n for c, n in sizes if c < b)) for b in range(most + 1)]).cast("array<bigint>"), F.col("_bucket"))


def hard_gate(score: Column, roi: Column) -> Column:
    return score * roi.cast("double")


def soft_gate(score: Column, roi: Column, conf: Column) -> Column:
    return score * roi.cast("double") * conf


def collapse_scales(df: DataFrame, by: Sequence[str], bits: str = "bits", scale: str = "scale", index: str = "scale_index") -> DataFrame:
    """Maximum over scales and the scale it comes from; the first listed scale wins a tie."""
    return df.groupBy(*by).agg(F.max(bits).alias("final_bits"), F.max_by(F.col(scale), F.struct(F.col(bits), -F.col(index))).alias("best_scale"))
