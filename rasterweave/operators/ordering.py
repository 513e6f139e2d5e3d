"""Places and order statistics in groups of any size.

Rows are dealt over tasks by ranges of (group, value): a large group takes many ranges, and a range many small groups.  What a range holds of a
group is added up, and these sums, laid end to end by group, say where each range begins in it.  So no task sees more of a group than a range has,
and the table of beginnings has a row for each range and one for each group at most.

Tables that are known to have at most WHOLE rows in all their groups together are laid out by a plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import few, materialize

WHOLE = 1_000_000
BINS = 1024


def laid_out(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], amount: Column | None = None, rows: int | None = None) -> DataFrame:
    """``df`` with ``_before``, the sum of ``amount`` (or number of rows) over earlier rows of the group, and ``_all``, over the group.

    Null groups are groups; ``rows``, if known, is the number of rows of ``df``."""
    by = list(by)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    df = df.withColumn("_amount", F.lit(1) if amount is None else amount)
    earlier = lambda w: F.coalesce(F.sum("_amount").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if rows is not None and rows <= WHOLE:
        group = Window.partitionBy(*by)
        return df.withColumns({"_before": earlier(group.orderBy(*order)), "_all": F.sum("_amount").over(group)}).drop("_amount")
    dealt = materialize(df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_amount").alias("_amount"))
    group = Window.partitionBy(*by)
    names = [f"_of{i}" for i in range(len(by))]
    begins = sums.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col("_range").alias("_of_range"), earlier(group.orderBy("_range")).alias("_begin"), F.sum("_amount").over(group).alias("_all"))
    inside = dealt.withColumn("_before", earlier(Window.partitionBy(*by, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_of_range")
    for b, n in zip(by, names, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(n))
    out = inside.join(begins, same).withColumn("_before", F.col("_before") + F.col("_begin"))
    return out.drop(*names, "_of_range", "_begin", "_range", "_amount")


def statistic(at: Column, *keep: Column) -> Column:
    """Aggregate: ``keep`` as a struct, of the row that covers place ``at`` (rows have _before and _n)."""
    return F.max(F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")), F.struct(*keep)))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> tuple[DataFrame, int]:
    """(a written table of by, _v, _n: each finite value once with its number of rows; how many rows that has)."""
    v = F.col(value)
    counts = materialize(df.where(finite(v)).groupBy(*by, v.cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "values")
    return counts, counts.count()


def _groups(by: Sequence[str]) -> list[str]:
    return [f"_g{i}" for i in range(len(by))]


def beside(df: DataFrame, other: DataFrame, by: Sequence[str], *also: Column) -> DataFrame:
    """Rows of ``df`` with the columns of ``other``, whose groups are named _g0, _g1, ...; null groups are groups."""
    same = reduce(and_, [*[F.col(b).eqNullSafe(F.col(g)) for b, g in zip(by, _groups(by), strict=True)], *also])
    return df.join(other, same).drop(*_groups(by))


def group_quantiles(df: DataFrame, by: Sequence[str], probs: dict[str, Sequence[float]], stored: bool = False) -> DataFrame:
    """``by`` and for each column an array of its quantiles by linear interpolation over finite values; groups without any are absent.

    Of many values only counts by bin (BINS equal parts of a group's range) are shuffled; the bins that hold wanted places are then read value by
    value.  ``stored``: ``df`` is a table or a cheap view of one, and is not written first."""
    by, cols = list(by), list(probs)
    df = df.select(*by, *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])
    if not stored:
        df = materialize(df, "columns")
    mine = lambda i, c: F.when(F.col("_no") == i, c)
    as_groups = [F.col(b).alias(g) for b, g in zip(by, _groups(by), strict=True)]
    # a row for each column's value: the table is read once a pass for any number of columns, and the code stays short enough to be compiled
    each = df.select(*by, F.posexplode(F.array(*[f"_c{i}" for i in range(len(cols))])).alias("_no", "_v")).where(finite(F.col("_v")))
    extent = few(each.groupBy(*as_groups, F.col("_no").alias("_of")).agg(F.count(F.lit(1)).alias("_all_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "extent")
    if (extent.agg(F.sum("_all_n")).first()[0] or 0) <= WHOLE:
        counts = each.groupBy(*by, "_no", "_v").agg(F.count(F.lit(1)).alias("_n"))
        return counts.groupBy(*by).agg(*[F.percentile(mine(i, F.col("_v")), F.lit([float(p) for p in probs[c]]), F.col("_n")).alias(c) for i, c in enumerate(cols)])
    v, lo, hi = (F.col(c) / 2 for c in ("_v", "_lo", "_hi"))  # halves, so that no range is too large
    part = F.when(hi - lo > 0, ((v - lo) / (hi - lo) * BINS).cast("int")).otherwise(0)
    binned = beside(each, extent, by, F.col("_no") == F.col("_of")).select(*by, "_no", part.alias("_bin"), "_v")
    bins = materialize(binned.groupBy(*by, "_no", "_bin").agg(F.count(F.lit(1)).alias("_n")), "bins")
    placed = laid_out(bins, [*by, "_no"], ["_bin"], F.col("_n"), bins.count())
    place = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    within = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))
    held = [mine(i, within(F.floor(place(p))) | within(F.ceil(place(p)))) for i, c in enumerate(cols) for p in probs[c]]
    wanted = placed.where(reduce(or_, [F.coalesce(h, F.lit(False)) for h in held]))
    wanted = few(wanted.select(*as_groups, F.col("_no").alias("_of"), F.col("_bin").alias("_at"), F.col("_before").alias("_head"), "_all"), "wanted")
    inside = beside(binned, wanted, by, F.col("_no") == F.col("_of"), F.col("_bin") == F.col("_at"))
    counts = materialize(inside.groupBy(*by, "_no", "_bin", "_head", F.col("_all").alias("_whole"), "_v").agg(F.count(F.lit(1)).alias("_n")), "values")
    placed = laid_out(counts, [*by, "_no", "_bin"], ["_v"], F.col("_n"), counts.count())
    placed = placed.withColumns({"_before": F.col("_before") + F.col("_head"), "_all": F.col("_whole")})
    aggs = []
    for i, c in enumerate(cols):
        for j, p in enumerate(probs[c]):
            k = place(p)
            aggs += [statistic(F.floor(k), F.col("_v").alias("v")).alias(f"l{i}_{j}"), statistic(F.ceil(k), F.col("_v").alias("v")).alias(f"h{i}_{j}"), F.max(k - F.floor(k)).alias(f"f{i}_{j}")]
    found = placed.groupBy(*by, "_no").agg(*aggs)
    between = lambda i, j: F.col(f"l{i}_{j}.v") + (F.col(f"h{i}_{j}.v") - F.col(f"l{i}_{j}.v")) * F.col(f"f{i}_{j}")
    return found.groupBy(*by).agg(*[F.max(mine(i, F.array(*[between(i, j) for j in range(len(probs[c]))]))).alias(c) for i, c in enumerate(cols)])
