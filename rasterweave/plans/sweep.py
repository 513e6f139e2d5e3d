"""Configuration sweeps: grids as tables, scores joined to them, multi-key rankings, per-group best rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary
from ..operators.choquet import integral

METRICS = ("ODS", "AP", "OIS")


def grid(spark: SparkSession, **axes: Sequence[Any]) -> DataFrame:
    """Every combination of the axes' values; axes are short lists."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def pair_checks(spark: SparkSession, steps: int = 101, tol: float = 1e-9, points: DataFrame | None = None) -> DataFrame:
    """F1, F2, dominates, F1_first_increasing, boundary_ok, passes, min_margin of all pairs of registered functions.

    The functions are evaluated on the grid (steps**2 rows) and at further ``points`` (x, y in [0,1]: values and measures that occur), where
    they are given; each task keeps the least margin of every pair, and these are put together.
    """
    names = binary.names()
    n, k = steps - 1, len(names)
    g = spark.range(steps * steps).select((F.floor(F.col("id") / steps) / n).alias("x"), (F.col("id") % steps / n).alias("y"))
    values = F.array(*[F.struct(F.lit(f).alias("f"), binary.column(f)(F.col("x"), F.col("y")).alias("v")) for f in names])
    long = g.select("x", "y", F.explode(values).alias("r")).select("x", "y", "r.*")  # a row for each grid point and function
    rise = F.col("v") - F.lag("v").over(Window.partitionBy("f", "y").orderBy("x"))
    at = lambda x, y: F.max(F.when((F.col("x") == x) & (F.col("y") == y), F.col("v")))
    one = long.withColumn("d", rise).groupBy("f").agg(F.min("d").alias("d"), at(0.0, 1.0).alias("lo"), at(1.0, 1.0).alias("hi"))
    first = F.broadcast(one.select(F.col("f").alias("F1"), (F.col("d") >= -tol).alias("F1_first_increasing"), ((F.abs("lo") < 1e-7) & (F.abs(F.col("hi") - 1) < 1e-7)).alias("ok1")))  # a row for each function
    second = F.broadcast(one.select(F.col("f").alias("F2"), (F.abs("lo") < 1e-7).alias("ok2")))
    tried = g if points is None else g.union(points.select(F.col("x").cast("double"), F.col("y").cast("double")).where("x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1"))

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full((k, k), np.inf)
        for b in batches:
            v = b.column(0).flatten().to_numpy().reshape(-1, k)
            for i in range(k):
                if len(v):
                    least[i] = np.minimum(least[i], (v[:, i, None] - v).min(axis=0))
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(least.ravel())], names=["i", "j", "m"])

    pairs = tried.select(F.array(*[binary.column(f)(F.col("x"), F.col("y")) for f in names]).alias("v")).mapInArrow(margins, "i long, j long, m double").groupBy("i", "j").agg(F.min("m").alias("min_margin"))
    called = F.lit(names)
    out = pairs.select(F.get(called, F.col("i")).alias("F1"), F.get(called, F.col("j")).alias("F2"), "min_margin").join(first, "F1").join(second, "F2")
    out = out.select("F1", "F2", "min_margin", "F1_first_increasing", (F.col("ok1") & F.col("ok2")).alias("boundary_ok"), (F.col("min_margin") >= -tol).alias("dominates"))
    return out.withColumn("passes", F.col("dominates") & F.col("F1_first_increasing") & F.col("boundary_ok"))


def operator_specs(spark: SparkSession, mode: str = "screen", points: DataFrame | None = None) -> DataFrame:
    """operator, family, F, F1, F2.  screen: all; default, cf21, diagonal21, knownpairs, allpairs: parts.  Pairs are checked at ``points`` too."""
    schema = "operator string, family string, F string, F1 string, F2 string"
    cf = [(f"CF_{k}", "CF", k, None, None) for k in binary.names()]
    cc = [(f"CC_{k}", "CC", k, None, None) for k in binary.names() if k in binary.COPULA_LIKE]
    pair = lambda a, b: (f"CF1F2_{a}_{b}", "CF1F2", None, a, b)
    fixed = {"default": [pair("TP", "TL")], "cf21": cf, "diagonal21": [pair(k, k) for k in binary.names()], "knownpairs": [pair(a, b) for a, b in binary.KNOWN_PAIRS]}
    if mode in fixed:
        return spark.createDataFrame(fixed[mode], schema)
    ok = pair_checks(spark, points=points).where("passes").select(F.concat(F.lit("CF1F2_"), "F1", F.lit("_"), "F2").alias("operator"), F.lit("CF1F2").alias("family"), F.lit(None).cast("string").alias("F"), "F1", "F2")
    if mode == "allpairs":
        return ok
    if mode != "screen":
        raise ValueError(f"unknown operator mode: {mode}")
    return spark.createDataFrame(cf + cc, schema).unionByName(ok)


def integrals(x: Column, n: int, specs: Sequence[dict[str, Any]], measure: dict[str, Any] | None = None) -> Column:
    """One array of structs (operator, value): many operators on one row, sharing its sorted descriptors."""
    some = []
    for s in specs:
        names = {"f": s.get("F") or "TP", "f1": s.get("F1") or "TP", "f2": s.get("F2") or "TL"}
        some.append(F.struct(F.lit(s["operator"]).alias("operator"), integral(x, n, s["family"], spec=measure, **names).alias("value")))
    return F.array(*some)


def rank(df: DataFrame, keys: Sequence[str] = METRICS, ties: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """Rows by descending keys, then by ties, with selection_rank; a top-k never sorts more than k rows in one place."""
    order = [F.desc(c) for c in keys] + [F.asc(c) for c in ties]
    top = df.orderBy(*order) if k is None else df.orderBy(*order).limit(k)
    return top.withColumn("selection_rank", F.row_number().over(Window.orderBy(*order))) if k is not None else top


def best_per(df: DataFrame, group: Sequence[str], keys: Sequence[str], columns: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """For each group, each column's first non-null value in descending order of the keys."""
    order = [F.desc(c) for c in keys] + [F.asc(c) for c in ties]
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(*group, *[F.first(c, ignorenulls=True).over(w).alias(c) for c in columns]).distinct()


def running_best(df: DataFrame, group: Sequence[str], order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Each row with best_<key>: the lexicographically greatest keys among its group's rows up to it, by the order (unique in a group)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = df.withColumn("_best", F.max(F.struct(*keys)).over(w))
    return best.select(*df.columns, *[F.col("_best")[k].alias(f"best_{k}") for k in keys])


def remaining(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not done yet; a null key is never done."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def stability(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, least, most, sample deviation and range of a value by group."""
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("std")).withColumn("range", F.col("most") - F.col("least"))


def micro(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Pooled precision, recall and F of counts mp, npred, mg, ngt."""
    from ..operators.evaluation import prf

    s = df.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("mp", "npred", "mg", "ngt")])
    p, r, f = prf(*[F.col(c) for c in ("mp", "npred", "mg", "ngt")])
    return s.select(*group, p.alias("precision"), r.alias("recall"), f.alias("F1"))


def with_default(df: DataFrame, chosen: DataFrame, key: str, column: str, default: float) -> DataFrame:
    return df.join(chosen.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def coarse_context(family: Column) -> Column:
    """Ten degradation families as four contexts."""
    # The grouping.
    groups = {"stochastic": ["gaussian", "saltpepper", "speckle"], "blur_motion": ["blur", "motion"], "texture_compound": ["texture", "compound"]}
    out = None
    for name, members in groups.items():
        c = family.isin(members)
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise("structural")
