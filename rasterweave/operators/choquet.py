"""Integrals of the Choquet family over descriptor arrays, as columns.

An integral sorts a row's descriptors, weighs the tail coalitions by a measure and folds neighbours with binary
functions.  It is one expression over one row: no shuffle, no UDF.  ``relational`` says the same with explode, window
and group, for engines or checks that have no array functions.  ``aggregate`` integrates a column over the rows of a group of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binary
from ..functions.measures import clip, flat_capacities, ordered, tail_capacities
from .ordering import laid_out, value_counts

FAMILIES = ("choquet", "expanded", "CF", "CC", "CF1F2")


def _function(f: str | Callable) -> Callable:
    return binary.column(f) if isinstance(f, str) else f


def integral(x: Column, n: int, family: str = "CF1F2", *, f: str | Callable = "TP", f1: str | Callable = "TP", f2: str | Callable = "TL", spec: Mapping[str, Any] | None = None, **measure: Any) -> Column:
    """The integral of array column ``x`` of n descriptors; null where x is."""
    if family.upper() not in {k.upper() for k in FAMILIES}:
        raise ValueError(f"unknown family: {family}")
    kind = family.upper()
    flat = flat_capacities(x, n, spec, **measure)
    mu = tail_capacities(x, n, spec, **measure) if flat is None else None
    if kind == "CF1F2" and n == 1:
        return clip(F.element_at(x, 1))
    term: Callable[[Column, Column, Column], Column]
    if kind == "CHOQUET":
        term = lambda a, b, w: (b - a) * w
    elif kind == "EXPANDED":
        term = lambda a, b, w: b * w - a * w
    elif kind == "CF":
        g = _function(f)
        term = lambda a, b, w: g(b - a, w)
    elif kind == "CC":
        g = _function(f)
        term = lambda a, b, w: g(b, w) - g(a, w)
    else:
        g1, g2 = _function(f1), _function(f2)
        term = lambda a, b, w: g1(b, w) - g2(a, w)
    if flat is not None:  # few descriptors: plain arithmetic, of which Spark evaluates equal parts once
        v = [F.get(F.sort_array(x), F.lit(i)) for i in range(n)]
        total = F.when(F.size(x) == n, F.lit(0.0)) + (v[0] if kind == "CF1F2" else term(F.lit(0.0), v[0], flat[0]))
        for i in range(1, n):
            total = total + term(v[i - 1], v[i], flat[i])
        return total if kind in ("CHOQUET", "EXPANDED") else clip(total)
    # the sorted values and capacities are computed once, as fields of one struct
    s = F.struct(F.transform(ordered(x), lambda p: p["v"]).alias("v"), mu.alias("m"))

    def fold(of: Column) -> Column:
        v, m = of["v"], of["m"]
        pair = F.zip_with(v, m, lambda b, w: F.struct(b.alias("b"), w.alias("w")))
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("a"), F.lit(True).alias("first"))
        if kind == "CF1F2":
            step = lambda acc, p: F.struct((acc["s"] + F.when(acc["first"], p["b"]).otherwise(term(acc["a"], p["b"], p["w"]))).alias("s"), p["b"].alias("a"), F.lit(False).alias("first"))
        else:
            step = lambda acc, p: F.struct((acc["s"] + term(acc["a"], p["b"], p["w"])).alias("s"), p["b"].alias("a"), F.lit(False).alias("first"))
        return F.aggregate(pair, start, step, lambda acc: acc["s"])

    out = F.element_at(F.transform(F.array(s), fold), 1)
    return out if kind in ("CHOQUET", "EXPANDED") else clip(out)


def relational(rows: DataFrame, key: str, x: str, mu: list[float], family: str, *, f: str = "TP", f1: str = "TP", f2: str = "TL") -> DataFrame:
    """key, value by explode, window and group; ``mu`` are the tail capacities of a cardinality measure."""
    n = len(mu)
    w = Window.partitionBy(key).orderBy("v", "i")
    t = rows.select(key, F.posexplode(x).alias("i", "v")).withColumn("r", F.row_number().over(w)).withColumn("a", F.lag("v", 1, 0.0).over(w)).withColumn("w", F.element_at(F.lit([float(m) for m in mu]), F.col("r")))
    b, a, m = F.col("v"), F.col("a"), F.col("w")
    kind = family.upper()
    if kind == "CHOQUET":
        term = (b - a) * m
    elif kind == "EXPANDED":
        term = b * m - a * m
    elif kind == "CF":
        term = binary.column(f)(b - a, m)
    elif kind == "CC":
        term = binary.column(f)(b, m) - binary.column(f)(a, m)
    else:
        term = F.when(F.col("r") == 1, b).otherwise(binary.column(f1)(b, m) - binary.column(f2)(a, m))
    out = F.sum(term)
    return t.groupBy(key).agg((out if kind in ("CHOQUET", "EXPANDED") else clip(out)).alias("value"), F.count("*").alias("n")).where(F.col("n") == n).drop("n")


def aggregate(rows: DataFrame, by: Sequence[str], value: str, capacity: Callable[[Column], Column], family: str = "choquet", f: str | Callable = "TP") -> DataFrame:
    """by, n, integral: the integral of a column's finite values over each group, whose capacity depends on the share of its rows only.

    Values are counted once each; a value's coalition is the rows that are not below it.  Of equal values the first has the whole coalition, and the
    others add nothing (so ``CF`` asks for an f with f(0, w) = 0).  The counts merge, and places in a group come from ranges (``laid_out``), so
    no task holds or sorts a group.
    """
    kind, by = family.lower(), list(by)
    if kind not in ("choquet", "cf", "cc"):
        raise ValueError(f"no aggregate form of the family: {family}")
    counts, n = value_counts(rows, by, value)
    placed = laid_out(counts, by, ["_v"], F.col("_n"), n)
    share = lambda before: (F.col("_all") - before) / F.col("_all").cast("double")
    here = capacity(share(F.col("_before")))
    v = F.col("_v")
    if kind == "choquet":
        after = F.col("_before") + F.col("_n")
        term = v * (here - F.when(after < F.col("_all"), capacity(share(after))).otherwise(0.0))
    else:  # the value below is the one whose rows end where this one's begin
        names = [f"_of{i}" for i in range(len(by))]
        below = placed.select(*[F.col(b).alias(k) for b, k in zip(by, names, strict=True)], (F.col("_before") + F.col("_n")).alias("_end"), v.alias("_a"))
        same = F.col("_before") == F.col("_end")
        for b, k in zip(by, names, strict=True):
            same = same & F.col(b).eqNullSafe(F.col(k))
        placed = placed.join(below, same, "left").drop(*names, "_end")
        a, g = F.coalesce("_a", F.lit(0.0)), _function(f)
        term = g(v - a, here) if kind == "cf" else g(v, here) - g(a, here)
    total = F.sum(term)
    return placed.groupBy(*by).agg(F.sum("_n").alias("n"), (total if kind == "choquet" else clip(total)).alias("integral"))
