"""Capacity lattices as tables: one row for each coalition mask with its measure.

Small by nature (2**n rows), but joins on the lattice's edges let thousands of capacities be checked or explained at
once: every function takes rows keyed by ``by`` columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def lattice(spark: SparkSession, tables: dict[str, Sequence[float]]) -> DataFrame:
    """name, n, mask, card, mu of capacity tables."""
    rows = [(k, len(t).bit_length() - 1, [float(v) for v in t]) for k, t in tables.items()]
    df = spark.createDataFrame(rows, "name string, n int, t array<double>")
    return df.select("name", "n", F.posexplode("t").alias("m", "mu")).select("name", "n", F.col("m").cast("long").alias("mask"), F.bit_count(F.col("m").cast("long")).alias("card"), "mu")


def empirical(df: DataFrame, by: Sequence[str], x: str, n: int) -> DataFrame:
    """name, n, mask, card, mu: for each group, how much of the best of all descriptors a coalition's own best makes up on average; a capacity,
    as a larger coalition's best is no smaller.  2**n sums a group, partly added before the shuffle."""
    masks = range(1 << n)
    best = lambda m: F.array_max(F.array(*[F.greatest(F.col(x)[i], F.lit(0.0)) for i in range(n) if m >> i & 1])) if m else F.lit(0.0)
    sums = df.groupBy(*by).agg(*[F.sum(best(m)).alias(f"_s{m}") for m in masks])
    each = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("card"), (F.col(f"_s{m}") / F.col(f"_s{masks[-1]}")).alias("mu")) for m in masks])
    return sums.where(F.col(f"_s{masks[-1]}") > 0).select(F.concat_ws("|", *by).alias("name"), F.lit(n).alias("n"), F.explode(each).alias("e")).select("name", "n", "e.*")


def edges(lat: DataFrame) -> DataFrame:
    """name, n, i, mask, card, lower, upper: each criterion joining each coalition that lacks it."""
    low = lat.select("name", "n", "mask", "card", F.col("mu").alias("lower"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).where(F.col("mask").bitwiseAND(bit(F.col("i"))) == 0)
    up = lat.select("name", F.col("mask").alias("sup"), F.col("mu").alias("upper"))
    return low.withColumn("sup", F.col("mask").bitwiseOR(bit(F.col("i")))).join(up, ["name", "sup"])


def validate(lat: DataFrame, tol: float = 1e-8) -> DataFrame:
    """name, boundary_ok, range_ok, monotone, valid."""
    b = lat.groupBy("name").agg(
        F.bool_and(F.when(F.col("card") == 0, F.abs("mu") <= tol).when(F.col("card") == F.col("n"), F.abs(F.col("mu") - 1) <= tol).otherwise(True)).alias("boundary_ok"),
        F.bool_and((F.col("mu") >= -tol) & (F.col("mu") <= 1 + tol)).alias("range_ok"),
    )
    m = edges(lat).groupBy("name").agg(F.bool_and(F.col("upper") - F.col("lower") >= -tol).alias("monotone"))
    return b.join(m, "name").withColumn("valid", F.col("boundary_ok") & F.col("range_ok") & F.col("monotone"))


def shapley(lat: DataFrame) -> DataFrame:
    """name, i, shapley."""
    w = F.factorial("card") * F.factorial(F.col("n") - F.col("card") - 1) / F.factorial("n")
    return edges(lat).groupBy("name", "i").agg(F.sum(w * (F.col("upper") - F.col("lower"))).alias("shapley"))


def interaction(lat: DataFrame) -> DataFrame:
    """name, i, j, interaction for i < j: positive for synergy, negative for redundancy."""
    e = edges(lat)
    gain = e.select("name", "n", "mask", "card", "i", (F.col("upper") - F.col("lower")).alias("gain"))
    without = gain.select("name", F.col("mask").alias("m0"), "n", "card", "i", F.col("gain").alias("g0"), F.explode(F.sequence(F.col("i") + 1, F.col("n"))).alias("j")).where((F.col("j") < F.col("n")) & (F.col("m0").bitwiseAND(bit(F.col("j"))) == 0))
    with_j = gain.select("name", F.col("mask").alias("m1"), "i", F.col("gain").alias("g1"))
    w = F.factorial("card") * F.factorial(F.col("n") - F.col("card") - 2) / F.factorial(F.greatest(F.col("n") - 1, F.lit(1)))
    return without.withColumn("m1", F.col("m0").bitwiseOR(bit(F.col("j")))).join(with_j, ["name", "m1", "i"]).groupBy("name", "i", "j").agg(F.sum(w * (F.col("g1") - F.col("g0"))).alias("interaction"))
