"""Binary morphology, components and set operations on masks (rows img, y, x with a boolean)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernels as K
from .storage import materialize, tasks
from .raster import KEYS, nine
from .tiles import SIDE, by_tile


def diamond(r: int) -> list[tuple[int, int]]:
    """Offsets of the cross iterated r times."""
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dy) + abs(dx) <= r]


def disk(r: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]


def reach(points: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """img, y, x of every place within the offsets of a point (also outside the image)."""
    o = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])
    moved = points.select("img", "y", "x", F.explode(o).alias("o")).select("img", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return moved.distinct()


def dilate(df: DataFrame, mask: str, r: int, out: str, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """Rows with ``out``: a masked pixel lies within the offsets (the diamond of radius r).  Tiles are painted, so a pixel is shuffled once for any r."""
    if r <= 0 and offsets is None:
        return df.withColumn(out, F.col(mask))
    far = r if offsets is None else max((abs(o) for p in offsets for o in p), default=0)
    moved = (lambda m: K.dilate(m, r)) if offsets is None else (lambda m: K.moved(m, offsets))
    keep = [c for c in df.columns if c not in (*KEYS, out)]
    return by_tile(df.withColumn("_mask", F.col(mask)), ["_mask"], lambda m: {out: moved(m)}, far, f"{out} boolean", keep=keep)


def erode(df: DataFrame, mask: str, r: int, out: str, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """The complement of the dilated complement; places outside the image count as masked."""
    return dilate(df.withColumn("_not", ~F.col(mask)), "_not", r, out, offsets).withColumn(out, ~F.col(out)).drop("_not")


def close(df: DataFrame, mask: str, r: int, out: str) -> DataFrame:
    """Closing with a disk."""
    return erode(dilate(df, mask, r, "_dilated", disk(r)), "_dilated", r, out, disk(r)).drop("_dilated")


def boundary(df: DataFrame, mask: str, out: str, connectivity: int = 2) -> DataFrame:
    """Masked pixels with an unmasked neighbour (4- or 8-connected) in the image."""
    n = nine(df.withColumn("_m", F.col(mask).cast("double")), "_m", "_n9")
    around = [1, 3, 5, 7] if connectivity == 1 else [0, 1, 2, 3, 5, 6, 7, 8]
    low = F.least(*[F.col("_n9")[i] for i in around])
    return n.withColumn(out, F.col(mask) & (low < 0.5)).drop("_m", "_n9")


def neighbours(n9: Column) -> Column:
    return sum((n9[i] for i in (1, 2, 3, 5, 6, 7, 8)), n9[0])


def endpoints(df: DataFrame, thin: str, out: str = "endpoint") -> DataFrame:
    """Masked pixels with exactly one masked neighbour."""
    n = nine(df.withColumn("_m", F.col(thin).cast("double")), "_m", "_n9", border="constant")
    return n.withColumn(out, F.col(thin) & (neighbours(F.col("_n9")) == 1)).drop("_m", "_n9")


def components(df: DataFrame, mask: str, out: str = "label", connectivity: int = 2, width: int = 1 << 20, rounds: int = 64, tile: int = SIDE) -> DataFrame:
    """Masked pixels with the smallest pixel number (y * width + x) of their connected component.

    A tile's pixels are labelled by themselves first.  Only labels that meet others across a tile's rim go in rounds: neighbouring labels take their
    smallest label and labels point to labels' labels, so the number of rounds grows with the logarithm of a component's extent in tiles.
    """
    cell = lambda c: F.floor(F.col(c) / tile).cast("int")
    px = df.where(F.col(mask)).select(*KEYS).withColumns({"ty": cell("y"), "tx": cell("x")})

    def run(t: pa.Table) -> pa.Table:
        y, x = t["y"].to_numpy().astype(np.int64), t["x"].to_numpy().astype(np.int64)
        j, i = y - y.min(), x - x.min()
        m = np.zeros((j.max() + 1, i.max() + 1), bool)
        m[j, i] = True
        own, n = K.label(m, connectivity != 1)
        least = np.full(n + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, own[j, i], y * width + x)
        return t.append_column("run", pa.array(least[own[j, i]]))

    shape = StructType([*px.schema.fields, StructField("run", LongType())])
    px = materialize(px.repartition(tasks(px.sparkSession), "img", "ty", "tx").groupBy("img", "ty", "tx").applyInArrow(run, shape), "components")
    on_rim = lambda c: (F.pmod(F.col(c), F.lit(tile)) == 0) | (F.pmod(F.col(c), F.lit(tile)) == tile - 1)
    rim = px.where(on_rim("y") | on_rim("x"))
    around = [(1, 0), (0, 1)] if connectivity == 1 else [(1, -1), (1, 0), (1, 1), (0, 1)]
    o = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in around])
    below = rim.select("img", F.col("run").alias("a"), "ty", "tx", "y", "x", F.explode(o).alias("o")).select("img", "a", "ty", "tx", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    below = below.where((cell("y") != F.col("ty")) | (cell("x") != F.col("tx"))).drop("ty", "tx")
    edges = below.join(rim.select(*KEYS, F.col("run").alias("b")), list(KEYS)).select("img", "a", "b").distinct()
    edges = materialize(edges.union(edges.select("img", F.col("b"), F.col("a"))), "components")
    label = materialize(edges.select("img", F.col("a").alias("run")).distinct().withColumn("l", F.col("run")), "components")
    for _ in range(rounds):
        near = edges.join(label.select("img", F.col("run").alias("b"), "l"), ["img", "b"]).groupBy("img", F.col("a").alias("run")).agg(F.min("l").alias("m"))
        new = label.join(near, ["img", "run"], "left").select("img", "run", "l", F.least("l", "m").alias("n"))
        # hook each old label on the least label met by its members, then jump
        hook = new.groupBy("img", F.col("l").alias("l")).agg(F.min("n").alias("h"))
        new = new.join(hook, ["img", "l"]).select("img", "run", "l", F.least("n", "h").alias("n"))
        jump = new.select("img", F.col("run").alias("n"), F.col("n").alias("nn"))
        new = materialize(new.join(jump, ["img", "n"], "left").select("img", "run", "l", F.least("n", "nn").alias("new")), "components")
        if not new.where("new <> l").limit(1).count():
            break
        label = new.select("img", "run", F.col("new").alias("l"))
    else:
        raise RuntimeError(f"labels did not settle in {rounds} rounds")
    return px.join(label, ["img", "run"], "left").select(*KEYS, F.coalesce("l", "run").alias(out))


def tied(marked: DataFrame, connectivity: int = 1) -> DataFrame:
    """img, y, x of the rows ``_weak`` whose component (of such rows) holds one that is ``_strong``."""
    lab = components(marked, "_weak", "_label", connectivity)
    keep = lab.join(marked.where("_strong").select(*KEYS), list(KEYS)).select("img", "_label").distinct()
    return lab.join(keep, ["img", "_label"], "left_semi").select(*KEYS)


def linked(df: DataFrame, weak: Column, strong: Column, out: str, connectivity: int = 1) -> DataFrame:
    """Rows with ``out``: a weak pixel whose component (of weak pixels) holds a strong one."""
    on = tied(df.withColumns({"_weak": weak, "_strong": strong & weak}), connectivity).withColumn("_on", F.lit(True))
    return df.join(on, list(KEYS), "left").withColumn(out, F.coalesce("_on", F.lit(False))).drop("_on")


def hysteresis(df: DataFrame, score: str, low: float, high: float, out: str, connectivity: int = 1, at_least: bool = False) -> DataFrame:
    """Pixels over ``low`` whose component holds one over ``high`` (or, ``at_least``, one not under it)."""
    s = F.col(score)
    return linked(df, s > low, (s >= high) if at_least else (s > high), out, connectivity)


def near_pairs(points: DataFrame, id_col: str, radius: float) -> DataFrame:
    """id_a < id_b and their distance, for points of one image within a radius: an equi-join on grid cells."""
    cell = lambda c: F.floor(F.col(c) / float(radius))
    a = points.select("img", F.col(id_col).alias("id_a"), F.col("y").alias("ya"), F.col("x").alias("xa"), cell("y").alias("cy"), cell("x").alias("cx"))
    o = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    a = a.withColumn("o", F.explode(o)).withColumn("cy", F.col("cy") + F.col("o.dy")).withColumn("cx", F.col("cx") + F.col("o.dx")).drop("o")
    b = points.select("img", F.col(id_col).alias("id_b"), F.col("y").alias("yb"), F.col("x").alias("xb"), cell("y").alias("cy"), cell("x").alias("cx"))
    d = F.sqrt(F.pow((F.col("ya") - F.col("yb")).cast("double"), F.lit(2.0)) + F.pow((F.col("xa") - F.col("xb")).cast("double"), F.lit(2.0)))
    return a.join(b, ["img", "cy", "cx"]).where("id_a < id_b").withColumn("dist", d).where(F.col("dist") <= radius).drop("cy", "cx")


def angle_gap(a: Column, b: Column) -> Column:
    """Distance of two undirected angles."""
    import math

    return F.abs(F.pmod(a - b + math.pi / 2, F.lit(math.pi)) - math.pi / 2)
