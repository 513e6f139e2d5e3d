"""Images tile by tile: filters of a bounded reach, filters over a region, thinning in rounds.

A tile is a key: every pixel goes to the tiles whose halo holds it, and each tile is worked on by itself.  So one image spreads over as many
tasks as it has tiles, and a task holds one tile with its halo.  What needs more than a bounded reach goes in rounds: a round does as many
steps as the halo allows, and the next one takes only the tiles that changed and their neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .information import clip01
from .ordering import WHOLE, group_quantiles
from .raster import KEYS
from .storage import FEW, few, materialize, release, tasks

TILE = 32
SIDE = 64  # of tiles that are not kept to a region
TALL = 256  # rows of such a tile: so many more pixels share a halo and a call
STEPS = 16  # of thinning in a round


def dealt(pixels: DataFrame, halo: int, tile: int, tall: int | None = None) -> DataFrame:
    """Each pixel once for each tile (ty, tx) of ``tall`` rows (``tile``, if not given) and ``tile`` columns whose halo holds it.

    Images begin at (0, 0): no pixel from there on goes to a tile before."""
    cell = lambda c, n, off: F.floor((F.col(c) + off) / n).cast("int")
    around = lambda c, n: F.explode(F.sequence(F.greatest(cell(c, n, -halo), F.least(F.lit(0), cell(c, n, 0))), cell(c, n, halo)))
    return pixels.withColumn("ty", around("y", tall or tile)).withColumn("tx", around("x", tile))


def wrapped(pixels: DataFrame, halo: int) -> DataFrame:
    """Dense images from (0, 0) on, with _h, _w, and copies of the pixels up to ``halo`` beyond the borders, where the image begins again.

    An image is repeated as often as its halo asks for."""
    size = few(pixels.groupBy("img").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w")), "sizes")
    out, kind = pixels.join(size, "img"), dict(pixels.dtypes)
    for c, n in (("y", "_h"), ("x", "_w")):
        first, last = F.ceil((-halo - F.col(c)) / F.col(n)).cast("int"), F.floor((F.col(n) - 1 + halo - F.col(c)) / F.col(n)).cast("int")
        out = out.withColumn("_times", F.explode(F.sequence(first, last))).withColumn(c, (F.col(c) + F.col("_times") * F.col(n)).cast(kind[c])).drop("_times")
    return out


#: Arrow's names of what a tile's function may make.
_MADE = {"double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def by_tile(pixels: DataFrame, cols: Sequence[str], fn: Callable[..., dict[str, np.ndarray]], halo: int, schema: str, tile: int = SIDE, wrap: bool = False, keep: Sequence[str] = (), rows: bool = False) -> DataFrame:
    """img, y, x, the columns to ``keep`` and what ``fn`` makes of the columns' rasters, for functions that read at most ``halo`` pixels around a place.

    A block ends where its halo does or where the image does, so the function's own border rule holds at the image's borders; with ``wrap``
    the image goes on beyond them from its other side.  Places that have no pixel are zero.  With ``rows`` the function is told (first, end) of
    the block's rows whose values are taken.
    """
    tall = max(tile, TALL) if tile == SIDE else tile
    held = list(dict.fromkeys([*KEYS, *keep]))
    source = pixels.select(*dict.fromkeys([*held, *cols]))
    cells = dealt(wrapped(source, halo) if wrap else source, halo, tile, tall)
    if wrap:  # tiles of the image only
        inside = lambda t, n, side: F.col(t).between(F.lit(0), F.floor((F.col(n) - 1) / side))
        cells = cells.where(inside("ty", "_h", tall) & inside("tx", "_w", tile))
    made_types = [(n, _MADE[t]) for n, t in (c.split(" ", 1) for c in schema.split(", "))]

    def run(t: pa.Table) -> pa.Table:
        y, x = t["y"].to_numpy(), t["x"].to_numpy()
        mine = (y // tall == t["ty"][0].as_py()) & (x // tile == t["tx"][0].as_py())
        if wrap:
            mine &= (y < t["_h"][0].as_py()) & (x < t["_w"][0].as_py())
        own = t.select(held).filter(pa.array(mine))
        if not len(own):  # a tile beyond the image
            for n, kind in made_types:
                own = own.append_column(n, pa.array([], kind))
            return own
        j, i = y - y.min(), x - x.min()
        blocks = []
        for c in cols:
            v = t[c]
            truth = pa.types.is_boolean(v.type)
            blocks.append(np.zeros((j.max() + 1, i.max() + 1), bool if truth else float))
            blocks[-1][j, i] = v.fill_null(False).to_numpy() if truth else v.to_numpy()
        made = fn(*blocks, (int(j[mine].min()), int(j[mine].max()) + 1)) if rows else fn(*blocks)
        for n, kind in made_types:
            v = made[n][j[mine], i[mine]]
            own = own.append_column(n, pa.array(list(v) if v.ndim == 2 else v, kind))
        return own

    shape = StructType([*source.select(*held).schema.fields, *StructType.fromDDL(schema).fields])
    return cells.repartition(tasks(cells.sparkSession), "img", "ty", "tx").groupBy("img", "ty", "tx").applyInArrow(run, shape)


def diffusion(pixels: DataFrame, value: str, out: str = "out", niter: int = 10, kappa: float = 0.10, gamma: float = 0.15, tile: int = SIDE) -> DataFrame:
    """img, y, x, ``out``: anisotropic diffusion of dense images whose borders meet.  A step reads one pixel around, so a halo of ``niter`` pixels
    holds what all steps on a tile need."""
    v = pixels.select(*KEYS, clip01(F.col(value).cast("double")).alias("v"))
    return by_tile(v, ["v"], lambda a: {out: K.anisotropic(a, niter, kappa, gamma)}, niter, f"{out} double", tile, wrap=True)


def mean_shift(pixels: DataFrame, value: str, out: str = "out", sp: float = 5, sr: float = 18, max_level: int = 1, rounds: int = 5, tile: int = SIDE) -> DataFrame:
    """img, y, x, ``out``: mean shift over a filtered pyramid as ``kernels.mean_shift`` has it, for dense images with values in [0,1].

    A level is a table of whole tones: it is smoothed by tile and every other pixel kept for the next one; the filtered level above is spread over
    even places and filled in by tile; tiles are shifted with a halo as wide as all rounds can reach.  Small images stay out of the levels above."""
    tone = lambda c: F.rint(clip01(F.col(c).cast("double")) * 255)
    wide = int(sp) * (rounds + 1) + 2
    wide += wide % 2  # blocks begin at even places, as halves are rounded to even ones

    def level(a: DataFrame, left: int) -> DataFrame:
        own = by_tile(a, ["a"], lambda v: {"own": K.shifted(v, sp, sr, rounds)}, wide, "own double", tile)
        if left <= 0:
            return own
        size = a.groupBy("img").agg(F.least(F.max("y"), F.max("x")).alias("n")).where(F.col("n") + 1 >= K.SMALL).select("img")
        large = a.join(size, "img", "left_semi")
        half = by_tile(large, ["a"], lambda v: {"a": K.reduced(v)}, 2, "a double", tile).where("y % 2 = 0 AND x % 2 = 0")
        half = materialize(half.select("img", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), "a"), "pyramid")
        small = level(half, left - 1).select("img", (F.col("y") * 2).alias("y"), (F.col("x") * 2).alias("x"), F.rint("own").alias("up"))
        apart = large.select(*KEYS).join(small, list(KEYS), "left").withColumn("up", F.coalesce("up", F.lit(0.0)))
        up = by_tile(apart, ["up"], lambda v: {"up": K.spaced(v)}, 2, "up double", tile)
        both = a.join(own, list(KEYS)).join(up, list(KEYS), "left")
        return both.select(*KEYS, F.when(F.abs(F.col("up") - F.col("a")) <= sr, F.col("up")).otherwise(F.col("own")).alias("own"))

    start = materialize(pixels.select(*KEYS, tone(value).alias("a")), "pyramid")
    return level(start, max_level).select(*KEYS, clip01(F.col("own") / 255).alias(out))


def gravitational(pixels: DataFrame, value: str, out: str = "out", G: float = 0.05, omega_c: float = 20.0, iterations: int = 30, interaction_radius_frac: float = 0.02, step: float = 0.20, tile: int = SIDE) -> DataFrame:
    """img, y, x, ``out``: the gravitational filter of ``kernels`` in rounds.  A round moves all tiles' pixels, finds how far each image's 0.995 quantile of
    moves goes, and holds the larger ones back; images of one radius go together.  A round's tables go when the next one has its own."""
    a = materialize(pixels.select(*KEYS, clip01(F.col(value).cast("double")).alias("a")), "gravity")
    size = a.groupBy("img").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    reach = F.greatest(F.lit(1), F.ceil(interaction_radius_frac * F.sqrt(F.col("h").cast("double") ** 2 + F.col("w").cast("double") ** 2)).cast("int"))
    radii = materialize(size.select("img", reach.alias("r")), "gravity")
    each = sorted(radii.select("r").distinct().collect())  # as many as the images have sizes, about
    small = a.count() <= WHOLE and radii.count() <= FEW
    for _ in range(iterations if each else 0):
        moves = None
        for (r,) in each:
            some = a.join(radii.where(F.col("r") == r).select("img"), "img", "left_semi") if len(each) > 1 else a
            side = max(tile, 1 << r.bit_length())  # a halo makes a tile no more than three times as long
            made = by_tile(some, ["a"], lambda v, rows, r=r: {"move": K.attraction(v, r, G, omega_c, rows)}, r, "move double", side, keep=["a"], rows=True)
            moves = made if moves is None else moves.union(made)
        moves = materialize(moves.withColumn("far", F.abs("move")), "gravity")
        if small:  # a pass is all that it takes
            most = moves.groupBy("img").agg(F.percentile("far", F.lit(0.995)).alias("most"))
        else:
            most = few(group_quantiles(moves, ["img"], {"far": [0.995]}, True).select("img", F.col("far")[0].alias("most")), "most")
        held = F.when(F.col("most") > 0, F.least(F.col("most"), F.greatest(-F.col("most"), F.col("move")))).otherwise(F.col("move"))
        moved = materialize(moves.join(F.broadcast(most) if small else most, "img").select(*KEYS, clip01(F.col("a") + step * held).alias("a")), "gravity")
        del made, most
        release(a, moves)
        a = moved
    return a.withColumnRenamed("a", out)


def condition(pixels: DataFrame, value: str, method: str, out: str = "out", tile: int = SIDE, **params: Any) -> DataFrame:
    """img, y, x, ``out``: dense images with values in [0,1] under a filter of ``kernels.condition``, chosen by name."""
    name = method.lower()
    rounds = {"meanshift": mean_shift, "anisotropic": diffusion, "gravitational": gravitational, "gravity": gravitational}
    if name in rounds:
        return rounds[name](pixels, value, out, tile=tile, **{k: v for k, v in params.items() if k != "halo"})
    v = pixels.select(*KEYS, clip01(F.col(value).cast("double")).alias("_v"))
    if name == "none":
        return v.withColumnRenamed("_v", out)
    if name not in K.HALO:
        raise ValueError(f"unknown conditioning: {method}")
    wide = {"gaussian": int(4 * float(params.get("sigma", 1.0)) + 0.5), "bilateral": max(5, 2 * int(np.ceil(3 * float(params.get("sigma_spatial", 2.0)))) + 1) // 2}
    halo = max(K.halo_of(name, **params), wide.get(name, 0))
    return by_tile(v, ["_v"], lambda a: {out: K.condition(a, name, **params)}, halo, f"{out} double", tile)


def thin(df: DataFrame, mask: str, out: str = "thin", tile: int = SIDE, steps: int | None = None, fresh: str | None = None) -> DataFrame:
    """Rows with ``out``: the pixel is on the skeleton of the mask, as ``kernels.thin`` makes it of the whole image.

    Thinning removes pixels by their neighbours, two pixels far in a step at most.  Only pixels of the mask are moved; a round does ``steps``
    steps (STEPS, or what a narrow tile allows) on tiles with twice as wide a halo.  A tile rests after a round in whose last step neither it nor
    a neighbour has lost a pixel: the next step would find what the last one found, and a change further off can't cross a tile in a round.
    ``fresh`` names the pixels by which the mask differs from one that was thin: tiles with none in reach rest from the start.
    """
    steps = min(STEPS, tile // 2) if steps is None else steps
    halo = 2 * steps
    if halo > tile:
        raise ValueError("the halo of a round must not be wider than a tile")
    tall = max(tile, TALL) if tile == SIDE else tile
    cell = lambda c, n: F.floor(F.col(c) / n).cast("int")
    step = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    around = lambda t: t.select("img", step("own_y"), "own_x").select("img", "own_y", step("own_x")).distinct().withColumn("wakes", F.lit(True))
    own = [cell("y", tall).alias("own_y"), cell("x", tile).alias("own_x")]
    place = [F.col(k).cast(t) for k, t in zip(KEYS, ("string", "int", "int"), strict=True)]
    left = df.where(F.col(mask)).select(*place, *own, F.lit(True).alias("live"))
    if fresh is not None:
        waking = around(df.where(F.col(fresh)).select("img", *own).distinct())
        left = left.drop("live").join(waking, ["img", "own_y", "own_x"], "left").select(*KEYS, "own_y", "own_x", F.coalesce("wakes", F.lit(False)).alias("live"))
    left = materialize(left, "thin")

    def run(t: pa.Table) -> pa.Table:
        y, x = t["y"].to_numpy(), t["x"].to_numpy()
        mine = (y // tall == t["ty"][0].as_py()) & (x // tile == t["tx"][0].as_py())
        j, i = y - y.min(), x - x.min()  # nothing is masked beyond
        m = np.zeros((j.max() + 1, i.max() + 1), bool)
        m[j, i] = True
        before = K.thin(m, steps - 1) if steps > 1 else m
        after = K.thin(before, 1)
        held = t.select(["img", "y", "x"]).filter(pa.array(mine))
        n, at = len(held), (j[mine], i[mine])
        for name, v in (("own_y", np.full(n, t["ty"][0].as_py(), np.int32)), ("own_x", np.full(n, t["tx"][0].as_py(), np.int32)), ("on", after[at]), ("late", (before & ~after)[at])):
            held = held.append_column(name, pa.array(v))
        return held

    while True:
        awake = left.where("live").select("img", F.col("own_y").alias("ty"), F.col("own_x").alias("tx")).distinct()
        near = dealt(left.select(*KEYS), halo, tile, tall).join(awake, ["img", "ty", "tx"], "left_semi")
        near = near.repartition(tasks(near.sparkSession), "img", "ty", "tx")
        moved = materialize(near.groupBy("img", "ty", "tx").applyInArrow(run, "img string, y int, x int, own_y int, own_x int, on boolean, late boolean"), "thin")
        stay = left.where("NOT live").select(*KEYS, "own_y", "own_x").union(moved.where("on").select(*KEYS, "own_y", "own_x"))
        changed = moved.where("late").select("img", "own_y", "own_x").distinct()
        if not changed.limit(1).count():
            break
        was, left = left, materialize(stay.join(around(changed), ["img", "own_y", "own_x"], "left").select(*KEYS, "own_y", "own_x", F.coalesce("wakes", F.lit(False)).alias("live")), "thin")
        del awake, near, stay, changed
        release(was, moved)
    return df.join(stay.select(*KEYS, F.lit(True).alias("_on")), list(KEYS), "left").withColumn(out, F.coalesce("_on", F.lit(False))).drop("_on")


def spread(pixels: DataFrame, region: Column, halo: int, tile: int = TILE) -> DataFrame:
    """img, ty, tx, y, x, v, on: the pixels of the tiles that meet the region and of their halos."""
    p = pixels.select(*KEYS, clip01(F.col("v").cast("double")).alias("v"), region.alias("on"))
    cell = lambda c, off=0: F.floor((F.col(c) + off) / tile).cast("int")
    wanted = p.where("on").select("img", cell("y").alias("ty"), cell("x").alias("tx")).distinct()
    around = lambda c: F.explode(F.sequence(cell(c, -halo), cell(c, halo)))
    return p.withColumn("ty", around("y")).withColumn("tx", around("x")).join(wanted, ["img", "ty", "tx"], "left_semi")


def conditioned_region(pixels: DataFrame, region: Column, method: str, tile: int = TILE, **params: Any) -> DataFrame:
    """``pixels`` (img, y, x, v in [0,1], dense) with ``out``: the filtered value inside the region, v elsewhere.

    Feathering the region's seam with the original would change nothing, as pixels outside keep their values.
    """
    if method.lower() == "none":
        return pixels.withColumn("out", clip01(F.col("v").cast("double")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        y, x = f["y"].to_numpy(), f["x"].to_numpy()
        a = np.zeros((int(np.ptp(y)) + 1, int(np.ptp(x)) + 1))
        a[y - y.min(), x - x.min()] = f["v"]
        made = K.condition(a, method, **params)[y - y.min(), x - x.min()]
        mine = f["on"].to_numpy(bool) & (y // tile == f["ty"].iloc[0]) & (x // tile == f["tx"].iloc[0])
        return pd.DataFrame({"img": f["img"].iloc[0], "y": y[mine], "x": x[mine], "out": np.clip(made[mine], 0, 1)})

    made = spread(pixels, region, K.halo_of(method, **params), tile).groupBy("img", "ty", "tx").applyInPandas(run, "img string, y int, x int, out double")
    return pixels.join(made, list(KEYS), "left").withColumn("out", F.coalesce("out", clip01(F.col("v").cast("double"))))


def share_read(pixels: DataFrame, region: Column, method: str, tile: int = TILE, **params: Any) -> DataFrame:
    """img, share: the part of each image's pixels that the filter reads."""
    read = spread(pixels, region, K.halo_of(method, **params), tile).select(*KEYS).distinct().groupBy("img").agg(F.count("*").alias("n"))
    return pixels.groupBy("img").agg(F.count("*").alias("all")).join(read, "img", "left").select("img", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("share"))
