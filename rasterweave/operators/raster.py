"""Stencils on rasters in long form (image, y, x, value).

3x3 stencils need two windows, along rows and then along columns, after which the nine values are one array on
the row and any stencil is an expression.  Wider separable filters gather, for each pixel, the few values under the stencil by a bounded
window along each axis, so time is linear in the pixels.  Work is keyed by
(image, row) and (image, column), so one image spreads over many tasks.  ``reflect`` borders repeat the edge
pixel (half-sample symmetric).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import few

KEYS = ("img", "y", "x")


def nine(df: DataFrame, col: str = "v", out: str = "n9", border: str = "reflect", fill: float = 0.0) -> DataFrame:
    """The 3x3 neighbourhood as an array, row by row (index 4 is the pixel)."""
    rows, cols = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    c = F.col(col)
    side = (lambda n: F.coalesce(n, c)) if border == "reflect" else (lambda n: F.coalesce(n, F.lit(fill)))
    df = df.withColumn("_r", F.array(side(F.lag(c).over(rows)), c, side(F.lead(c).over(rows))))
    r = F.col("_r")
    edge = r if border == "reflect" else F.array(*[F.lit(fill)] * 3)
    return df.withColumn(out, F.concat(F.coalesce(F.lag(r).over(cols), edge), r, F.coalesce(F.lead(r).over(cols), edge))).drop("_r")


def weigh(n9: Column, weights: Sequence[float]) -> Column:
    """Correlate the neighbourhood with nine weights."""
    out = None
    for i, w in enumerate(weights):
        if w:
            t = n9[i] * float(w)
            out = t if out is None else out + t
    return out


# The classical 3x3 kernels, x and y (y down), row by row.
KERNELS = {
    "sobel": ([-1, 0, 1, -2, 0, 2, -1, 0, 1], [-1, -2, -1, 0, 0, 0, 1, 2, 1]),
    "scharr": ([-3, 0, 3, -10, 0, 10, -3, 0, 3], [-3, -10, -3, 0, 0, 0, 3, 10, 3]),
    "prewitt": ([-1, 0, 1, -1, 0, 1, -1, 0, 1], [-1, -1, -1, 0, 0, 0, 1, 1, 1]),
    "roberts": ([0, 0, 0, 0, 1, 0, 0, 0, -1], [0, 0, 0, 0, 0, 1, 0, -1, 0]),
}
LAPLACE = [0, 1, 0, 1, -4, 1, 0, 1, 0]


def gradient(n9: Column, name: str = "sobel") -> tuple[Column, Column]:
    kx, ky = KERNELS[name]
    return weigh(n9, kx), weigh(n9, ky)


def magnitude(n9: Column, name: str) -> Column:
    """Detector response up to a constant factor, which normalisation cancels."""
    if name == "laplacian":
        return F.abs(weigh(n9, LAPLACE))
    if name not in KERNELS:
        raise ValueError(f"unknown detector: {name}")
    gx, gy = gradient(n9, name)
    return F.sqrt(gx * gx + gy * gy)


def median3(n9: Column) -> Column:
    return F.sort_array(n9)[4]


def box3(n9: Column) -> Column:
    return F.aggregate(n9, F.lit(0.0), lambda a, b: a + b) / 9.0


def range3(n9: Column) -> Column:
    return F.array_max(n9) - F.array_min(n9)


def diffuse(n9: Column, kappa: float = 0.10, gamma: float = 0.15) -> Column:
    """One step of exponential anisotropic diffusion from a neighbourhood (with wrapped borders for the classical form)."""
    c = n9[4]
    flow = None
    for i in (1, 3, 5, 7):
        d = n9[i] - c
        t = F.exp(-F.pow(d / kappa, F.lit(2.0))) * d
        flow = t if flow is None else flow + t
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c + gamma * flow))


def suppress(n9: Column, theta: Column, inner: Column, compat: bool = True) -> Column:
    """Non-maximum suppression across the direction theta; plateaus stay, the image's frame goes to zero.

    ``compat`` keeps the classical four bins as they are commonly coded, which swap the two diagonals for y down;
    otherwise diagonals follow the direction.
    """
    a = F.pmod(F.degrees(theta) + 180.0, F.lit(180.0))
    pairs = [(3, 5), (2, 6), (1, 7), (0, 8)] if compat else [(3, 5), (0, 8), (1, 7), (2, 6)]
    s = n9[4]
    keep = [(s >= n9[i]) & (s >= n9[j]) for i, j in pairs]
    best = F.when((a < 22.5) | (a >= 157.5), keep[0]).when(a < 67.5, keep[1]).when(a < 112.5, keep[2]).otherwise(keep[3])
    return F.when(best & inner, s).otherwise(0.0)


def inner(df: DataFrame) -> DataFrame:
    """_inner: not on the image's frame."""
    size = few(df.groupBy("img").agg(F.max("y").alias("_h"), F.max("x").alias("_w")), "sizes")
    df = df.join(size, "img")
    return df.withColumn("_inner", (F.col("y") > 0) & (F.col("x") > 0) & (F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w"))).drop("_h", "_w")


def gaussian_kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> list[float]:
    """Sampled Gaussian of radius int(truncate * sigma + 0.5), or its first or second derivative, for correlation."""
    r = int(truncate * sigma + 0.5)
    g = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    g = [v / sum(g) for v in g]
    s2 = sigma * sigma
    if order == 0:
        return g
    if order == 1:
        return [v * i / s2 for v, i in zip(g, range(-r, r + 1), strict=True)]
    return [v * (i * i / s2 - 1) / s2 for v, i in zip(g, range(-r, r + 1), strict=True)]


def _along(df: DataFrame, col: str, along: str, fold, border: str, r0: int, r1: int) -> DataFrame:
    """``col`` as fold(its neighbours -r0..r1 along an axis); each pixel holds as many values as the stencil is wide."""
    line = Window.partitionBy("img", "y" if along == "x" else "x")
    order = line.orderBy(along)
    near = F.collect_list(F.struct(F.col(col).alias("v"))).over(order.rowsBetween(-r0, r1))
    df = df.withColumns({"_near": near, "_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(line).cast("int")})
    i, n = F.col("_i"), F.col("_n")

    def place(k: Column) -> Column:
        if border == "nearest":
            return F.least(n - 1, F.greatest(F.lit(0), i + k))
        p = F.pmod(i + k, 2 * n)
        return F.when(p < n, p).otherwise(2 * n - 1 - p)

    # a place beyond the border falls back into what the frame holds
    values = F.transform(F.lit(list(range(-r0, r1 + 1))), lambda k: F.get(F.col("_near"), place(k) - F.greatest(F.lit(0), i - r0))["v"])
    return df.withColumn(col, fold(values)).drop("_near", "_i", "_n")


def separable(df: DataFrame, col: str, kernel_y: Sequence[float], kernel_x: Sequence[float], out: str, border: str = "reflect") -> DataFrame:
    """img, y, x, out: a separable correlation."""
    df = df.select("img", "y", "x", F.col(col).alias(out))
    for along, k in (("x", kernel_x), ("y", kernel_y)):
        r = len(k) // 2
        w = F.lit([float(v) for v in k])
        dot = lambda n, w=w: F.aggregate(F.zip_with(n, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        df = _along(df, out, along, dot, border, r, len(k) - 1 - r)
    return df.select(*KEYS, out)


def gaussian(df: DataFrame, col: str, sigma: float, out: str, order: tuple[int, int] = (0, 0), border: str = "reflect") -> DataFrame:
    """Gaussian smoothing or derivative, order by (y, x)."""
    return separable(df, col, gaussian_kernel(sigma, order[0]), gaussian_kernel(sigma, order[1]), out, border)


def box(df: DataFrame, col: str, size: int, out: str, fold: str = "mean", border: str = "reflect") -> DataFrame:
    """Mean, max or min over a square of ``size`` (even sizes reach one further back)."""
    df = df.select("img", "y", "x", F.col(col).alias(out))
    folds = {"mean": lambda n: F.aggregate(n, F.lit(0.0), lambda a, b: a + b) / float(size), "max": F.array_max, "min": F.array_min}
    for along in ("x", "y"):
        df = _along(df, out, along, folds[fold], border, size // 2, size - 1 - size // 2)
    return df.select(*KEYS, out)


def box_std(df: DataFrame, col: str, size: int, out: str = "std") -> DataFrame:
    """Local standard deviation over a square."""
    a = box(df, col, size, "_m")
    b = box(df.withColumn("_sq", F.col(col) * F.col(col)), "_sq", size, "_m2")
    return a.join(b, list(KEYS)).select(*KEYS, F.sqrt(F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0))).alias(out))


def hessian_max(df: DataFrame, col: str, sigma: float, out: str = "hess") -> DataFrame:
    """Largest absolute eigenvalue of the Gaussian Hessian."""
    xx, yy, xy = gaussian(df, col, sigma, "xx", (0, 2)), gaussian(df, col, sigma, "yy", (2, 0)), gaussian(df, col, sigma, "xy", (1, 1))
    d = xx.join(yy, list(KEYS)).join(xy, list(KEYS))
    tr, half = (F.col("xx") + F.col("yy")) / 2, (F.col("xx") - F.col("yy")) / 2
    disc = F.sqrt(half * half + F.col("xy") * F.col("xy"))
    return d.select(*KEYS, F.greatest(F.abs(tr + disc), F.abs(tr - disc)).alias(out))


def coherence(df: DataFrame, gx: str, gy: str, size: int, out: str = "coherence") -> DataFrame:
    """Structure-tensor coherence over a square, in [0,1]."""
    t = df.select(*KEYS, (F.col(gx) * F.col(gx)).alias("a"), (F.col(gy) * F.col(gy)).alias("b"), (F.col(gx) * F.col(gy)).alias("c"))
    s = box(t, "a", size, "sa").join(box(t, "b", size, "sb"), list(KEYS)).join(box(t, "c", size, "sc"), list(KEYS))
    num = F.sqrt(F.pow(F.col("sa") - F.col("sb"), F.lit(2.0)) + 4 * F.col("sc") * F.col("sc"))
    return s.select(*KEYS, F.least(F.lit(1.0), num / (F.col("sa") + F.col("sb") + 1e-12)).alias(out))
