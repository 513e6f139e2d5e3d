"""Exact Euclidean distance maps, linear in the pixels, with lines as keys.

Along a column the nearest place of the mask is the last one before or the first one after (windows).  Along a row each pixel then has a
parabola, its column's squared distance at its own place, and the distance is the lower envelope of the row's parabolas: a row of the
image is one array, and one pass over it keeps the parabolas that are lowest somewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import KEYS


def envelope(x: np.ndarray, height: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least of (at - x)**2 + height at each place, both ascending; infinite without parabolas."""
    if not len(x):
        return np.full(len(at), np.inf)
    xs, hs = x.tolist(), height.tolist()
    kept, begins = [0], [-np.inf]
    for k in range(1, len(xs)):
        while True:
            j = kept[-1]
            meet = (hs[k] + xs[k] ** 2 - hs[j] - xs[j] ** 2) / (2 * (xs[k] - xs[j]))
            if meet > begins[-1]:
                break
            kept.pop()
            begins.pop()
        kept.append(k)
        begins.append(meet)
    own = np.array(kept)[np.searchsorted(np.array(begins), at, "right") - 1]
    return (at - x[own]) ** 2 + height[own]


def distance(df: DataFrame, mask: str, out: str = "distance") -> DataFrame:
    """Rows with ``out``: the distance to the nearest pixel of the mask in the image; infinite where it has none."""
    on = F.when(F.col(mask), F.col("y"))
    column, back = (Window.partitionBy("img", "x").orderBy(o) for o in ("y", F.desc("y")))  # a frame that ends with the line is summed anew for each row
    above = F.col("y") - F.last(on, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.last(on, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("y")
    near = df.select("img", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.least(above, below).cast("long").alias("g"))
    lines = near.groupBy("img", "y").agg(F.sort_array(F.collect_list(F.struct("x", "g"))).alias("line"))
    lines = lines.select("img", "y", F.col("line.x").alias("x"), F.col("line.g").alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for x, g in zip(b.column(2), b.column(3), strict=True):
                x, g = np.asarray(x.values, np.int64), g.values
                has = np.flatnonzero(np.asarray(g.is_valid()))
                g = np.asarray(g.fill_null(0), np.int64)
                made.append(np.sqrt(envelope(x[has], g[has] ** 2, x).astype(float)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.list_(pa.float64()))], names=["img", "y", "x", "d"])

    met = lines.mapInArrow(run, "img string, y int, x array<int>, d array<double>").select("img", "y", F.explode(F.arrays_zip("x", "d")).alias("p"))
    return df.join(met.select("img", "y", "p.x", F.col("p.d").alias(out)).hint("merge"), list(KEYS))
