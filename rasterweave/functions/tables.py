"""Table functions: one row or one line of a raster to many rows, callable from SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import lit, udtf
from pyspark.sql.types import DoubleType, IntegerType, NumericType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class RasterRuns:
    """raster_runs(TABLE(pixels), threshold): img, y, x_from, x_to, total of each run of neighbouring pixels of a line that are not under it.

    The table needs the columns img, y, x and v; ``analyze`` asks for its lines as partitions, in the order of x, so the call need not.
    """

    @staticmethod
    def analyze(pixels: AnalyzeArgument, threshold: AnalyzeArgument) -> AnalyzeResult:
        if not pixels.isTable:
            raise ValueError("raster_runs: the first argument must be a table")
        held = {f.name.lower(): f.dataType for f in pixels.dataType.fields}
        missing = [c for c in ("img", "y", "x", "v") if c not in held]
        if missing:
            raise ValueError(f"raster_runs: the table lacks {', '.join(missing)}")
        if not isinstance(held["v"], NumericType):
            raise ValueError("raster_runs: v must be a number")
        if threshold.isTable or threshold.value is None:
            raise ValueError("raster_runs: the threshold must be a constant")
        schema = StructType().add("img", held["img"]).add("y", held["y"]).add("x_from", IntegerType()).add("x_to", IntegerType()).add("total", DoubleType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("img"), PartitioningColumn("y")], orderBy=[OrderingColumn("x")])

    def __init__(self) -> None:
        self.run: list | None = None

    def eval(self, pixel, threshold) -> Iterator[tuple]:
        x, v = pixel["x"], pixel["v"]
        bright = v is not None and v >= float(threshold)
        if self.run and (not bright or x != self.run[3] + 1):
            yield tuple(self.run)
            self.run = None
        if bright:
            if self.run:
                self.run[3] = x
                self.run[4] += float(v)
            else:
                self.run = [pixel["img"], pixel["y"], x, x, float(v)]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


raster_runs = udtf(RasterRuns, useArrow=True)


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL under their names."""
    spark.udtf.register("raster_runs", raster_runs)


def runs(pixels: DataFrame, threshold: float) -> DataFrame:
    return raster_runs(pixels.select("img", "y", "x", "v").asTable(), lit(float(threshold)))
