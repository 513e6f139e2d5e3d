"""Scoring a stream against a frozen background.

The background (sorted values and counts below them) is fitted once on a static table and never updated by the stream, so a
record's surprisal does not depend on when it arrives.  Windowed counts of surprising records are kept with a watermark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.information import exact_quantiles, finite, running


class Background:
    """Sorted background values with the number of background rows below each, and that of all."""

    def __init__(self, values: np.ndarray, below: np.ndarray, total: int, eps: float = 1e-9):
        self.values, self.below, self.total, self.eps = np.asarray(values, float), np.asarray(below, np.int64), int(total), eps

    @classmethod
    def fit(cls, df: DataFrame, value: str, quantile: float = 0.60, max_values: int = 250_000) -> Background:
        """All rows count.  Up to ``max_values`` different values are kept as they are; of more, the first of each run of equal shares of rows,
        which puts a value's place off by a max_values-th of the rows at most."""
        cut = exact_quantiles(df, {value: [quantile]})[value][0]
        every = df.where(finite(F.col(value))).select(F.col(value).cast("double").alias("v"))
        below = every.where(F.col("v") <= F.lit(cut))
        if below.limit(100).count() < 100:
            below = every
        counts = below.groupBy("v").agg(F.count("*").alias("n"))
        ranked, before = running(counts, "v", F.col("n"), 64)
        ranked = ranked.select("v", "n", before.alias("at"))
        size = ranked.agg(F.count("*").alias("values"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        if size["values"] > max_values:
            step = -(-size.n // max_values)
            ranked = ranked.groupBy(F.floor(F.col("at") / step).alias("share")).agg(F.min("v").alias("v"), F.min("at").alias("at"))
        got = ranked.select("v", "at").orderBy("v").toPandas()  # at most max_values + 1 rows
        return cls(got["v"].to_numpy(), got["at"].to_numpy(), size.n)

    def bits(self, x: np.ndarray) -> np.ndarray:
        place = np.append(self.below, self.total)[np.searchsorted(self.values, x, "left")]
        tail = (self.total - place + 1) / (self.total + 1)
        return np.where(np.isfinite(x), -np.log2(np.maximum(tail, self.eps)) + 0.0, np.nan)


def score(df: DataFrame, value: str, background: Background, out: str = "bits") -> DataFrame:
    """Static or streaming rows with the surprisal of a value."""
    sent = df.sparkSession.sparkContext.broadcast(background)  # at most max_values pairs of numbers

    @F.pandas_udf("double")
    def bits(x: pd.Series) -> pd.Series:
        return pd.Series(sent.value.bits(x.to_numpy(float)))

    return df.withColumn(out, bits(F.col(value).cast("double")))


def surprising(df: DataFrame, time: str, bits: str, least: float, window: str = "1 hour", late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Records and surprising records by window; late ones count until the watermark passes."""
    return df.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"), F.count_if(F.col(bits) >= least).alias("surprising"))


def read_files(spark, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
