"""All registered queries of the engine, with their SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_fuzzy, queries_learning, queries_raster, queries_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries_fuzzy.Q, **queries_raster.Q, **queries_learning.Q, **queries_tables.Q}
ORACLE_SQL: dict[str, str] = {**queries_fuzzy.SQL, **queries_raster.SQL, **queries_learning.SQL, **queries_tables.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_roi"](spark, sf_dir)
