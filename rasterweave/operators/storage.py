"""Cutting lineage by way of the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table (a row an image or group, say) that may be sent to all tasks.
FEW = 20_000

#: Used only on one machine whose session names no shared folder (tests).
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a cluster's session must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return FALLBACK_DIR


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: later steps start from files, not from the plan so far."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._is_table, back._path = True, path
    return back


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote and nothing reads any more.  Rounds leave them (and shuffle files, which Spark deletes only
    when the driver's garbage is collected), so that without it the disk holds as many copies of the data as there were rounds."""
    for t in tables:
        if path := getattr(t, "_path", None):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself where it is what ``materialize`` gave, else the written table."""
    return df if getattr(df, "_is_table", None) is True else materialize(df, name)


def few(df: DataFrame, name: str) -> DataFrame:
    """The written table, sent to all tasks if it has few rows: what joins it then keeps its place and is not gathered by a few keys."""
    t = materialize(df, name)
    return F.broadcast(t) if t.limit(FEW + 1).count() <= FEW else t


def tasks(spark: SparkSession) -> int:
    """Tasks for work that is heavy for its bytes: pixels take few, so that by size alone a large table would come to a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
