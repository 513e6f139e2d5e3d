"""Shared pieces of the training-data operators: tables, the shared folder, Arrow text buffers.

Words, unless an operator says otherwise, are runs of bytes other than the six ASCII white-space
bytes (0x20, 0x09-0x0D) of a text's UTF-8 form; ``bytes.split()`` cuts at exactly those.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine whose session names no shared folder (tests).
FALLBACK_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a cluster's session must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return FALLBACK_DIR


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for t in tables:
        jvm, spark = t.sparkSession._jvm, t.sparkSession
        where = jvm.org.apache.hadoop.fs.Path(t._kept_at)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


BATCH_BYTES = 4 << 20
ROW_GROUP_BYTES = 16 << 20
READ_ROWS = 256


def settings(spark: SparkSession) -> dict[str, str]:
    """What lets a batch of texts on its way to Python, and a row group on its way to a file, hold at most so many bytes, and a batch read
    from a file so many rows (rows are long, and their buffers grow by doubling)."""
    out = {"parquet.block.size": str(ROW_GROUP_BYTES), "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS)}
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    return out if spark.conf.get(key, None) is None else out | {key: f"{BATCH_BYTES}b"}


def bounded(spark: SparkSession) -> SparkSession:
    """A session with ``settings`` and all else that ``spark`` has set; tables are read with the settings of the session that opens them, and
    ``spark`` keeps its own."""
    own = spark.newSession()
    for key, value in (spark.conf.getAll | settings(spark)).items():
        if key in settings(spark) or own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def private(names: Sequence[str], *wanted: str) -> list[str]:
    """``wanted`` with underscores put before them until none is among ``names`` (case aside, as Spark compares them)."""
    taken = {n.lower() for n in names}
    lead = "_"
    while any((lead + w).lower() in taken for w in wanted):
        lead += "_"
    return [lead + w for w in wanted]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary array; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def each_text(column: pa.Array) -> Iterator[bytes]:
    """Each value as bytes, one at a time; a null is empty."""
    offsets, data = utf8(column)
    raw = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(raw[a:b])


def texts(column: pa.Array) -> list[bytes]:
    return list(each_text(column))


try:
    _libc = ctypes.CDLL(ctypes.util.find_library("c"))
    _trim = _libc.malloc_trim
    _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays over 1 MB go back to the system as soon as they are freed
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def tidy() -> None:
    """Give a finished task's free memory back to the system; Spark keeps its Python workers for later stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
