"""Sources and sinks: manifests, rasters as files, annotations, models, ranked tables, resumable chunks."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernels import gray
from ..operators.ordering import laid_out

MANIFEST = "case string, seed int, image string, ground_truth string"
MANIFEST_V2 = (
    "n int, seed int, primitive string, angle double, contrast double, noise string, noise_level double, blur double, motion int, illumination double, texture double, "
    "gap_length int, family string, motion_angle double, gap_contrast_factor double, severity double, split string, id string"
)


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def rows_between(df: DataFrame, order: str, start: int, stop: int | None = None) -> DataFrame:
    """Rows start..stop by an order: a positional split; places come from ranges, so no task holds the table."""
    out = laid_out(df, (), [order]).where(F.col("_before") >= start)
    return (out if stop is None else out.where(F.col("_before") < stop)).drop("_before", "_all")


# ---- PNG, 8 or 16 bits, without a library


def decode_png(raw: bytes) -> np.ndarray:
    """A PNG's samples (rows, columns, channels if several); palettes are looked up."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, palette = 8, b"", None
    w = h = depth = kind = 0
    while at < len(raw):
        size, name = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if name == b"IHDR":
            w, h, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", body)
            if lace or depth not in (8, 16):
                raise ValueError("interlaced or packed PNGs are not read")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data += body
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    step = channels * depth // 8
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h, w * step), np.uint8)
    above = np.zeros(w * step, int)
    for y in range(h):
        f, line = lines[y, 0], lines[y, 1:].astype(int)
        if f == 1:
            line = np.cumsum(line.reshape(w, step), 0).ravel()
        elif f == 2:
            line = line + above
        elif f in (3, 4):
            for i in range(len(line)):
                a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                if f == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - c
                    p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
                line[i] = (line[i] + p) & 255
        above = line & 255
        out[y] = above
    a = out if depth == 8 else out.view(">u2").astype(np.uint16)
    a = a.reshape(h, w, channels)
    if palette is not None and kind == 3:
        a = palette[a[..., 0]]
    return a[..., 0] if a.shape[-1] == 1 else a


def encode_png(img: np.ndarray) -> bytes:
    """8-bit gray or RGB."""
    a = np.ascontiguousarray(img, np.uint8)
    h, w = a.shape[:2]
    kind = 0 if a.ndim == 2 else 2
    lines = b"".join(b"\0" + a[y].tobytes() for y in range(h))
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def read_images(spark: SparkSession, path: str, glob: str = "*.png", truth: bool = False) -> DataFrame:
    """img (file name without its ending), y, x and v (gray in [0,1]) or, for truth masks, gt (first channel over half its range)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return decoded(files.select(stem.alias("img"), F.col("content").alias("png")), truth)


def decoded(images: DataFrame, truth: bool = False) -> DataFrame:
    """img, y, x and v or gt of encoded images (img, png)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["img"], f["png"], strict=True):
                a = decode_png(raw)
                first = a[..., 0] if a.ndim == 3 else a
                v = first > np.iinfo(a.dtype).max / 2 if truth else gray(a if a.ndim == 2 or a.shape[-1] > 2 else first)
                y, x = np.indices(v.shape)
                yield pd.DataFrame({"img": name, "y": y.ravel(), "x": x.ravel(), "gt" if truth else "v": v.ravel()})

    return images.select("img", "png").mapInPandas(run, f"img string, y int, x int, {'gt boolean' if truth else 'v double'}")


def read_decoded(spark: SparkSession, path: str) -> DataFrame:
    """img, y, x, v as ``read_images``, of any files that Spark's image source decodes (JPEG, PNG, BMP, GIF); others are left out."""
    files = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, h, w, channels, raw in f.itertuples(index=False):
                a = np.frombuffer(raw, np.uint8).reshape(h, w, channels)
                v = gray(a[..., 0] if channels == 1 else a[..., 2::-1])  # stored blue first
                y, x = np.indices(v.shape)
                yield pd.DataFrame({"img": p.rsplit("/", 1)[-1].rsplit(".", 1)[0], "y": y.ravel(), "x": x.ravel(), "v": v.ravel()})

    return files.mapInPandas(run, "img string, y int, x int, v double")


def images_as_png(pixels: DataFrame, col: str = "v") -> DataFrame:
    """img, png: one encoded image a row, from values in [0,1] or booleans."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(f["y"].max()) + 1, int(f["x"].max()) + 1))
        a[f["y"], f["x"]] = f[col].astype(float)
        return pd.DataFrame({"img": [f["img"].iloc[0]], "png": [encode_png(np.rint(np.clip(a, 0, 1) * 255))]})

    return pixels.select("img", "y", "x", col).groupBy("img").applyInPandas(run, "img string, png binary")


def dense(pixels: DataFrame, col: str = "v") -> DataFrame:
    """img, h, w, data: row-major arrays."""
    g = pixels.groupBy("img").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.sort_array(F.collect_list(F.struct("y", "x", col))).alias("p"))
    return g.select("img", "h", "w", F.transform("p", lambda s: s[col]).alias("data"))


def long(images: DataFrame, out: str = "v") -> DataFrame:
    e = images.select("img", "w", F.posexplode("data").alias("i", out))
    return e.select("img", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), out)


# ---- annotations, pairs, models


def consensus(annotations: DataFrame, least: float = 0.5) -> DataFrame:
    """img, y, x, prob, gt: the share of annotators that mark a pixel, and whether it is enough."""
    return annotations.groupBy("img", "y", "x").agg(F.avg(F.col("boundary").cast("double")).alias("prob")).withColumn("gt", F.col("prob") >= least)


def _mat_elements(raw: bytes, at: int, end: int, order: str) -> Iterator[tuple[int, bytes]]:
    while at + 8 <= end:
        tag = struct.unpack_from(order + "I", raw, at)[0]
        if tag >> 16:  # small element: size and type share a word
            yield tag & 0xFFFF, raw[at + 4 : at + 4 + (tag >> 16)]
            at += 8
            continue
        size = struct.unpack_from(order + "I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if tag == 15:
            z = zlib.decompress(body)
            yield from _mat_elements(z, 0, len(z), order)
        else:
            yield tag, body
        at += 8 + size + (-size % 8 if tag != 15 else 0)


_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _mat_arrays(body: bytes, order: str) -> Iterator[np.ndarray]:
    """All numeric matrices inside a MATLAB 5 matrix element, cells and structs walked."""
    parts = list(_mat_elements(body, 0, len(body), order))
    if len(parts) < 3:
        return
    kind, shape = struct.unpack_from(order + "I", parts[0][1])[0] & 0xFF, np.frombuffer(parts[1][1], order + "i4")
    if 6 <= kind <= 15:
        t, data = parts[3] if len(parts) > 3 else (2, b"")
        if t in _MAT_TYPES:
            yield np.frombuffer(data, order + _MAT_TYPES[t])[: int(np.prod(shape))].reshape(shape, order="F")
    else:
        for t, p in parts[2:]:
            if t == 14:
                yield from _mat_arrays(p, order)


def boundaries(raw: bytes) -> list[np.ndarray]:
    """Annotators' boundary maps in a MATLAB 5 file: the matrices over 20x20 with a few values within [0,1]."""
    order = "<" if raw[126:128] == b"IM" else ">"
    found = [a for t, body in _mat_elements(raw, 128, len(raw), order) if t == 14 for a in _mat_arrays(body, order)]
    return [a.astype(float) for a in found if a.ndim == 2 and min(a.shape) > 20 and len(u := np.unique(a)) <= 4 and u.min() >= 0 and u.max() <= 1]


def read_annotations(spark: SparkSession, path: str, glob: str = "*.mat") -> DataFrame:
    """img, annotator, y, x, boundary of MATLAB annotation files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, raw in zip(f["path"], f["content"], strict=True):
                for k, a in enumerate(boundaries(raw)):
                    y, x = np.indices(a.shape)
                    yield pd.DataFrame({"img": p.rsplit("/", 1)[-1].rsplit(".", 1)[0], "annotator": k, "y": y.ravel(), "x": x.ravel(), "boundary": a.ravel()})

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInPandas(run, "img string, annotator int, y int, x int, boundary double")


def read_pairs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """pos, image, truth of a JSON list of pairs."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("pos", "p"))
    t = t.select("pos", F.col("p")[0].alias("image"), F.col("p")[1].alias("truth")).orderBy("pos")
    return t if limit is None else t.limit(limit)


def read_model(spark: SparkSession, path: str) -> Any:
    """A JSON model, small."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def json_safe(o: Any) -> Any:
    if isinstance(o, dict):
        return {str(k): json_safe(v) for k, v in o.items()}
    if isinstance(o, (list, tuple, set, np.ndarray)):
        return [json_safe(v) for v in (sorted(o) if isinstance(o, set) else o)]
    if isinstance(o, np.generic):
        o = o.item()
    return None if isinstance(o, float) and not math.isfinite(o) else o


def write_model(spark: SparkSession, model: Any, path: str) -> None:
    spark.createDataFrame([(json.dumps(json_safe(model), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as CSV with a header under its name."""
    for name, df in tables.items():
        write_table(df, f"{folder.rstrip('/')}/{name}")


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def write_chunks(spark: SparkSession, path: str, total: int, size: int, make: Callable[[int, int], DataFrame]) -> list[tuple[int, int]]:
    """Write make(start, stop) for each chunk that is not there yet; the chunks written now."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    for start in range(0, total, size):
        stop = min(total, start + size)
        part = f"{path}/chunk={start:08d}_{stop:08d}"
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(part + "/_SUCCESS")):
            make(start, stop).write.mode("overwrite").parquet(part)
            done.append((start, stop))
    return done


def ranked(df: DataFrame, keys: Sequence[str], ties: Sequence[str], k: int | None = None) -> DataFrame:
    out = df.orderBy(*[F.desc(c) for c in keys], *ties)
    return out if k is None else out.limit(k)
