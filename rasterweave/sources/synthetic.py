"""Deterministic test rasters: analytic shapes, degradations and exact edges.

Configurations are drawn on the driver (a handful of numbers each); images are made on the executors from their
configuration and seed alone, so any lost image is made again the same.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernels import convolve, dilate, gaussian
from ..operators.storage import few

PIXELS = "img string, y int, x int, v double, gt boolean"
# The benchmark's primitives and families, in their order.
PRIMITIVES = ["line", "stripe", "circle", "ellipse", "rectangle", "triangle", "sine", "multi", "tjunction"]
FAMILIES = ["clean", "gaussian", "saltpepper", "speckle", "blur", "motion", "illumination", "texture", "gap", "compound"]
CASES = ["vertical", "diagonal", "circle", "box", "two_scale"]


def inner_edge(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Masked pixels next to unmasked ones."""
    p = np.pad(mask, 1, mode="edge")
    h, w = mask.shape
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (eight or not (dy and dx))]
    return mask & np.any([~p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in steps], 0)


def make_case(kind: str, n: int = 160, seed: int = 0, noise_var: float = 0.003) -> tuple[np.ndarray, np.ndarray]:
    """A noisy analytic shape and its exact edge."""
    y, x = np.mgrid[:n, :n]
    m, third, near = n // 2, n // 3, np.abs(y - n // 2 + 0.5) < 10
    quarter = (y >= n // 4) & (y < 3 * n // 4) & (x >= n // 4) & (x < 3 * n // 4)
    round_ = (y - m) ** 2 + (x - m) ** 2 < (n // 4) ** 2
    # Background 0.18 and the shapes' levels.
    shapes = {
        "vertical": lambda: (np.where(x >= m, 0.82, 0.18), x == m),
        "diagonal": lambda: (np.where(y > x, 0.78, 0.18), inner_edge(y > x, eight=False)),
        "circle": lambda: (np.where(round_, 0.8, 0.18), dilate(round_, 1) & dilate(~round_, 1)),
        "box": lambda: (np.where(quarter, 0.8, 0.18), inner_edge(quarter)),
        "two_scale": lambda: (np.where(near & (x >= 2 * n // 3), 0.92, np.where(x >= third, 0.65, 0.18)), (x == third) | (near & (x == 2 * n // 3))),
    }
    if kind not in shapes:
        raise ValueError(f"unknown case: {kind}")
    img, gt = shapes[kind]()
    return add_noise(img, "gaussian", noise_var, np.random.default_rng(seed)), gt


def region(primitive: str, n: int, rng: np.random.Generator, angle: float | None = None) -> np.ndarray:
    """Mask of a primitive with random proportions."""
    angle = float(rng.uniform(0, 180)) if angle is None else float(angle)
    t, c = math.radians(angle), (n - 1) / 2
    y, x = np.mgrid[:n, :n].astype(float)
    turned = lambda cy, cx: (np.cos(t) * (x - cx) + np.sin(t) * (y - cy), -np.sin(t) * (x - cx) + np.cos(t) * (y - cy))
    u, v = turned(c, c)  # along the angle, and across it
    k = n / 96
    # Ranges of the shapes' sizes in pixels of a 96-pixel image.
    size = lambda a, b: rng.uniform(a, b) * k
    ball = lambda cy, cx, r: (y - cy) ** 2 + (x - cx) ** 2 < r * r
    if primitive == "line":
        return v > 0
    if primitive == "stripe":
        return np.abs(v) < size(7, 14)
    if primitive == "circle":
        return ball(c + size(-6, 6), c + size(-6, 6), size(16, 28))
    if primitive == "ellipse":
        b, a = size(12, 22), size(22, 34)
        return (u / a) ** 2 + (v / b) ** 2 < 1
    if primitive == "rectangle":
        return (np.abs(u) < size(16, 30)) & (np.abs(v) < size(12, 24))
    if primitive == "triangle":
        r = size(22, 32)
        corners = [(-0.6 * r, -r), (-0.5 * r, r), (r, 0.0)]  # across, along
        side = [(q[1] - p[1]) * (v - p[0]) - (q[0] - p[0]) * (u - p[1]) for p, q in zip(corners, [*corners[1:], corners[0]], strict=True)]
        return np.all([d >= 0 for d in side], 0) | np.all([d <= 0 for d in side], 0)
    if primitive == "sine":
        return y > c + size(8, 15) * np.sin(2 * math.pi * x / size(35, 60) + rng.uniform(0, 2 * math.pi))
    if primitive == "multi":
        a, b = turned(c + 14 * k, c + 16 * k)
        return ball(c - 18 * k, c - 18 * k, size(10, 17)) | ((np.abs(a) < size(11, 18)) & (np.abs(b) < size(8, 15)))
    if primitive == "tjunction":
        return (u > 0) | ((v > 0) & (np.abs(u) < size(5, 9)))
    raise ValueError(f"unknown primitive: {primitive}")


def motion_kernel(length: int, angle: float) -> np.ndarray:
    """A line through the middle of an odd square, normalised."""
    k = max(3, int(length)) | 1
    c = k // 2
    s = np.linspace(-c, c, 4 * k)
    out = np.zeros((k, k))
    out[np.rint(c + s * math.sin(math.radians(angle))).astype(int), np.rint(c + s * math.cos(math.radians(angle))).astype(int)] = 1
    return out / out.sum()


def add_noise(img: np.ndarray, kind: str, level: float, rng: np.random.Generator) -> np.ndarray:
    if kind == "gaussian" and level > 0:
        img = img + rng.normal(0, math.sqrt(level), img.shape)
    elif kind == "speckle" and level > 0:
        img = img + img * rng.normal(0, math.sqrt(level), img.shape)
    elif kind == "s&p" and level > 0:
        hit, salt = rng.random(img.shape) < level, rng.random(img.shape) < 0.5
        img = np.where(hit, salt.astype(float), img)
    elif kind == "poisson":
        grades = 2.0 ** math.ceil(math.log2(max(2, len(np.unique(img)))))
        img = rng.poisson(img * grades) / grades
    return np.clip(img, 0, 1)


def make_sample(cfg: dict[str, Any]) -> tuple[np.ndarray, np.ndarray]:
    """A degraded image by its configuration, and the edge of the clean shape."""
    n, rng = int(cfg.get("n", 96)), np.random.default_rng(int(cfg["seed"]))
    m = region(cfg["primitive"], n, rng, cfg.get("angle"))
    gt, half = inner_edge(m), float(cfg.get("contrast", 0.5)) / 2
    img = np.where(m, 0.5 + half, 0.5 - half)
    y, x = np.mgrid[:n, :n]
    gap = int(cfg.get("gap_length") or 0)
    if gap and gt.any():
        spots = np.argwhere(gt)
        cy, cx = spots[int(0.52 * (len(spots) - 1))]
        weak = (y - cy) ** 2 + (x - cx) ** 2 <= (gap / 2 + 2) ** 2
        img = np.where(weak, 0.5 + (img - 0.5) * float(cfg.get("gap_contrast_factor") or 0.06), img)
    if cfg.get("illumination"):
        img = img + cfg["illumination"] * (x / (n - 1) - 0.5)
    if cfg.get("texture"):
        period, phase = rng.uniform(7, 15), rng.uniform(0, 6.28)
        img = img + cfg["texture"] * np.sin(2 * math.pi * (x * math.cos(0.7) + y * math.sin(0.7)) / period + phase)
    if cfg.get("blur"):
        img = gaussian(img, float(cfg["blur"]))
    if cfg.get("motion"):
        img = convolve(img, motion_kernel(int(cfg["motion"]), float(cfg.get("motion_angle") or 35)))
    return add_noise(np.clip(img, 0, 1), cfg.get("noise", "none"), float(cfg.get("noise_level") or 0), rng), gt


def split(name: str, n_samples: int, seed0: int, n: int = 96) -> list[dict[str, Any]]:
    """The manifest of a benchmark split: families in turn, primitives in strides, severities drawn."""
    rng, rows = np.random.default_rng(seed0), []
    for i in range(n_samples):
        fam, prim = FAMILIES[i % len(FAMILIES)], PRIMITIVES[(5 * i + i // len(FAMILIES)) % len(PRIMITIVES)]
        cfg: dict[str, Any] = {"n": n, "seed": seed0 + i, "primitive": prim, "angle": float(rng.uniform(0, 180)), "contrast": float(rng.choice([0.30, 0.40, 0.55, 0.70])), "noise": "none", "noise_level": 0.0, "blur": 0.0, "motion": 0, "illumination": 0.0, "texture": 0.0, "gap_length": 0, "family": fam, "motion_angle": None, "gap_contrast_factor": None}
        s = float(rng.choice([0.35, 0.65, 1.0]))
        # How a severity sets each family's strength.
        cfg |= {
            "clean": {},
            "gaussian": {"noise": "gaussian", "noise_level": 0.004 + 0.016 * s},
            "saltpepper": {"noise": "s&p", "noise_level": 0.006 + 0.035 * s},
            "speckle": {"noise": "speckle", "noise_level": 0.008 + 0.04 * s},
            "blur": {"blur": 0.5 + 1.5 * s},
            "motion": {"motion": round(3 + 6 * s)},
            "illumination": {"illumination": 0.10 + 0.25 * s},
            "texture": {"texture": 0.025 + 0.075 * s},
            "gap": {"gap_length": round(3 + 9 * s), "gap_contrast_factor": 0.03},
            "compound": {"noise": "gaussian", "noise_level": 0.005 + 0.01 * s, "blur": 0.5 + 0.8 * s, "texture": 0.02 + 0.04 * s, "illumination": 0.08 * s},
        }[fam]
        if fam == "motion":
            cfg["motion_angle"] = float(rng.uniform(0, 180))
        rows.append(cfg | {"severity": s, "split": name, "id": f"{name}_{i:04d}_{prim}_{fam}"})
    return rows


def oriented_step(angle: float, n: int = 96, seed: int = 123, low: float = 0.18, high: float = 0.82, noise_var: float = 0.003, blur: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A step edge at an angle in degrees; the noise is the same for all angles."""
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    t = math.radians(angle)
    m = y * math.cos(t) - x * math.sin(t) > 0  # the angle is the edge's own direction
    img = np.where(m, high, low)
    img = gaussian(img, blur) if blur else img
    return np.clip(img + np.random.default_rng(seed).normal(0, math.sqrt(noise_var), m.shape), 0, 1), inner_edge(m)


def pixels(spark: SparkSession, configs: Sequence[dict[str, Any]], maker=make_sample, key: str = "id") -> DataFrame:
    """img, y, x, v, gt of one image for each configuration, made on the executors."""
    rows = [(json.dumps(c),) for c in configs]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for cfg in map(json.loads, f["cfg"]):
                img, gt = maker(cfg)
                y, x = np.indices(img.shape)
                yield pd.DataFrame({"img": str(cfg[key]), "y": y.ravel(), "x": x.ravel(), "v": img.ravel(), "gt": gt.ravel()})

    return spark.createDataFrame(rows, "cfg string").repartition(max(1, min(len(rows), 64))).mapInPandas(run, PIXELS)


def planted(images: DataFrame, plans: DataFrame, maker: Callable[[dict[str, Any]], tuple[np.ndarray, np.ndarray]], weight: float = 0.7) -> DataFrame:
    """img, y, x, v, gt: given images (img, y, x, v in [0,1]) with a made one planted in each: ``weight`` of it, the rest the given values.

    ``plans`` (img, cfg as JSON) says what is planted where; an image with several plans comes several times, named img_id.  A task holds one
    image, so large ones are cut into blocks beforehand (``blocks``)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        cfg = json.loads(f["cfg"].iloc[0])
        y, x = f["y"].to_numpy(), f["x"].to_numpy()
        img, gt = maker(cfg | {"n": max(8, int(y.max()) + 1, int(x.max()) + 1)})
        return pd.DataFrame({"img": f["img"].iloc[0] + "_" + str(cfg["id"]), "y": y, "x": x, "v": np.clip(weight * img[y, x] + (1 - weight) * f["v"].to_numpy(), 0, 1), "gt": gt[y, x]})

    return images.select("img", "y", "x", "v").join(plans.select("img", "cfg"), "img").groupBy("img", "cfg").applyInPandas(run, PIXELS)


def blocks(images: DataFrame, side: int = 96) -> DataFrame:
    """The images cut into blocks of at most ``side`` pixels a side, named img-row-column, each from (0, 0) on."""
    cell = lambda c: F.floor(F.col(c) / side).cast("int")
    name = F.concat_ws("-", "img", cell("y"), cell("x"))
    return images.withColumns({"img": name, "y": (F.col("y") % side).cast("int"), "x": (F.col("x") % side).cast("int")})


def turned(images: DataFrame) -> DataFrame:
    """Each image in its eight turns and mirrorings, named img_0 to img_7 (the second four are mirrored); further columns go along."""
    size = images.groupBy("img").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    y, x, h, w = (F.col(c) for c in ("y", "x", "_h", "_w"))
    ways = [(y, x), (x, h - y), (h - y, w - x), (w - x, y), (y, w - x), (w - x, h - y), (h - y, x), (x, y)]
    each = F.array(*[F.struct(F.lit(i).alias("no"), a.cast("int").alias("y"), b.cast("int").alias("x")) for i, (a, b) in enumerate(ways)])
    rest = [c for c in images.columns if c not in ("img", "y", "x")]
    t = images.join(few(size, "sizes"), "img").select("img", *rest, F.explode(each).alias("t"))
    return t.select(F.concat_ws("_", "img", "t.no").alias("img"), "t.y", "t.x", *rest)


def cases(spark: SparkSession, n: int = 160) -> DataFrame:
    return pixels(spark, [{"id": k, "seed": i, "n": n} for i, k in enumerate(CASES)], lambda c: make_case(c["id"], int(c["n"]), int(c["seed"])))


def orientations(spark: SparkSession, step: int = 5, n: int = 96, **kw: Any) -> DataFrame:
    return pixels(spark, [{"id": f"angle_{a:03d}", "angle": float(a)} for a in range(0, 180, step)], lambda c: oriented_step(c["angle"], n, **kw))
