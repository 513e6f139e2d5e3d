"""Experiment drivers: configurations crossed with images, scored, evaluated together and ranked.

Maps that need whole images are made once an image (group map) and shared by all configurations; gates, regions and
thresholds are columns.  Selection on validation images is the only thing that the driver decides on; test images are
evaluated with what was selected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import context as C
from ..operators import edges as ED
from ..operators import evaluation as E
from ..operators import kernels as K
from ..operators import linking as L
from ..operators import morphology as MO
from ..operators import raster as R
from ..operators import tiles as T
from ..operators.choquet import integral
from ..operators.information import collapse_scales, hard_gate, percentile_confidence, robust01, soft_gate
from ..operators.multiscale import features, refine
from ..operators.raster import KEYS
from . import sweep
from ..operators.storage import materialize


def rank(df: DataFrame, k: int = 100, keys: Sequence[str] = ("ODS", "AP", "OIS"), ties: Sequence[str] = ("config",)) -> DataFrame:
    return sweep.rank(df, keys, ties, k)


def mfi(pixels: DataFrame, scales: Sequence[int] = (9, 5, 3), mode: str = "oriented", **options: Any) -> DataFrame:
    """img, y, x, v, gt, conf: the multiscale score as a rank within its image."""
    feats = materialize(features(pixels, scales, mode), "features")
    bits = materialize(collapse_scales(refine(feats, scales, len(K.MODES[mode]), **{"f1": "CL", "f2": "CL", **options}), KEYS), "bits")
    conf = percentile_confidence(bits, "final_bits", ["y", "x"], by=["img"])
    return materialize(pixels.join(conf.select(*KEYS, "conf").hint("merge"), list(KEYS)), "mfi")


def _plain(v, detectors, sigma):
    """Detectors before they are scaled, and the gradient's direction."""
    return {d: K.raw_detector(v, d, sigma) for d in detectors} | {"theta": K.orientation(v)}


def detector_maps(pixels: DataFrame, detectors: Sequence[str], sigma: float = 1.0, thin: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """img, y, x, gt, extra and one column for each detector, suppressed along its direction if ``thin``."""

    halo = int(4 * max(sigma, 1.0) + 0.5) + 3
    made = T.by_tile(pixels, ["v"], lambda v: _plain(v, detectors, sigma), halo, ", ".join(f"{d} double" for d in detectors) + ", theta double", keep=["gt", *extra])
    made = robust01(made, detectors, by=["img"])
    if thin:
        made = R.inner(made)
        for d in detectors:
            made = R.nine(made, d, "_n9").withColumn(d, R.suppress(F.col("_n9"), F.col("theta"), F.col("_inner"))).drop("_n9")
    return made.select(*KEYS, *detectors, "gt", *extra, "theta")


def gated(maps: DataFrame, detectors: Sequence[str], qs: Sequence[float], dilations: Sequence[int], gates: Sequence[str] = ("hard", "soft")) -> DataFrame:
    """config, img, y, x, score, gt of every detector, region quantile, dilation and gate."""
    parts = []
    for q in qs:
        for d in dilations:
            roi = MO.dilate(maps.withColumn("_on", F.col("conf") >= q), "_on", d, "_roi")
            forms = {"hard": lambda s: hard_gate(F.col(s), F.col("_roi")), "soft": lambda s: soft_gate(F.col(s), F.col("_roi"), F.col("conf"))}
            rows = F.array(*[F.struct(F.lit(f"{s}_q{q:g}_d{d}_{g}").alias("config"), forms[g](s).alias("score")) for s in detectors for g in gates])
            parts.append(roi.select(*KEYS, "gt", F.explode(rows).alias("r")).select(*KEYS, "gt", "r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def classic(pixels: DataFrame, detectors: Sequence[str] = ("scharr", "sobel", "log"), qs: Sequence[float] = (0.6, 0.7, 0.8), dilations: Sequence[int] = (0, 1), n_thresholds: int = 41, **options: Any) -> DataFrame:
    """Detectors gated by multiscale regions, ranked."""
    maps = detector_maps(mfi(pixels, **options), detectors, extra=["conf"])
    return rank(E.benchmark_by(materialize(gated(maps, detectors, qs, dilations), "gated"), "score", "gt", ["config"], 2, n_thresholds))


def canny_grid(pixels: DataFrame, sigmas: Sequence[float] = (0.8, 1.2, 1.8), pairs: Sequence[tuple[float, float]] = ((0.5, 0.7), (0.6, 0.8), (0.7, 0.9), (0.8, 0.95)), qs: Sequence[float | None] = (None, 0.6), tol: int = 2, **options: Any) -> DataFrame:
    """Canny with and without a region; a pair of thresholds is a point of a configuration's curve."""
    base = mfi(pixels, **options)
    points, parts = [], []
    for q in qs:
        e = ED.edges(ED.ridges(base, "v", sigmas, None if q is None else F.col("conf") >= q), len(sigmas), pairs)
        parts.append(e.select(*KEYS, (F.col("setting") * len(pairs) + F.col("pair") + len(points)).alias("no")))
        points += [(f"q{q}_s{s:g}", float(low), float(high)) for s in sigmas for low, high in pairs]
    return rank(E.point_curve(_counts(reduce(DataFrame.union, parts), base, points, ["config", "low", "high"], tol), ["config"], ["low", "high"]))


def _counts(edges: DataFrame, truth: DataFrame, points: Sequence[tuple], names: Sequence[str], tol: int) -> DataFrame:
    """names, img, mp, npred, mg, ngt of binary maps at several points; ``edges`` holds the masked pixels with the number ``no`` of their point.

    A pixel has one row, with a bit for each point, so images are dilated once for all points (a word of 48 bits at a time, which a double holds)."""
    words = [f"_w{i}" for i in range((len(points) + 47) // 48)]
    bit = lambda no: F.call_function("shiftleft", F.lit(1).cast("long"), no.cast("int"))
    on = edges.groupBy(*KEYS).agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("no") / 48) == i, bit(F.col("no") % 48))), F.lit(0)).alias(w) for i, w in enumerate(words)])
    d = truth.select(*KEYS, F.coalesce("gt", F.lit(False)).alias("gt")).join(on, list(KEYS), "left").select(*KEYS, "gt", *[F.coalesce(w, F.lit(0)).cast("double").alias(w) for w in words])

    def run(gt, *masks):
        return {"_dg": K.dilate(gt, tol)} | {f"_d{w}": K.union_within(m.astype(np.int64), tol).astype(float) for w, m in zip(words, masks, strict=True)}

    d = T.by_tile(d, ["gt", *words], run, tol, "_dg boolean, " + ", ".join(f"_d{w} double" for w in words), keep=["gt", *words])
    d = materialize(d, "points")
    has = lambda w, no: F.col(w).cast("long").bitwiseAND(F.lit(1 << no % 48)) != 0
    out = None
    for start in range(0, len(points), 12):  # a dozen points at a time: more make code that is too long to be compiled
        some = range(start, min(start + 12, len(points)))
        aggs = []
        for i in some:
            here, near = has(words[i // 48], i), has("_d" + words[i // 48], i)
            aggs += [F.count_if(here & F.col("_dg")).alias(f"mp{i}"), F.count_if(here).alias(f"np{i}"), F.count_if(F.col("gt") & near).alias(f"mg{i}")]
        wide = d.groupBy("img").agg(*aggs, F.count_if("gt").alias("ngt"))
        rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, points[i], strict=True)], F.col(f"mp{i}").alias("mp"), F.col(f"np{i}").alias("npred"), F.col(f"mg{i}").alias("mg")) for i in some])
        part = wide.select("img", "ngt", F.explode(rows).alias("r")).select(*[f"r.{k}" for k in names], "img", "r.mp", "r.npred", "r.mg", "ngt")
        out = part if out is None else out.union(part)
    return materialize(out, "counts")


def postprocessed(maps: DataFrame, score: str, methods: Sequence[tuple[str, dict]], thresholds: Sequence[float], tol: int = 2) -> DataFrame:
    """Counts, cover and loose ends of binary maps after postprocessing, by method and threshold; maps hold score, conf, theta, gt.

    An image at a threshold is an image of its own name, so a method goes once over all of them."""
    cut = F.explode(F.lit([float(t) for t in thresholds])).alias("threshold")
    each = maps.select(F.col("img").alias("own"), "y", "x", F.col(score).alias("_score"), "conf", "theta", "gt", cut)
    each = materialize(each.withColumn("img", F.concat_ws("|", "own", "threshold")), "thresholds")
    out = None
    for name, p in methods:
        e = materialize(L.postprocess(each, "_score", F.col("threshold"), name, **p), "postprocessed")
        counts = E.tolerant_counts(e, "edge", "gt", tol, ["threshold", "own", "img"])
        met = counts.join(L.continuity(e, "edge", "gt", tol), "img")
        rows = met.select(F.lit(name).alias("config"), "threshold", F.col("own").alias("img"), "mp", "npred", "mg", "ngt", F.col("largest_component_gt_coverage").alias("coverage"), F.col("endpoint_count").cast("long").alias("ends"))
        out = rows if out is None else out.union(rows)
    return materialize(out, "postprocessed")


def conditioned(pixels: DataFrame, method: str, **params: Any) -> DataFrame:
    """``pixels`` with v filtered."""
    made = T.condition(pixels, "v", method, "_out", **params)
    return pixels.drop("v").join(made, list(KEYS)).withColumnRenamed("_out", "v")


def staged(validation: DataFrame, test: DataFrame, preconditioners: Sequence[str] = ("none", "median", "gaussian"), detector: str = "scharr", qs: Sequence[float] = (0.6,), methods: Sequence[tuple[str, dict]] = (("none", {}), ("closing", {"radius": 1}), ("geodesic", {"max_gap": 8.0, "max_mean_cost": 0.6})), n_thresholds: int = 15, **options: Any) -> dict[str, Any]:
    """Choose preconditioner, then linker and threshold, on validation images; apply them once to test images."""
    best: tuple | None = None
    stage1 = []
    for p in preconditioners:
        base = mfi(conditioned(validation, p), **options)
        maps = materialize(detector_maps(base, [detector], extra=["conf"]), "staged")
        top = rank(E.benchmark_by(gated(maps, [detector], qs, [0], ["hard"]), "score", "gt", ["config"], 2, n_thresholds), 1).first()
        stage1.append({"preconditioner": p, **top.asDict()})
        if best is None or (top.ODS, top.AP, top.OIS) > best[0]:
            best = ((top.ODS, top.AP, top.OIS), p, maps, float(top.config.split("_q")[1].split("_")[0]))
    _, chosen, maps, q = best

    def with_theta(m: DataFrame) -> DataFrame:
        return m.select(*KEYS, (F.col(detector) * (F.col("conf") >= q).cast("double")).alias("score"), "conf", "theta", "gt")

    maps = with_theta(maps)  # a view of the chosen maps, which are written
    cuts = E.thresholds(maps.where("score > 0"), "score", n_thresholds)
    linked = rank(E.point_curve(postprocessed(maps, "score", methods, cuts), ["config"], ["threshold"]), len(methods)).collect()
    method, threshold = linked[0].config, linked[0].threshold
    tested = postprocessed(with_theta(detector_maps(mfi(conditioned(test, chosen), **options), [detector], extra=["conf"])), "score", [(method, dict(methods)[method])], [threshold])
    per_image = tested.withColumn("f", E.prf(*[F.col(c) for c in ("mp", "npred", "mg", "ngt")])[2]).withColumn("config", F.lit("test"))
    return {"preconditioners": stage1, "linkers": [r.asDict() for r in linked], "chosen": {"preconditioner": chosen, "roi_q": q, "linker": method, "threshold": threshold}, "per_image": per_image, "pooled": sweep.micro(per_image, ["config"])}


def measure_bank(pixels: DataFrame, measures: Sequence[dict], window: int = 5, mode: str = "oriented", n_thresholds: int = 25, label: str | None = None, operators: Sequence[dict] | None = None) -> DataFrame:
    """Measures (times operators) as single-scale scores, ranked; the descriptors are made once."""
    return banked(described(pixels, window, mode), measures, window, mode, n_thresholds, label, operators)


def described(pixels: DataFrame, window: int = 5, mode: str = "oriented") -> DataFrame:
    """img, y, x, gt, desc, hetero, disp of a single scale: a view of a written table."""
    feats = features(pixels, [window], mode, keep=["gt"])
    return robust01(feats.withColumn("disp", M.raw_q(F.col("desc"), "dispersion")), ["hetero", "disp"], by=["img"], lo=2, hi=98)


def banked(d: DataFrame, measures: Sequence[dict], window: int = 5, mode: str = "oriented", n_thresholds: int = 25, label: str | None = None, operators: Sequence[dict] | None = None) -> DataFrame:
    """``measure_bank`` of what is ``described``."""
    n = len(K.MODES[mode])
    context = {"heterogeneity": F.col("hetero"), "dispersion": F.col("disp"), "raster": True}
    some = operators or [{"operator": "CF1F2_CL_CL", "family": "CF1F2", "F1": "CL", "F2": "CL"}]
    one = lambda m, o: integral(F.col("desc"), n, o["family"], f=o.get("F") or "TP", f1=o.get("F1") or "TP", f2=o.get("F2") or "TL", spec=m, scale=window, label=label, context=context)
    rows = F.array(*[F.struct(F.lit(f"{m['name']}|{o['operator']}").alias("config"), one(m, o).alias("score")) for m in measures for o in some])
    long = materialize(d.select(*KEYS, "gt", F.explode(rows).alias("r")).select(*KEYS, "gt", "r.*"), "bank")
    return E.benchmark_by(long, "score", "gt", ["config"], 2, n_thresholds)


# The competition's scales, region quantiles, and sums of Sugeno densities.
SCALES = (25, 13, 7, 5, 3)
REGION_QS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85)
SUMS = (0.6, 0.8, 1.0, 1.2, 1.4)
TOGETHER = 3  # measures that a group works on: each group makes the image's descriptors anew


def prepared_images(pixels: DataFrame) -> DataFrame:
    """img, y, x, v after a median filter, gt, oracle: the image's context, or the coarse one that its name ends in."""
    if "oracle" not in pixels.columns:
        pixels = pixels.withColumn("oracle", sweep.coarse_context(F.substring_index("img", "_", -1)))
    return materialize(conditioned(pixels, "median").select(*KEYS, "v", "gt", "oracle"), "prepared")


def contexts(images: DataFrame) -> DataFrame:
    """img, oracle, c0 to c5: descriptors of the whole image."""
    made = C.context_vectors(images).select("img", *[F.col(c).alias(f"c{i}") for i, c in enumerate(C.NAMES)])
    return made.join(images.select("img", "oracle").distinct(), "img")


def competing(fit: DataFrame, scales: Sequence[int], mode: str) -> dict[str, dict[str, Any]]:
    """The learned measures: global ones, and banks by scale and by context (oracle and estimated)."""
    from ..operators import learning as LN

    n = len(K.MODES[mode])

    truth = MO.dilate(fit.select(*KEYS, "gt", "oracle"), "gt", 1, "_truth").select(*KEYS, "oracle", F.col("_truth").cast("double").alias("truth"))
    d = features(fit, scales, mode).join(truth, list(KEYS))
    d = d.select("img", "oracle", F.col("truth").alias("y"), F.xxhash64("img", "y", "x").alias("id"), F.col("scale").cast("string").alias("scale"), F.col("desc").alias("x"))
    d = materialize(d, "competition")
    groups = [r.oracle for r in d.select("oracle").distinct().orderBy("oracle").collect()]

    def pool(part: DataFrame, most: int, seed: int) -> DataFrame:
        maps = part.select("img", "scale").distinct().count()
        some = LN.balanced_sample(part, max_samples=max(500, most // max(maps, 1)), seed=seed, by=["img", "scale"])
        return materialize(some.orderBy(F.xxhash64(F.lit(seed), "id", "scale"), "id", "scale").limit(most), "pool")

    every = pool(d, 30_000, 123)
    learned: dict[str, dict[str, Any]] = {"additive_learned": LN.learn_additive(every, n)}
    learned |= {f"sugeno_learned_sum{s:.2f}": LN.learn_sugeno(every, n, target_sum=s) for s in SUMS}
    learned["2additive_learned"] = LN.learn_two_additive(every, n)
    learned["full_capacity_learned"] = LN.learn_full(pool(d, 10_000, 321), n)
    by_scale = {str(s): pool(d.where(F.col("scale") == str(s)), 12_000, 1000 + i) for i, s in enumerate(scales)}
    by_context = {g: pool(d.where(F.col("oracle") == g), 14_000, 2000 + i) for i, g in enumerate(groups)}
    for name, learn in (("additive", LN.learn_additive), ("2additive", LN.learn_two_additive)):
        default = learned[f"{name}_learned"]
        learned[f"scale_{name}_learned"] = {"kind": "scale_router", "measures": {k: learn(p, n) for k, p in by_scale.items()}, "default": default}
        bank = {k: learn(p, n) for k, p in by_context.items()}
        for routing in ("oracle", "estimated"):
            learned[f"context_{name}_{routing}"] = {"kind": "context_router", "measures": bank, "default": default, "routing": routing}
    return learned


def gated_by_measure(images: DataFrame, pairs: Sequence[tuple[dict, Sequence[float]]], scales: Sequence[int], mode: str) -> DataFrame:
    """measure, roi_q, img, h, w, at, score, gt_at, coverage, fraction: suppressed gradients inside each measure's regions, of which only the
    few pixels that are not zero are kept (their numbers and values, and the numbers of the true ones).

    ``images`` holds img, y, x, v, gt, oracle, estimated.  An image under TOGETHER measures is a group, which makes the descriptors scale by scale
    and holds those of one scale.
    """
    parts = -(-len(pairs) // TOGETHER)

    def run(t: pa.Table) -> pa.Table:
        v, gt = K.to_raster(t.select(["y", "x", "v", "gt"]).to_pandas(), ["v", "gt"])
        gt, rows = gt.astype(bool), []
        mine = pairs[t["_part"][0].as_py() :: parts]
        labels = [t[spec["routing"]][0].as_py() if "routing" in spec else None for spec, _ in mine]
        so_far: list[tuple] = [(None, None)] * len(mine)
        for s in scales:
            x, _, hetero = K.descriptors(v, int(s), mode)
            so_far = [K.refined(x, hetero, int(s), spec, label, *was) for (spec, _), label, was in zip(mine, labels, so_far, strict=True)]
        edges, near = K.suppress(K.detector(v, "scharr"), K.orientation(v)), K.dilate(gt, 1)
        for (spec, qs), (_, bits) in zip(mine, so_far, strict=True):
            conf = K.ordinal(bits)
            for q in qs:
                roi = conf >= q
                score = (edges * roi).ravel()
                at = np.flatnonzero(score)
                rows.append((spec["name"], float(q), t["img"][0].as_py(), *v.shape, at.astype(np.int32), score[at], np.flatnonzero(gt).astype(np.int32), float((roi & near).sum() / max(near.sum(), 1)), float(roi.mean())))
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)

    made = pa.schema([("measure", pa.string()), ("roi_q", pa.float64()), ("img", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("at", pa.list_(pa.int32())), ("score", pa.list_(pa.float64())), ("gt_at", pa.list_(pa.int32())), ("coverage", pa.float64()), ("fraction", pa.float64())])
    each = images.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return each.groupBy("img", "_part").applyInArrow(run, "measure string, roi_q double, img string, h int, w int, at array<int>, score array<double>, gt_at array<int>, coverage double, fraction double")


def compared(maps: DataFrame, tol: int = 2, n_thresholds: int = 41) -> DataFrame:
    """The benchmark of each measure and region quantile: a group holds the images of one split."""
    names = ["ODS", "ODS_threshold", "ODS_precision", "ODS_recall", "OIS", "AP", "R50", "ROC_AUC"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("img")
        some = []
        for r in f.itertuples():
            score, gt = np.zeros(r.h * r.w), np.zeros(r.h * r.w, bool)
            score[r.at], gt[r.gt_at] = r.score, True
            some.append((score.reshape(r.h, r.w), gt.reshape(r.h, r.w)))
        m = K.benchmark(some, E.threshold_probs(n_thresholds), tol)
        return pd.DataFrame([(f["measure"].iloc[0], f["roi_q"].iloc[0], *[m[k] for k in names], f["coverage"].mean(), f["fraction"].mean())], columns=["measure", "roi_q", *names, "roi_gt_coverage", "roi_fraction"])

    return maps.groupBy("measure", "roi_q").applyInPandas(run, "measure string, roi_q double, " + ", ".join(f"{k} double" for k in [*names, "roi_gt_coverage", "roi_fraction"]))


def competition(spark: SparkSession, fit: DataFrame, select: DataFrame, test: DataFrame, scales: Sequence[int] = SCALES, mode: str = "oriented", top: int = 10, n_thresholds: int = 41, qs: Sequence[float] = REGION_QS) -> tuple[DataFrame, DataFrame]:
    """Learn measures on some images, rank all measures (each with its best region quantile) on others, evaluate the best on test images: (selection, test)."""
    from ..operators import learning as LN

    fit = prepared_images(fit)
    specs = {m["name"]: m for m in M.registry(len(K.MODES[mode]), competing(fit, scales, mode))}
    known = materialize(contexts(fit), "contexts")
    cols = [f"c{i}" for i in range(6)]
    centroids, spread = LN.fit_centroids(known, "oracle", cols)

    def labelled(pixels: DataFrame) -> DataFrame:
        images = prepared_images(pixels)
        told = LN.nearest_centroid(contexts(images), "img", "oracle", centroids, spread, cols).select("img", F.col("predicted").alias("estimated"))
        return images.join(told, "img")

    maps = gated_by_measure(labelled(select), [(s, qs) for s in specs.values()], scales, mode)
    scored = materialize(compared(materialize(maps, "competition-maps"), 2, n_thresholds), "competition-scores")
    best = F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("ODS"), F.desc("AP"), F.desc("OIS"), "roi_q"))
    ranked = rank(scored.withColumn("_r", best).where("_r = 1").drop("_r"), top, ties=("measure",))
    chosen = ranked.select("measure", "roi_q", "selection_rank").collect()
    tested = compared(gated_by_measure(labelled(test), [(specs[r.measure], [r.roi_q]) for r in chosen], scales, mode), 2, n_thresholds)
    return ranked, tested.join(F.broadcast(spark.createDataFrame([(r.measure, r.selection_rank) for r in chosen], "measure string, selection_rank int")), "measure")  # top rows


def factorial(spark: SparkSession, pixels: DataFrame, path: str, operators: Sequence[dict], measures: Sequence[dict], chunk: int = 8, **options: Any) -> list[tuple[int, int]]:
    """Operators times measures in resumable chunks of operators; the chunks written now.  All chunks read the same descriptors, which the first one that
    is not there yet makes."""
    from ..sources.files import write_chunks

    shape = {k: options[k] for k in ("window", "mode") if k in options}
    shared = cache(lambda: described(pixels, **shape))
    return write_chunks(spark, path, len(operators), chunk, lambda a, z: banked(shared(), measures, operators=operators[a:z], **options))


def region_cost(pixels: DataFrame, method: str = "bilateral", q: float = 0.7) -> DataFrame:
    """img, share of pixels that filtering the region reads, mean absolute difference inside the region to filtering the whole image."""
    on = F.col("conf") >= q
    whole = T.condition(pixels, "v", method, "_whole")
    part = T.conditioned_region(pixels.select(*KEYS, "v", "conf"), on, method).join(whole, list(KEYS))
    gap = part.groupBy("img").agg(F.coalesce(F.avg(F.when(on, F.abs(F.col("_whole") - F.col("out")))), F.lit(0.0)).alias("difference"))
    return T.share_read(pixels, on, method).join(gap, "img").select("img", F.coalesce("share", F.lit(0.0)).alias("share"), "difference")
