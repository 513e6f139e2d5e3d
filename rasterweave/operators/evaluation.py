"""Threshold-sweep evaluation with spatial tolerance.

A sweep is not run threshold by threshold.  A prediction at threshold t is correct if its score is t or more and it lies within
the tolerance of a truth pixel; a truth pixel is found if the best score around it is t or more.  So one pass makes three
lists of scores (all, correct, best around truth), and each threshold's counts are suffix sums over score bins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .information import EPS, exact_quantiles, finite, running
from .ordering import group_quantiles, laid_out
from .morphology import dilate
from .raster import KEYS
from .storage import few, materialize, written
from .tiles import SIDE, by_tile


def prf(mp: Column, npred: Column, mg: Column, ngt: Column, beta: float = 1.0) -> tuple[Column, Column, Column]:
    p, r = mp / F.greatest(npred, F.lit(1)), mg / F.greatest(ngt, F.lit(1))
    b2 = beta * beta
    return p, r, (1 + b2) * p * r / F.greatest(b2 * p + r, F.lit(EPS))


def tolerant_counts(df: DataFrame, pred: str, gt: str, tol: int = 2, by: Sequence[str] = ("img",)) -> DataFrame:
    """by, mp, npred, mg, ngt of binary maps."""
    d = dilate(dilate(df, pred, tol, "_dp"), gt, tol, "_dg")
    return d.groupBy(*by).agg(F.count_if(F.col(pred) & F.col("_dg")).alias("mp"), F.count_if(pred).alias("npred"), F.count_if(F.col(gt) & F.col("_dp")).alias("mg"), F.count_if(gt).alias("ngt"))


def threshold_probs(n: int) -> list[float]:
    return [0.01] if n == 1 else [0.01 + (0.995 - 0.01) * i / (n - 1) for i in range(n)]


def thresholds(df: DataFrame, score: str, n: int = 99) -> list[float]:
    """Distinct quantiles of the pooled finite scores."""
    q = exact_quantiles(df, {score: threshold_probs(n)})[score]
    return sorted({v for v in q if v is not None}) or [0.0]


def prepared(df: DataFrame, score: str, gt: str, tol: int | Column = 2, max_tol: int | None = None) -> DataFrame:
    """img, kind (all, correct, truth), s.  ``tol`` may be a column (an image's own radius, at most ``max_tol``).  Tiles are as wide as the
    tolerance asks for, and the best scores around are found along the tile's lines, so no pixel meets each pixel around it.  Without a
    tolerance rows need no place (documents have none) and stay where they are."""
    own = isinstance(tol, Column)
    r = max_tol if own else tol
    s = F.col(score)
    ok = finite(s)
    kind = lambda name, when, value: F.when(when, F.struct(F.lit(name).alias("kind"), F.col(value).alias("s")))
    if not own and not int(r or 0):
        bare = df.select("img", F.when(ok, s.cast("double")).alias("_s"), F.coalesce(F.col(gt), F.lit(False)).alias("_gt")).where("_s IS NOT NULL")
        each = F.array(kind("all", F.lit(True), "_s"), kind("correct", F.col("_gt"), "_s"), kind("truth", F.col("_gt"), "_s"))
        return bare.select("img", F.explode(F.array_compact(each)).alias("_e")).select("img", "_e.*")
    shown = df.select(*KEYS, F.when(ok, s.cast("double")).otherwise(0.0).alias("_s"), ok.alias("_ok"), F.coalesce(F.col(gt), F.lit(False)).alias("_gt"), *([tol.cast("double").alias("_tol")] if own else []))

    def run(s, ok, gt, tols=None):
        within = int(tols.max()) if own else int(r or 0)  # an image has one
        return {"_near": K.most_within(np.where(ok, s, -np.inf), within), "_dg": K.most_within(np.where(gt, 1.0, -np.inf), within) > 0}

    side = max(SIDE, 1 << int(2 * (r or 0)).bit_length())  # a halo makes a tile no more than twice as long
    met = by_tile(shown, ["_s", "_ok", "_gt", *(["_tol"] if own else [])], run, int(r or 0), "_near double, _dg boolean", side, keep=["_s", "_ok", "_gt"])
    each = F.array(kind("all", F.col("_ok"), "_s"), kind("correct", F.col("_ok") & F.col("_dg"), "_s"), kind("truth", F.col("_gt") & (F.col("_near") > float("-inf")), "_near"))
    return met.select("img", F.explode(F.array_compact(each)).alias("_e")).select("img", "_e.*")


def counted(prep: DataFrame, truths: DataFrame, cuts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, all, correct, truth, ngt; ``cuts`` holds by and a sorted array ``t``, ``truths`` by and ``ngt``."""
    by, cuts = list(by), few(cuts, "cuts")
    most = cuts.agg(F.max(F.size("t"))).first()[0] or 0
    under = sum((F.coalesce((F.get("t", F.lit(i)) <= F.col("s")).cast("int"), F.lit(0)) for i in range(most)), F.lit(0))
    # without by, cuts is one row
    binned = (prep.join(cuts, by) if by else prep.crossJoin(F.broadcast(cuts))).withColumn("bin", under)
    counts = binned.groupBy(*by, "bin").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("all", "correct", "truth")])
    full = cuts.select(*by, F.posexplode("t").alias("i", "threshold"))
    cond = [full[c] == counts[c] for c in by]
    joined = full.join(counts, [*cond, counts["bin"] > full["i"]], "left").groupBy(*[full[c] for c in by], "threshold").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("all", "correct", "truth")])
    return joined.join(truths, by) if by else joined.crossJoin(F.broadcast(truths))


_COUNTS = ("correct", "all", "truth", "ngt")


def curve(prep: DataFrame, truths: DataFrame, cuts: DataFrame, by: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """by, threshold, precision, recall, f of what is ``counted``."""
    p, r, f = prf(*[F.col(c) for c in _COUNTS], beta)
    return counted(prep, truths, cuts, by).select(*by, "threshold", p.alias("precision"), r.alias("recall"), f.alias("f"))


def pr_curve(df: DataFrame, score: str, gt: str, tol: int | Column = 2, n_thresholds: int = 99, beta: float = 1.0, max_tol: int | None = None, prep: DataFrame | None = None) -> DataFrame:
    """Pooled over all images; ``prep`` is what ``prepared`` makes, if it is there (and ``df`` a table then)."""
    if prep is None:
        df = written(df, "scored")
        prep = prepared(df, score, gt, tol, max_tol)
    spark = df.sparkSession
    cuts = spark.createDataFrame([(thresholds(df, score, n_thresholds),)], "t array<double>")
    return curve(prep, df.agg(F.count_if(gt).alias("ngt")), cuts, (), beta)


def _cuts(df: DataFrame, by: Sequence[str], score: str, n_thresholds: int) -> DataFrame:
    """by, t: each group's own thresholds."""
    q = group_quantiles(df, by, {score: threshold_probs(n_thresholds)}, True)
    return q.select(*by, F.array_sort(F.array_distinct(score)).alias("t"))


def image_best(df: DataFrame, score: str, gt: str, tol: int | Column = 2, n_thresholds: int = 99, beta: float = 1.0, shared: Sequence[float] | None = None, max_tol: int | None = None, prep: DataFrame | None = None) -> DataFrame:
    """img, best f over the image's own thresholds (or shared ones)."""
    if prep is None:
        df = written(df, "scored")
        prep = prepared(df, score, gt, tol, max_tol)
    if shared is None:
        cuts = _cuts(df, ["img"], score, n_thresholds)
    else:
        cuts = df.select("img").distinct().withColumn("t", F.lit([float(v) for v in shared]))
    c = curve(prep, df.groupBy("img").agg(F.count_if(gt).alias("ngt")), cuts, ("img",), beta)
    return c.groupBy("img").agg(F.max("f").alias("best_f"))


def best_f1(df: DataFrame, score: str, gt: str, tol: int | Column = 2, n_thresholds: int = 60) -> DataFrame:
    """img, best_f1: each image by itself, over its own thresholds."""
    return image_best(df, score, gt, tol, n_thresholds).withColumnRenamed("best_f", "best_f1")


def average_precision(c: DataFrame) -> DataFrame:
    """AP: trapezoid under the precision envelope; a curve has at most as many rows as thresholds."""
    w = Window.orderBy("recall", "threshold")
    env = c.withColumn("p", F.max("precision").over(w.rowsBetween(0, Window.unboundedFollowing)))
    ends = env.select("recall", "threshold", "p").withColumn("pr", F.lag("recall").over(w)).withColumn("pp", F.lag("p").over(w))
    first = F.when(F.col("pr").isNull(), F.col("recall") * F.col("p")).otherwise((F.col("recall") - F.col("pr")) * (F.col("p") + F.col("pp")) / 2)
    tail = F.max_by(F.struct("recall", "p"), F.struct("recall", "threshold"))
    return ends.agg(F.sum(first).alias("a"), tail.alias("z")).select((F.col("a") + (1 - F.col("z.recall")) * F.col("z.p") / 2).alias("AP"))


def roc_auc(df: DataFrame, score: str, gt: str, n_buckets: int = 64) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; null where a class is missing."""
    c = materialize(df.groupBy(F.col(score).alias("s")).agg(F.count_if(gt).alias("p"), F.count_if(~F.col(gt)).alias("n")), "values")
    ranked, below = running(c, "s", F.col("n"), n_buckets)
    pos, neg = F.sum("p").cast("double"), F.sum("n").cast("double")
    return ranked.agg(F.when((pos > 0) & (neg > 0), F.sum(F.col("p") * (below + F.col("n") / 2.0)) / (pos * neg)).alias("ROC_AUC"))


def benchmark(df: DataFrame, score: str, gt: str, tol: int | Column = 2, n_thresholds: int = 99, beta: float = 1.0, max_tol: int | None = None, shared_ois: bool = False, prep: DataFrame | None = None) -> DataFrame:
    """One row: ODS with its threshold, precision and recall, OIS, AP, R50, ROC_AUC, n_thresholds."""
    if prep is None:
        df = written(df, "scored")
        prep = materialize(prepared(df, score, gt, tol, max_tol), "prepared")
    c = pr_curve(df, score, gt, tol, n_thresholds, beta, max_tol, prep)
    best = F.max_by(F.struct("f", "threshold", "precision", "recall"), F.struct(F.col("f"), -F.col("threshold")))
    ods = c.agg(best.alias("b"), F.coalesce(F.max(F.when(F.col("precision") >= 0.5, F.col("recall"))), F.lit(0.0)).alias("R50"))
    shared = thresholds(df, score, n_thresholds) if shared_ois else None
    ois = image_best(df, score, gt, tol, n_thresholds, beta, shared, max_tol, prep).agg(F.avg("best_f").alias("OIS"))
    # all one row
    out = ods.crossJoin(ois).crossJoin(average_precision(c)).crossJoin(roc_auc(df, score, gt))
    return out.select(F.col("b.f").alias("ODS"), F.col("b.threshold").alias("ODS_threshold"), F.col("b.precision").alias("ODS_precision"), F.col("b.recall").alias("ODS_recall"), "OIS", "AP", "R50", "ROC_AUC", F.lit(n_thresholds).alias("n_thresholds"))


def image_tolerance(df: DataFrame, frac_diag: float = 0.0075) -> tuple[DataFrame, int]:
    """Rows with ``tol``, the image's own radius from its diagonal, and the largest one."""
    size = df.groupBy("img").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    size = size.select("img", F.greatest(F.lit(1), F.rint(F.sqrt(F.col("h").cast("double") ** 2 + F.col("w").cast("double") ** 2) * frac_diag).cast("int")).alias("tol"))
    most = size.agg(F.max("tol")).first()[0] or 1
    return df.join(few(size, "tolerances"), "img"), most


def variable_tolerance(df: DataFrame, score: str, gt: str, n_thresholds: int = 61, frac_diag: float = 0.0075) -> DataFrame:
    """As ``benchmark`` with each image's own tolerance and shared thresholds; with F0.5 beside F1.

    Thresholds are shared, so what is counted by image adds up to the pooled curve, and both betas read the same counts: scores are cut once."""
    d, most = image_tolerance(written(df, "scored"), frac_diag)
    shared = thresholds(d, score, n_thresholds)
    truths = d.groupBy("img").agg(F.count_if(gt).alias("ngt"))
    cuts = truths.select("img", F.lit(shared).alias("t"))
    each = materialize(counted(prepared(d, score, gt, F.col("tol"), most), truths, cuts, ("img",)), "counted")
    summed = each.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    lines = df.sparkSession.createDataFrame([(t,) for t in shared], "threshold double")
    p, r, f = prf(*[F.coalesce(c, F.lit(0)) for c in _COUNTS])
    h = prf(*[F.coalesce(c, F.lit(0)) for c in _COUNTS], 0.5)[2]
    c = lines.join(summed, "threshold", "left").select("threshold", p.alias("precision"), r.alias("recall"), f.alias("f"), h.alias("h"))
    best = F.max_by(F.struct("f", "threshold", "precision", "recall"), F.struct(F.col("f"), -F.col("threshold")))
    ods = c.agg(best.alias("b"), F.coalesce(F.max(F.when(F.col("precision") >= 0.5, F.col("recall"))), F.lit(0.0)).alias("R50"), F.max("h").alias("F05_ODS"))
    ois = each.groupBy("img").agg(F.max(f).alias("f"), F.max(h).alias("h")).agg(F.avg("f").alias("OIS"), F.avg("h").alias("F05_OIS"))
    # all one row
    out = ods.crossJoin(ois).crossJoin(average_precision(c)).crossJoin(roc_auc(d, score, gt))
    return out.select(F.col("b.f").alias("ODS"), F.col("b.threshold").alias("ODS_threshold"), F.col("b.precision").alias("ODS_precision"), F.col("b.recall").alias("ODS_recall"), "OIS", "AP", "R50", "ROC_AUC", F.lit(n_thresholds).alias("n_thresholds"), "F05_ODS", "F05_OIS")


def benchmark_by(df: DataFrame, score: str, gt: str, by: Sequence[str], tol: int = 2, n_thresholds: int = 99, beta: float = 1.0) -> DataFrame:
    """``benchmark`` for each group of whole images (a configuration, say), all groups in one plan."""
    df = written(df, "scored")
    by, name = list(by), F.concat_ws("/", *by, "img")
    keyed = df.withColumns({"_one": F.col("img"), "img": name})
    groups = few(keyed.select("img", *by).distinct(), "groups")
    prep = materialize(prepared(keyed, score, gt, tol).join(groups, "img"), "prepared")
    pooled = curve(prep, df.groupBy(*by).agg(F.count_if(gt).alias("ngt")), _cuts(df, by, score, n_thresholds), by, beta)
    best = F.max_by(F.struct("f", "threshold", "precision", "recall"), F.struct(F.col("f"), -F.col("threshold")))
    ods = pooled.groupBy(*by).agg(best.alias("b"), F.coalesce(F.max(F.when(F.col("precision") >= 0.5, F.col("recall"))), F.lit(0.0)).alias("R50"))
    w = Window.partitionBy(*by).orderBy("recall", "threshold")
    env = pooled.withColumn("p", F.max("precision").over(w.rowsBetween(0, Window.unboundedFollowing))).select(*by, "recall", "threshold", "p")
    env = env.withColumns({"pr": F.lag("recall").over(w), "pp": F.lag("p").over(w)})
    first = F.when(F.col("pr").isNull(), F.col("recall") * F.col("p")).otherwise((F.col("recall") - F.col("pr")) * (F.col("p") + F.col("pp")) / 2)
    ap = env.groupBy(*by).agg(F.sum(first).alias("a"), F.max_by(F.struct("recall", "p"), F.struct("recall", "threshold")).alias("z")).select(*by, (F.col("a") + (1 - F.col("z.recall")) * F.col("z.p") / 2).alias("AP"))
    own = curve(prep, keyed.groupBy(*by, "img").agg(F.count_if(gt).alias("ngt")), _cuts(keyed, [*by, "img"], score, n_thresholds), [*by, "img"], beta)
    ois = own.groupBy(*by, "img").agg(F.max("f").alias("f")).groupBy(*by).agg(F.avg("f").alias("OIS"))
    c = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(gt).alias("p"), F.count_if(~F.col(gt)).alias("n"))
    pos, neg = F.sum("p").cast("double"), F.sum("n").cast("double")
    auc = laid_out(c, by, ["s"], F.col("n")).groupBy(*by).agg(F.when((pos > 0) & (neg > 0), F.sum(F.col("p") * (F.col("_before") + F.col("n") / 2.0)) / (pos * neg)).alias("ROC_AUC"))
    out = ods.join(ois, by).join(ap, by).join(auc, by)
    return out.select(*by, F.col("b.f").alias("ODS"), F.col("b.threshold").alias("ODS_threshold"), F.col("b.precision").alias("ODS_precision"), F.col("b.recall").alias("ODS_recall"), "OIS", "AP", "R50", "ROC_AUC", F.lit(n_thresholds).alias("n_thresholds"))


def point_curve(counts: DataFrame, by: Sequence[str], point: Sequence[str], beta: float = 1.0) -> DataFrame:
    """by, ODS, its point, OIS, AP from binary maps: counts hold by, point, img, mp, npred, mg, ngt.

    A point is a setting that takes the place of a threshold: a threshold before postprocessing, a pair of Canny thresholds.
    """
    by, point = list(by), list(point)
    c = [F.col(k) for k in ("mp", "npred", "mg", "ngt")]
    each = counts.withColumn("f", prf(*c, beta)[2]).groupBy(*by, "img").agg(F.max("f").alias("f")).groupBy(*by).agg(F.avg("f").alias("OIS"))
    pooled = counts.groupBy(*by, *point).agg(*[F.sum(k).alias(k) for k in ("mp", "npred", "mg", "ngt")])
    p, r, f = prf(*c, beta)
    pooled = pooled.select(*by, *point, p.alias("precision"), r.alias("recall"), f.alias("f"))
    w = Window.partitionBy(*by).orderBy("recall", *point)
    env = pooled.withColumn("p", F.max("precision").over(w.rowsBetween(0, Window.unboundedFollowing))).withColumns({"pr": F.lag("recall").over(w)})
    env = env.withColumn("pp", F.lag("p").over(w))
    first = F.when(F.col("pr").isNull(), F.col("recall") * F.col("p")).otherwise((F.col("recall") - F.col("pr")) * (F.col("p") + F.col("pp")) / 2)
    ap = env.groupBy(*by).agg(F.sum(first).alias("a"), F.max_by(F.struct("recall", "p"), F.struct("recall", *point)).alias("z")).select(*by, (F.col("a") + (1 - F.col("z.recall")) * F.col("z.p") / 2).alias("AP"))
    best = pooled.groupBy(*by).agg(F.max_by(F.struct("f", "precision", "recall", *point), F.struct("f", *[-F.col(k) for k in point])).alias("b"))
    return best.join(each, by).join(ap, by).select(*by, F.col("b.f").alias("ODS"), F.col("b.precision").alias("ODS_precision"), F.col("b.recall").alias("ODS_recall"), *[F.col(f"b.{k}").alias(k) for k in point], "OIS", "AP")
