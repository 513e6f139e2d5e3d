"""Registered queries over rasters: stencils, morphology, gating, evaluation, dense kernels.

The images are event values by user and day, one for each event type; truth masks are the bright pixels moved by a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import distance as D
from ..operators import edges as ED
from ..operators import evaluation as E
from ..operators import information as I
from ..operators import kernels as K
from ..operators import linking as L
from ..operators import morphology as MO
from ..operators import raster as R
from ..operators import tiles as T
from .views import EV_SQL, ev_img

Q: dict = {}
SQL: dict[str, str] = {}
W = 30


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img, y, x, v in [0,1]."""
    return I.robust01(ev_img(spark, sf_dir), ["v"], by=["img"]).withColumn("v", F.round("v", 9))


PX = EV_SQL + ", ep AS (SELECT img, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM ev GROUP BY img), px AS (SELECT img, y, x, round(CASE WHEN hi <= lo + 1e-12 THEN 0 ELSE least(1, greatest(0, (v - lo) / (hi - lo))) END, 9) AS v FROM ev JOIN ep USING (img)), dim AS (SELECT max(y) + 1 AS h FROM px)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px with gt: the pixel a day before is bright."""
    before = F.coalesce(F.lag("v").over(Window.partitionBy("img", "y").orderBy("x")), F.lit(0.0))
    return px(spark, sf_dir).withColumn("gt", before >= 0.7)


GT = PX + ", sc AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY img, y ORDER BY x), 0) >= 0.7 AS gt FROM px)"


def _summary(df: DataFrame, col: str) -> DataFrame:
    v = F.col(col).cast("double")
    return df.groupBy("img").agg(F.count(v).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.sum(v * ((F.col("y") * 31 + F.col("x")) % 97)), 3).alias("weighted"), F.round(F.max(v), 6).alias("most"))


def _summary_sql(src: str, v: str = "v") -> str:
    return f"SELECT img, count({v}) AS n, round(sum({v}), 4) AS total, round(sum({v} * ((y * 31 + x) % 97)), 3) AS weighted, round(max({v}), 6) AS most FROM {src} GROUP BY img"


def _fold(e: str, n: str, border: str = "reflect") -> str:
    if border == "nearest":
        return f"greatest(0, least({n} - 1, {e}))"
    return f"(CASE WHEN {e} < 0 THEN -({e}) - 1 WHEN {e} >= {n} THEN 2 * {n} - 1 - ({e}) ELSE {e} END)"


def _near(kernel: dict[tuple[int, int], float], src: str, border: str = "reflect") -> str:
    """FROM clause: p a pixel, k an offset with its weight, q the neighbour."""
    values = ", ".join(f"({dy}, {dx}, {w!r}::DOUBLE)" for (dy, dx), w in kernel.items())
    return f"FROM {src} p CROSS JOIN (VALUES {values}) k(dy, dx, w) CROSS JOIN dim JOIN {src} q ON q.img = p.img AND q.y = {_fold('p.y + k.dy', 'dim.h', border)} AND q.x = {_fold('p.x + k.dx', str(W), border)}"


def _conv(name: str, src: str, kernel: dict, border: str = "reflect") -> str:
    return f"{name} AS (SELECT p.img, p.y, p.x, sum(k.w * q.v) AS v {_near(kernel, src, border)} GROUP BY p.img, p.y, p.x)"


def _three(weights) -> dict:
    return {(i // 3 - 1, i % 3 - 1): float(w) for i, w in enumerate(weights) if w}


def _outer(ky, kx) -> dict:
    ry, rx = len(ky) // 2, len(kx) // 2
    return {(i - ry, j - rx): a * b for i, a in enumerate(ky) for j, b in enumerate(kx)}


def _square(size: int) -> dict:
    return {(i - size // 2, j - size // 2): 1.0 for i in range(size) for j in range(size)}


_NINE = _square(3)

# ---- 3x3 stencils

for _name in R.KERNELS:
    _kx, _ky = R.KERNELS[_name]

    @query(f"detector_{_name}", f"WITH {PX}, {_conv('gx', 'px', _three(_kx))}, {_conv('gy', 'px', _three(_ky))}, m AS (SELECT img, y, x, sqrt(gx.v * gx.v + gy.v * gy.v) AS v FROM gx JOIN gy USING (img, y, x)) {_summary_sql('m')}")
    def _detector(spark: SparkSession, sf_dir: str, name=_name) -> DataFrame:
        return _summary(R.nine(px(spark, sf_dir)).withColumn("v", R.magnitude(F.col("n9"), name)), "v")


@query("detector_laplacian", f"WITH {PX}, {_conv('l', 'px', _three(R.LAPLACE))}, m AS (SELECT img, y, x, abs(v) AS v FROM l) {_summary_sql('m')}")
def detector_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(R.nine(px(spark, sf_dir)).withColumn("v", R.magnitude(F.col("n9"), "laplacian")), "v")


def _local(name: str, expr: Column, agg: str) -> None:
    @query(name, f"WITH {PX}, m AS (SELECT p.img, p.y, p.x, {agg} AS v {_near(_NINE, 'px')} GROUP BY p.img, p.y, p.x) {_summary_sql('m')}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _summary(R.nine(px(spark, sf_dir)).withColumn("v", expr(F.col("n9"))), "v")


_local("median3", R.median3, "list_sort(list(q.v))[5]")
_local("box3", R.box3, "avg(q.v)")
_local("range3", R.range3, "max(q.v) - min(q.v)")


@query("diffusion_step", f"WITH {PX}, m AS (SELECT p.img, p.y, p.x, least(1, greatest(0, any_value(p.v) + 0.15 * sum(exp(-power((q.v - p.v) / 0.1, 2)) * (q.v - p.v)))) AS v {_near({(-1, 0): 1.0, (1, 0): 1.0, (0, -1): 1.0, (0, 1): 1.0}, 'px')} GROUP BY p.img, p.y, p.x) {_summary_sql('m')}")
def diffusion_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(R.nine(px(spark, sf_dir)).withColumn("v", R.diffuse(F.col("n9"))), "v")


_NMS = {"(a < 22.5 OR a >= 157.5)": ("m", "l", "r"), "a < 67.5": ("m", "ur", "dl"), "a < 112.5": ("m", "u", "d"), "true": ("m", "ul", "dr")}
_PICK = ", ".join(f"max(CASE WHEN k.dy = {dy} AND k.dx = {dx} THEN q.v END) AS {n}" for n, (dy, dx) in {"l": (0, -1), "r": (0, 1), "u": (-1, 0), "d": (1, 0), "ul": (-1, -1), "ur": (-1, 1), "dl": (1, -1), "dr": (1, 1)}.items())


@query(
    "orientation_nms",
    f"""WITH {PX}, {_conv('gx', 'px', _three(R.KERNELS['sobel'][0]))}, {_conv('gy', 'px', _three(R.KERNELS['sobel'][1]))},
th AS (SELECT img, y, x, fmod(round(degrees(atan2(gy.v, gx.v)), 6) + 180.0, 180.0) AS a, round(sqrt(gx.v * gx.v + gy.v * gy.v), 6) AS v FROM gx JOIN gy USING (img, y, x)),
nb AS (SELECT p.img, p.y, p.x, any_value(p.a) AS a, any_value(p.v) AS v, {_PICK} {_near(_NINE, 'th')} GROUP BY p.img, p.y, p.x),
m AS (SELECT img, y, x, CASE WHEN y > 0 AND x > 0 AND y < h - 1 AND x < {W - 1} AND (CASE {' '.join(f'WHEN {c} THEN v >= {a} AND v >= {b}' for c, (_, a, b) in _NMS.items())} END) THEN v ELSE 0 END AS v FROM nb, dim) {_summary_sql('m')}""",
)
def orientation_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.nine(px(spark, sf_dir))
    gx, gy = R.gradient(F.col("n9"), "sobel")
    d = d.withColumns({"theta": F.radians(F.round(F.degrees(F.atan2(gy, gx)), 6)), "s": F.round(F.sqrt(gx * gx + gy * gy), 6)}).drop("n9")
    # the angle is rounded in degrees, so both engines see the same bins
    d = R.inner(R.nine(d, "s"))
    return _summary(d.withColumn("v", R.suppress(F.col("n9"), F.col("theta"), F.col("_inner"))), "v")


# ---- wider stencils


@query("gaussian_smooth", f"WITH {PX}, {_conv('g', 'px', _outer(R.gaussian_kernel(1.0), R.gaussian_kernel(1.0)), 'nearest')} {_summary_sql('g')}")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(R.gaussian(px(spark, sf_dir), "v", 1.0, "g", border="nearest"), "g")


@query("laplace_of_gaussian", f"WITH {PX}, {_conv('g', 'px', {o: a + b for (o, a), b in zip(_outer(R.gaussian_kernel(1.0, 2), R.gaussian_kernel(1.0)).items(), _outer(R.gaussian_kernel(1.0), R.gaussian_kernel(1.0, 2)).values(), strict=True)})}, m AS (SELECT img, y, x, abs(v) AS v FROM g) {_summary_sql('m')}")
def laplace_of_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px(spark, sf_dir)
    a, b = R.gaussian(p, "v", 1.0, "a", (2, 0)), R.gaussian(p, "v", 1.0, "b", (0, 2))
    return _summary(a.join(b, list(R.KEYS)).withColumn("v", F.abs(F.col("a") + F.col("b"))), "v")


@query("difference_of_gaussians", f"WITH {PX}, {_conv('a', 'px', _outer(R.gaussian_kernel(0.8), R.gaussian_kernel(0.8)), 'nearest')}, {_conv('b', 'px', _outer(R.gaussian_kernel(1.3), R.gaussian_kernel(1.3)), 'nearest')}, m AS (SELECT img, y, x, abs(a.v - b.v) AS v FROM a JOIN b USING (img, y, x)) {_summary_sql('m')}")
def difference_of_gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px(spark, sf_dir)
    a, b = (R.gaussian(p, "v", s, n, border="nearest") for s, n in ((0.8, "a"), (1.3, "b")))
    return _summary(a.join(b, list(R.KEYS)).withColumn("v", F.abs(F.col("a") - F.col("b"))), "v")


_G = {n: _outer(R.gaussian_kernel(0.8, o[0]), R.gaussian_kernel(0.8, o[1])) for n, o in (("xx", (0, 2)), ("yy", (2, 0)), ("xy", (1, 1)))}


@query("hessian_eigenvalue", f"WITH {PX}, {', '.join(_conv(n, 'px', k) for n, k in _G.items())}, m AS (SELECT img, y, x, greatest(abs((xx.v + yy.v) / 2 + sqrt(power((xx.v - yy.v) / 2, 2) + xy.v * xy.v)), abs((xx.v + yy.v) / 2 - sqrt(power((xx.v - yy.v) / 2, 2) + xy.v * xy.v))) AS v FROM xx JOIN yy USING (img, y, x) JOIN xy USING (img, y, x)) {_summary_sql('m')}")
def hessian_eigenvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(R.hessian_max(px(spark, sf_dir), "v", 0.8), "hess")


@query("box_std", f"WITH {PX}, m AS (SELECT p.img, p.y, p.x, sqrt(greatest(avg(q.v * q.v) - avg(q.v) * avg(q.v), 0)) AS v {_near(_square(5), 'px')} GROUP BY p.img, p.y, p.x) {_summary_sql('m')}")
def box_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(R.box_std(px(spark, sf_dir), "v", 5), "std")


@query("local_range", f"WITH {PX}, m AS (SELECT p.img, p.y, p.x, max(q.v) - min(q.v) AS v {_near(_square(5), 'px')} GROUP BY p.img, p.y, p.x) {_summary_sql('m')}")
def local_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px(spark, sf_dir)
    return _summary(R.box(p, "v", 5, "hi", "max").join(R.box(p, "v", 5, "lo", "min"), list(R.KEYS)).withColumn("v", F.col("hi") - F.col("lo")), "v")


@query(
    "coherence",
    f"""WITH {PX}, {_conv('gx', 'px', _three(R.KERNELS['sobel'][0]))}, {_conv('gy', 'px', _three(R.KERNELS['sobel'][1]))},
g AS (SELECT img, y, x, gx.v AS gx, gy.v AS gy FROM gx JOIN gy USING (img, y, x)),
s AS (SELECT p.img, p.y, p.x, avg(q.gx * q.gx) AS a, avg(q.gy * q.gy) AS b, avg(q.gx * q.gy) AS c {_near(_square(5), 'g')} GROUP BY p.img, p.y, p.x),
m AS (SELECT img, y, x, least(1, sqrt(power(a - b, 2) + 4 * c * c) / (a + b + 1e-12)) AS v FROM s) {_summary_sql('m')}""",
)
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.nine(px(spark, sf_dir))
    gx, gy = R.gradient(F.col("n9"), "sobel")
    return _summary(R.coherence(d.select(*R.KEYS, gx.alias("gx"), gy.alias("gy")), "gx", "gy", 5), "coherence")


# ---- morphology

_CROSS2 = {o: 1.0 for o in MO.diamond(2)}
_BRIGHT = PX + ", br AS (SELECT img, y, x, v >= 0.7 AS on_, (v >= 0.7)::INTEGER AS v FROM px)"


def bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).select(*R.KEYS, (F.col("v") >= 0.7).alias("on"))


def _in_image(offsets) -> str:
    values = ", ".join(f"({a}, {b})" for a, b in offsets)
    return f"FROM br p CROSS JOIN (VALUES {values}) k(dy, dx) LEFT JOIN br q ON q.img = p.img AND q.y = p.y + k.dy AND q.x = p.x + k.dx"


def _binary(name: str, sql: str, make) -> None:
    @query(name, f"WITH {_BRIGHT}, {sql} {_summary_sql('m', 'v::INTEGER::DOUBLE')}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _summary(make(bright(spark, sf_dir)), "out")


_DIL = f"m AS (SELECT p.img, p.y, p.x, bool_or(coalesce(q.on_, false)) AS v {_in_image(MO.diamond(2))} GROUP BY p.img, p.y, p.x)"
_binary("dilate_cross", _DIL, lambda d: MO.dilate(d, "on", 2, "out"))
_binary("erode_cross", f"m AS (SELECT p.img, p.y, p.x, bool_and(coalesce(q.on_, true)) AS v {_in_image(MO.diamond(1))} GROUP BY p.img, p.y, p.x)", lambda d: MO.erode(d, "on", 1, "out"))
_binary(
    "closing_disk",
    f"dl AS (SELECT p.img, p.y, p.x, bool_or(coalesce(q.on_, false)) AS on_ {_in_image(MO.disk(1))} GROUP BY p.img, p.y, p.x), m AS (SELECT p.img, p.y, p.x, bool_and(coalesce(q.on_, true)) AS v {_in_image(MO.disk(1)).replace('br ', 'dl ')} GROUP BY p.img, p.y, p.x)",
    lambda d: MO.close(d, "on", 1, "out"),
)
_EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
_binary("boundary_inner", f"m AS (SELECT p.img, p.y, p.x, any_value(p.on_) AND bool_or(NOT coalesce(q.on_, true)) AS v {_in_image(_EIGHT)} GROUP BY p.img, p.y, p.x)", lambda d: MO.boundary(d, "on", "out"))
_binary("endpoints_raw", f"m AS (SELECT p.img, p.y, p.x, any_value(p.on_) AND sum(coalesce(q.on_, false)::INTEGER) = 1 AS v {_in_image(_EIGHT)} GROUP BY p.img, p.y, p.x)", lambda d: MO.endpoints(d, "on", "out"))
_binary("mask_xor", f"dl AS (SELECT p.img, p.y, p.x, bool_or(coalesce(q.on_, false)) AS d, any_value(p.on_) AS o {_in_image(MO.diamond(1))} GROUP BY p.img, p.y, p.x), m AS (SELECT img, y, x, d <> o AS v FROM dl)", lambda d: MO.dilate(d, "on", 1, "_d").withColumn("out", F.col("_d") != F.col("on")))


def _cc(on: str, four: bool) -> str:
    gap = "abs(a.y - b.y) + abs(a.x - b.x) = 1" if four else "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x)"
    return f"pt AS (SELECT img, y, x, y::BIGINT * {1 << 20} + x AS id FROM br WHERE {on}), nb AS (SELECT a.img, a.id AS a, b.id AS b FROM pt a JOIN pt b ON a.img = b.img AND {gap}), rc AS (SELECT img, id, id AS m FROM pt UNION SELECT rc.img, nb.b, rc.m FROM rc JOIN nb ON nb.img = rc.img AND nb.a = rc.id WHERE rc.m < nb.b), cc AS (SELECT img, id, min(m) AS label FROM rc GROUP BY img, id)"


@query("connected_components", f"WITH RECURSIVE {_BRIGHT}, {_cc('on_', False)} SELECT img, label, count(*) AS n FROM cc GROUP BY img, label")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MO.components(bright(spark, sf_dir), "on", "label").groupBy("img", "label").agg(F.count("*").alias("n"))


@query(
    "hysteresis",
    f"WITH RECURSIVE {PX}, br AS (SELECT img, y, x, v > 0.6 AS on_, v > 0.9 AS hi FROM px), {_cc('on_', True)}, k AS (SELECT DISTINCT cc.img, label FROM cc JOIN br ON br.img = cc.img AND br.y::BIGINT * {1 << 20} + br.x = cc.id WHERE hi) SELECT img, count(*) AS n FROM cc JOIN k USING (img, label) GROUP BY img",
)
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = MO.hysteresis(px(spark, sf_dir), "v", 0.6, 0.9, "out")
    return h.where("out").groupBy("img").agg(F.count("*").alias("n"))


@query("edge_pairs_range_join", f"WITH {PX}, pt AS (SELECT img, y, x, y::BIGINT * {1 << 20} + x AS id FROM px WHERE v >= 0.9) SELECT a.img, count(*) AS n, round(sum(sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2))), 4) AS total FROM pt a JOIN pt b ON a.img = b.img AND a.id < b.id AND sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2)) <= 5.0 GROUP BY a.img")
def edge_pairs_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px(spark, sf_dir).where("v >= 0.9").withColumn("id", F.col("y").cast("long") * (1 << 20) + F.col("x"))
    return MO.near_pairs(p, "id", 5.0).groupBy("img").agg(F.count("*").alias("n"), F.round(F.sum("dist"), 4).alias("total"))


# ---- information on images


@query(
    "surprisal_image",
    f"""WITH {PX}, cut AS (SELECT img, quantile_cont(v, 0.6) AS c FROM px GROUP BY img), bg AS (SELECT img, v, count(*) AS nb FROM px JOIN cut USING (img) WHERE v <= c GROUP BY img, v),
dist AS (SELECT DISTINCT img, v FROM px), cum AS (SELECT img, v, coalesce(sum(nb) OVER (PARTITION BY img ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx, sum(nb) OVER (PARTITION BY img) AS n FROM dist LEFT JOIN bg USING (img, v)),
m AS (SELECT img, y, x, -log2(greatest((n - idx + 1) / (n + 1.0::DOUBLE), 1e-9)) AS v FROM px JOIN cum USING (img, v)) {_summary_sql('m')}""",
)
def surprisal_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(I.surprisal(px(spark, sf_dir), "v", by=["img"]), "bits")


@query("roi_image", f"WITH {PX}, c AS (SELECT img, y, x, (row_number() OVER (PARTITION BY img ORDER BY v, y, x) - 1) / (count(*) OVER (PARTITION BY img) - 1.0::DOUBLE) AS conf FROM px), br AS (SELECT img, y, x, conf >= 0.8 AS on_ FROM c), m AS (SELECT p.img, p.y, p.x, bool_or(coalesce(q.on_, false)) AS v {_in_image(MO.diamond(1))} GROUP BY p.img, p.y, p.x) {_summary_sql('m', 'v::INTEGER::DOUBLE')}")
def roi_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.percentile_confidence(px(spark, sf_dir), "v", ["y", "x"], by=["img"])
    return _summary(MO.dilate(c.withColumn("on", F.col("conf") >= 0.8), "on", 1, "roi"), "roi")


@query("multiscale_detect", None)
def multiscale_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.multiscale import multiscale_detect as run

    return run(px(spark, sf_dir), scales=(9, 5, 3), f1="CL", f2="CL")


# ---- evaluation

_DG = f"dg AS (SELECT p.img, p.y, p.x, any_value(p.v) AS v, any_value(p.gt) AS gt, bool_or(coalesce(q.gt, false)) AS dg, max(q.v) AS near FROM sc p CROSS JOIN (VALUES {', '.join(f'({a}, {b})' for a, b in MO.diamond(1))}) k(dy, dx) LEFT JOIN sc q ON q.img = p.img AND q.y = p.y + k.dy AND q.x = p.x + k.dx GROUP BY p.img, p.y, p.x)"
_N = 21
_PROBS = "[" + ", ".join(repr(p) for p in E.threshold_probs(_N)) + "]"
_CURVE = f"""{GT}, {_DG}, th AS (SELECT DISTINCT unnest(quantile_cont(v, {_PROBS})) AS t FROM sc),
cv AS (SELECT t, sum((v >= t)::INTEGER) AS npred, sum((v >= t AND dg)::INTEGER) AS mp, sum((gt AND near >= t)::INTEGER) AS mg, sum(gt::INTEGER) AS ngt FROM dg, th GROUP BY t),
pr AS (SELECT t, mp / greatest(npred, 1)::DOUBLE AS p, mg / greatest(ngt, 1)::DOUBLE AS r FROM cv),
curve AS (SELECT t, p, r, 2 * p * r / greatest(p + r, 1e-12) AS f FROM pr)"""


@query("tolerant_prf", f"WITH {GT}, br AS (SELECT img, y, x, v >= 0.7 AS pr, gt FROM sc), d AS (SELECT p.img, p.y, p.x, any_value(p.pr) AS pr, any_value(p.gt) AS gt, bool_or(coalesce(q.pr, false)) AS dp, bool_or(coalesce(q.gt, false)) AS dg {_in_image(MO.diamond(2))} GROUP BY p.img, p.y, p.x), c AS (SELECT img, sum((pr AND dg)::INTEGER) AS mp, sum(pr::INTEGER) AS npred, sum((gt AND dp)::INTEGER) AS mg, sum(gt::INTEGER) AS ngt FROM d GROUP BY img) SELECT img, round(mp / greatest(npred, 1)::DOUBLE, 6) AS precision, round(mg / greatest(ngt, 1)::DOUBLE, 6) AS recall FROM c")
def tolerant_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.tolerant_counts(scored(spark, sf_dir).withColumn("pred", F.col("v") >= 0.7), "pred", "gt", 2)
    p, r, _ = E.prf(*[F.col(k) for k in ("mp", "npred", "mg", "ngt")])
    return c.select("img", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"))


@query("pooled_micro_f1", f"WITH {_CURVE} SELECT round(2 * p * r / (p + r), 6) AS F1 FROM (SELECT sum((v >= 0.7 AND dg)::INTEGER) / sum((v >= 0.7)::INTEGER)::DOUBLE AS p, sum((gt AND near >= 0.7)::INTEGER) / sum(gt::INTEGER)::DOUBLE AS r FROM dg)")
def pooled_micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sweep import micro

    c = E.tolerant_counts(scored(spark, sf_dir).withColumn("pred", F.col("v") >= 0.7), "pred", "gt", 1).withColumn("all", F.lit(1))
    return micro(c, ["all"]).select(F.round("F1", 6).alias("F1"))


@query("pr_curve", f"WITH {_CURVE} SELECT round(t, 6) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f FROM curve")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pr_curve(scored(spark, sf_dir), "v", "gt", 1, _N).select(*[F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall", "f")])


@query("ods_r50", f"WITH {_CURVE} SELECT round(arg_max(t, f), 6) AS ODS_threshold, round(max(f), 6) AS ODS, round(coalesce(max(CASE WHEN p >= 0.5 THEN r END), 0), 6) AS R50 FROM curve")
def ods_r50(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = E.pr_curve(scored(spark, sf_dir), "v", "gt", 1, _N)
    return c.agg(F.round(F.max_by("threshold", F.struct(F.col("f"), -F.col("threshold"))), 6).alias("ODS_threshold"), F.round(F.max("f"), 6).alias("ODS"), F.round(F.coalesce(F.max(F.when(F.col("precision") >= 0.5, F.col("recall"))), F.lit(0.0)), 6).alias("R50"))


@query(
    "ois",
    f"""WITH {GT}, {_DG}, th AS (SELECT DISTINCT img, unnest(q) AS t FROM (SELECT img, quantile_cont(v, {_PROBS}) AS q FROM sc GROUP BY img)),
cv AS (SELECT img, t, sum((v >= t)::INTEGER) AS npred, sum((v >= t AND dg)::INTEGER) AS mp, sum((gt AND near >= t)::INTEGER) AS mg, sum(gt::INTEGER) AS ngt FROM dg JOIN th USING (img) GROUP BY img, t),
pr AS (SELECT img, mp / greatest(npred, 1)::DOUBLE AS p, mg / greatest(ngt, 1)::DOUBLE AS r FROM cv) SELECT img, round(max(2 * p * r / greatest(p + r, 1e-12)), 6) AS best_f FROM pr GROUP BY img""",
)
def ois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.image_best(scored(spark, sf_dir), "v", "gt", 1, _N).select("img", F.round("best_f", 6).alias("best_f"))


@query(
    "average_precision",
    f"""WITH {_CURVE}, e AS (SELECT t, r, max(p) OVER (ORDER BY r, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM curve),
a AS (SELECT 0.0::DOUBLE AS r, arg_min(p, (r, t)) AS p, -1 AS o FROM e UNION ALL SELECT r, p, row_number() OVER (ORDER BY r, t) FROM e UNION ALL SELECT 1.0, 0.0, 1000000)
SELECT round(sum((r - pr) * (p + pp) / 2), 6) AS AP FROM (SELECT r, p, lag(r) OVER (ORDER BY o) AS pr, lag(p) OVER (ORDER BY o) AS pp FROM a)""",
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.average_precision(E.pr_curve(scored(spark, sf_dir), "v", "gt", 1, _N)).select(F.round("AP", 6).alias("AP"))


@query("roc_auc", f"WITH {GT}, k AS (SELECT gt, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM sc) SELECT round((sum(CASE WHEN gt THEN r END) - sum(gt::INTEGER) * (sum(gt::INTEGER) + 1) / 2.0::DOUBLE) / (sum(gt::INTEGER)::DOUBLE * sum((NOT gt)::INTEGER)), 6) AS ROC_AUC FROM k")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc_auc(scored(spark, sf_dir), "v", "gt").select(F.round("ROC_AUC", 6).alias("ROC_AUC"))


@query(
    "benchmark_metrics",
    f"""WITH {_CURVE}, best AS (SELECT t, p, r, f FROM curve ORDER BY f DESC, t LIMIT 1)
SELECT round(best.f, 6) AS ODS, round(best.t, 6) AS ODS_threshold, round(best.p, 6) AS ODS_precision, round(best.r, 6) AS ODS_recall,
  (SELECT round(avg(best_f), 5) FROM ({SQL["ois"]})) AS OIS, (SELECT AP FROM ({SQL["average_precision"]})) AS AP, (SELECT R50 FROM ({SQL["ods_r50"]})) AS R50,
  (SELECT ROC_AUC FROM ({SQL["roc_auc"]})) AS ROC_AUC, {_N} AS n_thresholds FROM best""",
)
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.benchmark(scored(spark, sf_dir), "v", "gt", 1, _N)
    return m.select(*[F.round(c, 5 if c == "OIS" else 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


_REACH = 12  # of the largest tolerance that the SQL below knows: images of up to 1,600 pixels


@query(
    "variable_tolerance",
    f"""WITH {GT}, tl AS (SELECT img, greatest(1, round_even(sqrt(power(max(y) + 1, 2) + power(max(x) + 1, 2)) * 0.0075, 0)) AS tol FROM sc GROUP BY img),
dg AS (SELECT p.img, p.y, p.x, any_value(p.v) AS v, any_value(p.gt) AS gt, bool_or(coalesce(q.gt, false)) AS dg, max(q.v) AS near FROM sc p JOIN tl ON tl.img = p.img JOIN (VALUES {', '.join(f'({a}, {b})' for a, b in MO.diamond(_REACH))}) k(dy, dx) ON abs(k.dy) + abs(k.dx) <= tl.tol LEFT JOIN sc q ON q.img = p.img AND q.y = p.y + k.dy AND q.x = p.x + k.dx GROUP BY p.img, p.y, p.x),
th AS (SELECT DISTINCT unnest(quantile_cont(v, {_PROBS})) AS t FROM sc),
ci AS (SELECT img, t, sum((v >= t)::INTEGER) AS npred, sum((v >= t AND dg)::INTEGER) AS mp, sum((gt AND near >= t)::INTEGER) AS mg, sum(gt::INTEGER) AS ngt FROM dg, th GROUP BY img, t),
pi AS (SELECT img, mp / greatest(npred, 1)::DOUBLE AS p, mg / greatest(ngt, 1)::DOUBLE AS r FROM ci),
oi AS (SELECT avg(f) AS OIS, avg(h) AS F05_OIS FROM (SELECT img, max(2 * p * r / greatest(p + r, 1e-12)) AS f, max(1.25 * p * r / greatest(0.25 * p + r, 1e-12)) AS h FROM pi GROUP BY img)),
pr AS (SELECT t, sum(mp) / greatest(sum(npred), 1)::DOUBLE AS p, sum(mg) / greatest(sum(ngt), 1)::DOUBLE AS r FROM ci GROUP BY t),
curve AS (SELECT t, p, r, 2 * p * r / greatest(p + r, 1e-12) AS f, 1.25 * p * r / greatest(0.25 * p + r, 1e-12) AS h FROM pr), best AS (SELECT t, p, r, f FROM curve ORDER BY f DESC, t LIMIT 1),
e AS (SELECT t, r, max(p) OVER (ORDER BY r, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM curve),
a AS (SELECT 0.0::DOUBLE AS r, arg_min(p, (r, t)) AS p, -1 AS o FROM e UNION ALL SELECT r, p, row_number() OVER (ORDER BY r, t) FROM e UNION ALL SELECT 1.0, 0.0, 1000000),
ap AS (SELECT round(sum((r - pr) * (p + pp) / 2), 6) AS AP FROM (SELECT r, p, lag(r) OVER (ORDER BY o) AS pr, lag(p) OVER (ORDER BY o) AS pp FROM a))
SELECT round(best.f, 6) AS ODS, round(best.t, 6) AS ODS_threshold, round(best.p, 6) AS ODS_precision, round(best.r, 6) AS ODS_recall, round(OIS, 5) AS OIS, AP,
  (SELECT round(coalesce(max(CASE WHEN p >= 0.5 THEN r END), 0), 6) FROM curve) AS R50, (SELECT ROC_AUC FROM ({SQL["roc_auc"]})) AS ROC_AUC, {_N} AS n_thresholds, (SELECT round(max(h), 6) FROM curve) AS F05_ODS, round(F05_OIS, 5) AS F05_OIS FROM best, oi, ap""",
)
def variable_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.variable_tolerance(scored(spark, sf_dir), "v", "gt", _N)
    return m.select(*[F.round(c, 5 if c.endswith("OIS") else 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


# ---- thin lines, links and distances


def _rounds_sql(steps: int) -> str:
    """t: the mask after each step of two-pass thinning, up to the one that changes nothing."""
    at = {"p2": (-1, 0), "p3": (-1, 1), "p4": (0, 1), "p5": (1, 1), "p6": (1, 0), "p7": (1, -1), "p8": (0, -1), "p9": (-1, -1)}
    pick = ", ".join(f"bool_or(q.m AND q.y = p.y + {dy} AND q.x = p.x + {dx}) AS {n}" for n, (dy, dx) in at.items())
    both = lambda a, b: f"({a} OR {b})::INTEGER"
    crossings = " + ".join(f"(NOT {a} AND ({b} OR {c}))::INTEGER" for a, b, c in (("p2", "p3", "p4"), ("p4", "p5", "p6"), ("p6", "p7", "p8"), ("p8", "p9", "p2")))
    one = " + ".join(both(a, b) for a, b in (("p9", "p2"), ("p3", "p4"), ("p5", "p6"), ("p7", "p8")))
    two = " + ".join(both(a, b) for a, b in (("p2", "p3"), ("p4", "p5"), ("p6", "p7"), ("p8", "p9")))

    def half(src: str, side: str) -> str:
        near = f"SELECT p.img, p.y, p.x, any_value(p.step) AS step, any_value(p.was) AS was, {pick} FROM (SELECT * FROM {src} WHERE m) p JOIN {src} q ON q.img = p.img AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY p.img, p.y, p.x"
        return f"(SELECT img, y, x, step, was, NOT (({crossings}) = 1 AND least({one}, {two}) BETWEEN 2 AND 3 AND NOT ({side})) AS m FROM ({near}))"

    first = half("(SELECT img, y, x, step, true AS m, true AS was FROM t)", "(p2 OR p3 OR NOT p5) AND p4")
    kept = f"(SELECT img, y, x, step, m, was FROM {first} WHERE m)"
    second = half(kept, "(p6 OR p7 OR NOT p9) AND p8")
    return f"t AS (SELECT img, y, x, 0 AS step FROM br WHERE on_ UNION ALL SELECT img, y, x, step + 1 FROM (SELECT img, y, x, step, count(*) OVER () AS n2, (SELECT count(*) FROM t) AS n1 FROM {second} WHERE m) WHERE n2 < n1 AND step < {steps})"


_ON = "br AS (SELECT img, y, x, v >= 0.7 AS on_ FROM px)"


@query("thin", f"WITH RECURSIVE {PX}, {_ON}, {_rounds_sql(1000)}, z AS (SELECT img, y, x FROM t WHERE step = (SELECT max(step) FROM t)), m AS (SELECT px.img, px.y, px.x, (z.y IS NOT NULL)::INTEGER::DOUBLE AS v FROM px LEFT JOIN z USING (img, y, x)) {_summary_sql('m')}")
def thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(T.thin(bright(spark, sf_dir), "on", "out"), "out")


def _scharr(v):
    gx, gy = K.three(v, "scharr")
    return {"raw": (gx * gx + gy * gy) ** 0.5, "theta": K.orientation(v)}


@query("geodesic_link", None)
def geodesic_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.by_tile(px(spark, sf_dir), ["v"], _scharr, 8, "raw double, theta double")
    d = I.robust01(d, ["raw"], by=["img"], suffix="_s").withColumnRenamed("raw_s", "score")
    d = R.inner(R.nine(d.withColumn("v", F.col("score"))))
    d = d.withColumn("edge", R.suppress(F.col("n9"), F.col("theta"), F.col("_inner")) >= 0.5)
    return _summary(L.geodesic_link(d.select("img", "y", "x", "score", "theta", "edge"), "edge", "score", "score", "theta", "out"), "out")


@query("distance_map", f"WITH {PX}, {_ON}, m AS (SELECT p.img, p.y, p.x, min(sqrt(power(p.y - q.y, 2) + power(p.x - q.x, 2))) AS v FROM br p JOIN (SELECT * FROM br WHERE on_) q ON p.img = q.img GROUP BY p.img, p.y, p.x) {_summary_sql('m')}")
def distance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(D.distance(bright(spark, sf_dir), "on", "out"), "out")


@query("descriptor_modes", None)
def descriptor_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = {"grad_x_grad_y_composed": "grad"}  # modes share descriptors: each different one is made and scaled once
    column = lambda n: same.get(n, n)
    names = list(dict.fromkeys(column(n) for m in K.MODES for n in K.MODES[m]))

    def run(v):
        return K.raw_descriptors(v, 5, "combined")[0] | K.raw_descriptors(v, 5, "legacy")[0]

    raw = T.by_tile(px(spark, sf_dir), ["v"], run, max(K.descriptor_halo(5, m) for m in K.MODES), ", ".join(f"{n} double" for n in names))
    out = I.robust01(raw, names, by=["img"])
    total = lambda m: F.round(F.sum(sum(F.col(column(n)) for n in K.MODES[m])), 4).alias(m)
    return out.groupBy("img").agg(*[total(m) for m in K.MODES])


# ---- edges, conditioning and context by tile


@query("canny", None)
def canny(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(ED.canny(px(spark, sf_dir), "v", 1.0, 0.7, 0.9, "out"), "out")


@query("canny_persistence", None)
def canny_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(ED.canny_persistence(px(spark, sf_dir), "v", "out"), "out")


@query("conditioning_bank", None)
def conditioning_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ("gaussian", "box", "median", "bilateral")
    p = px(spark, sf_dir)
    out = T.by_tile(p, ["v"], lambda v: {m: K.condition(v, m) for m in near}, max(K.halo_of(m) for m in near) + 2, ", ".join(f"{m} double" for m in near))
    out = out.join(T.mean_shift(p, "v", "meanshift"), ["img", "y", "x"]).join(T.diffusion(p, "v", "anisotropic"), ["img", "y", "x"])
    return out.groupBy("img").agg(*[F.round(F.sum(m), 4).alias(m) for m in (*near, "meanshift", "anisotropic")])


@query("gravity_rounds", None)
def gravity_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(T.gravitational(px(spark, sf_dir), "v", "out"), "out")


@query(
    "condition_roi",
    f"""WITH {PX}, k AS (SELECT unnest(range(-6, 7))::INTEGER AS dy), nb AS (SELECT p.img, p.y, p.x, p.v AS c, coalesce(q.v, 0.0) AS u, exp(-0.125 * (a.dy * a.dy + b.dy * b.dy)) * exp(-0.5 * power((coalesce(q.v, 0.0) - p.v) / 0.08, 2)) AS w FROM (SELECT * FROM px WHERE v >= 0.7) p CROSS JOIN k a CROSS JOIN k b LEFT JOIN px q ON q.img = p.img AND q.y = p.y + a.dy AND q.x = p.x + b.dy),
f AS (SELECT img, y, x, least(1, greatest(0, sum(w * u) / sum(w))) AS v FROM nb GROUP BY img, y, x), m AS (SELECT px.img, px.y, px.x, coalesce(f.v, px.v) AS v FROM px LEFT JOIN f USING (img, y, x)) {_summary_sql('m')}""",
)
def condition_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tiles import conditioned_region

    return _summary(conditioned_region(px(spark, sf_dir), F.col("v") >= 0.7, "bilateral"), "out")


@query("context_vectors", None)
def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.context_vectors(px(spark, sf_dir)).select("img", *[F.round(n, 6).alias(n) for n in C.NAMES])


@query("continuity", None)
def continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.continuity(scored(spark, sf_dir).withColumn("on", F.col("v") >= 0.7), "on", "gt")
