"""Registered queries over groups of any size, table functions, routed measures and iterated filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing, tables
from ..operators import tiles as T
from ..operators.choquet import aggregate
from ..operators import evaluation as E
from ..operators import kernels as K
from ..operators import linking as L
from ..operators import morphology as MO
from ..operators.storage import materialize, shared_dir
from ..sources import files
from . import sweep
from .queries_raster import _DG, GT, PX, _cc, _summary, _summary_sql, px, scored
from .views import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- integrals over groups


def _group_sql(term: str) -> str:
    """Every component of a label's vectors, and of all vectors, in the order of their values."""
    return f"""WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS e FROM embeddings), v AS (SELECT label::VARCHAR AS grp, round(least(1.0, greatest(0.0, 0.5 + e)), 6) AS v FROM u UNION ALL SELECT 'all', round(least(1.0, greatest(0.0, 0.5 + e)), 6) FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v) AS k, count(*) OVER (PARTITION BY grp)::DOUBLE AS n, lag(v, 1, 0.0) OVER (PARTITION BY grp ORDER BY v) AS a FROM v),
m AS (SELECT *, power((n - k + 1) / n, 0.4) AS w FROM r) SELECT grp, count(*) AS n, round({term}, 6) AS integral FROM m GROUP BY grp"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, v: all components of a label's vectors in [0,1], and once more those of all vectors as one group."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("label"), F.explode("embedding").alias("e"))
    in01 = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.col("e").cast("double"))), 6)
    return v.select(F.explode(F.array("label", F.lit("all"))).alias("grp"), in01.alias("v"))


for _name, _family, _term in (("choquet_of_groups", "choquet", "sum((v - a) * w)"), ("cc_of_groups", "cc", "least(1, greatest(0, sum(least(v, w) - least(a, w))))"), ("cf_of_groups", "cf", "least(1, greatest(0, sum((v - a) * w)))")):

    @query(_name, _group_sql(_term))
    def _of_groups(spark: SparkSession, sf_dir: str, family=_family) -> DataFrame:
        out = aggregate(_components(spark, sf_dir), ["grp"], "v", lambda s: F.pow(s, F.lit(0.4)), family, "TM" if family == "cc" else "TP")
        return out.select("grp", "n", F.round("integral", 6).alias("integral"))


# ---- table functions


@query(
    "raster_runs",
    f"""WITH {PX}, b AS (SELECT img, y, x, v, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS island FROM px WHERE v >= 0.7)
SELECT img, y, min(x) AS x_from, max(x) AS x_to, round(sum(v), 6) AS total FROM b GROUP BY img, y, island""",
)
def raster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT img, y, x_from, x_to, round(total, 6) AS total FROM raster_runs(TABLE({pixels}), 0.7D)", pixels=px(spark, sf_dir).where("v >= 0.7").select("img", "y", "x", "v"))  # darker pixels only end runs, as gaps do


# ---- routed measures

MODELS = {"en": '{"kind": "power", "q": 0.4}', "de": '{"kind": "additive", "weights": [0.5, 0.3, 0.2]}', "fr": '{"kind": "Power", "q": 1.5, "note": ["kept", {"by": "hand"}]}', "default": '{"kind": "additive", "weights": [1, 1]}', "es": "no model"}


@query(
    "routed_documents",
    """WITH d AS (SELECT doc_id, lang, [least(1.0, n_chars / 8000.0::DOUBLE), length(source) / 8.0::DOUBLE, (doc_id % 11) / 10.0::DOUBLE] AS x FROM documents),
m(label, q, w) AS (VALUES ('en', 0.4::DOUBLE, NULL::DOUBLE[]), ('de', NULL, [0.5, 0.3, 0.2]), ('fr', 1.5, NULL), ('default', NULL, [0.5, 0.5, 0.0])),
k AS (SELECT doc_id, lang, x, q, w FROM d JOIN m ON m.label = CASE WHEN lang IN ('en', 'de', 'fr') THEN lang ELSE 'default' END),
u AS (SELECT doc_id, lang, q, unnest(x) AS v, unnest(range(1, 4)) AS i, unnest(coalesce(w, [0.0::DOUBLE, 0.0, 0.0])) AS w FROM k),
r AS (SELECT *, v - lag(v, 1, 0.0) OVER o AS d, CASE WHEN q IS NULL THEN sum(w) OVER (PARTITION BY doc_id ORDER BY v, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE power((4 - row_number() OVER o) / 3.0::DOUBLE, q) END AS mu FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY v, i)),
z AS (SELECT doc_id, lang, sum(d * mu) AS value FROM r GROUP BY doc_id, lang) SELECT lang, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most FROM z GROUP BY lang""",
)
def routed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.array(F.least(F.lit(1.0), F.col("n_chars") / 8000.0), F.length("source") / 8.0, (F.col("doc_id") % 11) / 10.0)
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", x.alias("x"))
    of = routing.models(spark.createDataFrame(sorted(MODELS.items()), "label string, model string"))
    z = d.crossJoin(F.broadcast(of)).withColumn("model", routing.route(F.col("models"), F.col("lang")))  # one row
    v = z.select("lang", routing.routed_choquet(F.col("x"), 3, F.col("model")).alias("value"))
    return v.groupBy("lang").agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


# ---- iterated filters

_STEPS = 10


@query(
    "diffusion_wrapped",
    f"""WITH RECURSIVE {PX}, t AS (SELECT 0 AS step, img, y, x, v FROM px UNION ALL
SELECT step + 1, img, y, x, least(1.0, greatest(0.0, v + 0.15 * (exp(-power((u - v) / 0.1, 2)) * (u - v) + exp(-power((d - v) / 0.1, 2)) * (d - v) + exp(-power((l - v) / 0.1, 2)) * (l - v) + exp(-power((r - v) / 0.1, 2)) * (r - v))))
FROM (SELECT step, img, y, x, v, coalesce(lag(v) OVER c, last_value(v) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS u, coalesce(lead(v) OVER c, first_value(v) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS d,
  coalesce(lag(v) OVER w, last_value(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS l, coalesce(lead(v) OVER w, first_value(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS r
  FROM t WINDOW c AS (PARTITION BY img, x ORDER BY y), w AS (PARTITION BY img, y ORDER BY x)) WHERE step < {_STEPS}),
m AS (SELECT img, y, x, v FROM t WHERE step = {_STEPS}) {_summary_sql('m')}""",
)
def diffusion_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(T.diffusion(px(spark, sf_dir), "v", "out", _STEPS), "out")


# ---- evaluation entry points


def _cut(probs: int) -> str:
    return "[" + ", ".join(repr(v) for v in E.threshold_probs(probs)) + "]"


@query(
    "best_f1",
    f"""WITH {GT}, {_DG}, th AS (SELECT DISTINCT img, unnest(q) AS t FROM (SELECT img, quantile_cont(v, {_cut(60)}) AS q FROM sc GROUP BY img)),
cv AS (SELECT img, t, sum((v >= t)::INTEGER) AS npred, sum((v >= t AND dg)::INTEGER) AS mp, sum((gt AND near >= t)::INTEGER) AS mg, sum(gt::INTEGER) AS ngt FROM dg JOIN th USING (img) GROUP BY img, t),
pr AS (SELECT img, mp / greatest(npred, 1)::DOUBLE AS p, mg / greatest(ngt, 1)::DOUBLE AS r FROM cv) SELECT img, round(max(2 * p * r / greatest(p + r, 1e-12)), 6) AS best_f1 FROM pr GROUP BY img""",
)
def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_f1(scored(spark, sf_dir), "v", "gt", 1).select("img", F.round("best_f1", 6).alias("best_f1"))


@query("distinct_thresholds", f"WITH {PX}, t AS (SELECT DISTINCT unnest(quantile_cont(v, {_cut(61)})) AS t FROM px) SELECT row_number() OVER (ORDER BY t)::INTEGER - 1 AS i, round(t, 6) AS t FROM t")
def distinct_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold grid: pooled quantiles, each once, in order."""
    t = E.thresholds(px(spark, sf_dir), "v", 61)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "i int, t double").withColumn("t", F.round("t", 6))


@query(
    "hysteresis_from_threshold",
    f"WITH RECURSIVE {PX}, br AS (SELECT img, y, x, v > 0.4 AS on_, v >= 0.8 AS hi FROM px), {_cc('on_', True)}, k AS (SELECT DISTINCT cc.img, label FROM cc JOIN br ON br.img = cc.img AND br.y::BIGINT * {1 << 20} + br.x = cc.id WHERE hi) SELECT img, count(*) AS n FROM cc JOIN k USING (img, label) GROUP BY img",
)
def hysteresis_from_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One threshold, and half of it as the lower one; values equal to the threshold are strong."""
    h = MO.hysteresis(px(spark, sf_dir), "v", 0.4, 0.8, "out", at_least=True)
    return h.where("out").groupBy("img").agg(F.count("*").alias("n"))


@query("postprocess_methods")
def postprocess_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that each way of postprocessing leaves of each image's thresholded values."""
    d = T.by_tile(px(spark, sf_dir), ["v"], lambda v: {"s": v, "theta": K.orientation(v)}, 8, "s double, theta double")
    d = materialize(d, "scores")
    parts = []
    for name in ("none", "closing", "geodesic", "hysteresis", "hyst_geo"):
        e = L.postprocess(d, "s", 0.7, name, "s", "theta")
        parts.append(e.groupBy("img").agg(F.count_if("edge").alias("n")).select("img", F.lit(name).alias("method"), "n"))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


# ---- rankings and what drivers write

_RUNS = "rn AS (SELECT l_returnflag || '_' || l_linestatus || '_' || l_suppkey AS config, round(avg(l_discount), 4) AS ODS, round(avg(l_tax), 4) AS AP, round(avg(l_quantity), 2) AS OIS, round(avg((l_discount >= 0.05)::INTEGER), 4) AS coverage FROM lineitem GROUP BY l_returnflag, l_linestatus, l_suppkey)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config, ODS, AP, OIS, coverage: means over lineitem by supplier and flags."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus", "l_suppkey").alias("config"))
    mean = lambda c, n: F.round(F.avg(c), n)
    return g.agg(mean("l_discount", 4).alias("ODS"), mean("l_tax", 4).alias("AP"), mean("l_quantity", 2).alias("OIS"), mean((F.col("l_discount") >= 0.05).cast("int"), 4).alias("coverage"))


for _name, _keys, _k in (("rank_by_coverage", ("ODS", "AP", "coverage"), 20), ("rank_by_four_keys", ("ODS", "AP", "OIS", "coverage"), 50)):

    @query(_name, f"WITH {_RUNS} SELECT *, row_number() OVER (ORDER BY {', '.join(f'{k} DESC' for k in _keys)}, config)::INTEGER AS selection_rank FROM rn QUALIFY selection_rank <= {_k}")
    def _ranked(spark: SparkSession, sf_dir: str, keys=_keys, k=_k) -> DataFrame:
        return sweep.rank(_runs(spark, sf_dir), keys, ("config",), k)


@query("driver_tables", f"WITH {_RUNS}, r AS (SELECT 'ranking' AS kind, config, ODS FROM rn QUALIFY row_number() OVER (ORDER BY ODS DESC, AP DESC, OIS DESC, config) <= 100 UNION ALL SELECT 'runs', config, ODS FROM rn) SELECT kind, config, round(ODS, 4) AS ODS FROM r")
def driver_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of a driver as CSV in the shared folder, read back under their schemas."""
    import uuid

    runs = materialize(_runs(spark, sf_dir), "runs")
    folder = f"{shared_dir(spark).rstrip('/')}/driver-{uuid.uuid4().hex}"
    files.write_results({"runs": runs, "ranking": sweep.rank(runs, ("ODS", "AP", "OIS"), ("config",), 100)}, folder)
    parts = []
    for kind, more in (("ranking", ", selection_rank int"), ("runs", "")):
        back = spark.read.schema("config string, ODS double, AP double, OIS double, coverage double" + more).option("header", True).csv(f"{folder}/{kind}")
        parts.append(back.select(F.lit(kind).alias("kind"), "config", F.round("ODS", 4).alias("ODS")))
    return parts[0].union(parts[1])


@query("png_round_trip", f"WITH {PX}, m AS (SELECT img, y, x, round_even(v * 255, 0) / 255 AS v FROM px) {_summary_sql('m')}")
def png_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image as PNG, and its pixels from that; images go as blocks of bounded height."""
    p = px(spark, sf_dir).withColumn("block", F.floor(F.col("y") / 1024).cast("int"))
    png = files.images_as_png(p.select(F.concat_ws("#", "img", "block").alias("img"), (F.col("y") % 1024).alias("y"), "x", "v"))
    back = files.decoded(png).select(F.substring_index("img", "#", 1).alias("img"), (F.col("y") + 1024 * F.substring_index("img", "#", -1).cast("int")).alias("y"), "x", "v")
    return _summary(back, "v")


@query(
    "config_names",
    """SELECT upper(lang) AS mode, lower(replace(source, 'src', 'Source-')) AS instruct, printf('%s_q%.2f_d%02d', lang, (n_chars % 100) / 100.0::DOUBLE, (doc_id % 30)::INTEGER) AS config, lpad((doc_id % 1000)::VARCHAR, 8, '0') AS padded, string_split(printf('%s/%s.csv', lang, source), '/')[2] AS file, regexp_replace(printf('%s.tar.csv', source), '\\.[^.]*$', '') AS stem, count(*) AS n FROM documents GROUP BY ALL""",
)
def config_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of configurations and files from their parts, and parts from names."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.groupBy(
        F.upper("lang").alias("mode"),
        F.lower(F.replace("source", F.lit("src"), F.lit("Source-"))).alias("instruct"),
        F.format_string("%s_q%.2f_d%02d", "lang", (F.col("n_chars") % 100) / 100.0, (F.col("doc_id") % 30).cast("int")).alias("config"),
        F.lpad((F.col("doc_id") % 1000).cast("string"), 8, "0").alias("padded"),
        F.split(F.format_string("%s/%s.csv", "lang", "source"), "/")[1].alias("file"),
        F.regexp_replace(F.format_string("%s.tar.csv", "source"), r"\.[^.]*$", "").alias("stem"),
    ).agg(F.count("*").alias("n"))


@query("factorial_chunks")
def factorial_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators times measures over the events' images in resumable chunks; a second call finds all chunks there."""
    import uuid

    from ..functions import measures as M
    from . import experiments as X

    images = materialize(scored(spark, sf_dir).where("img IN ('click', 'view')").select("img", "y", "x", "v", "gt"), "images")
    ops = [r.asDict() for r in sweep.operator_specs(spark, "knownpairs").collect()][:2]
    some = [m for m in M.registry(8) if m["name"] in ("power_q0.1", "additive_uniform")]
    path = f"{shared_dir(spark).rstrip('/')}/factorial-{uuid.uuid4().hex}"
    written = X.factorial(spark, images, path, ops, some, 1, n_thresholds=9)
    if len(written) != 2 or X.factorial(spark, images, path, ops, some, 1, n_thresholds=9):
        raise RuntimeError("chunks were not written once each")
    out = spark.read.parquet(path)
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])
