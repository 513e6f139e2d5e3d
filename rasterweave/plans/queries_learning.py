"""Registered queries over labelled samples and result tables: learning, routing, sweeps, rankings, sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import evaluation as E
from ..operators import learning as LN
from ..operators.storage import materialize
from ..sources import synthetic as S
from . import sweep
from .queries_raster import scored
from .views import DOC_SQL, EMB_SQL, doc_eval, emb8, table

Q: dict = {}
SQL: dict[str, str] = {}
N = 8


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- learning

_REL = "l AS (SELECT vec_id, y, unnest(x) AS v, unnest(range(0, 8)) AS i FROM emb), st AS (SELECT i, avg(CASE WHEN y >= 0.5 THEN v END) AS mp, avg(CASE WHEN y < 0.5 THEN v END) AS mn, stddev_pop(CASE WHEN y >= 0.5 THEN v END) AS sp, stddev_pop(CASE WHEN y < 0.5 THEN v END) AS sn FROM l GROUP BY i), ef AS (SELECT i, greatest(greatest(mp - mn, 0) / (0.5 * (sp + sn) + 0.05), 0.02) AS e FROM st), w AS (SELECT i::INTEGER AS i, e / sum(e) OVER () AS weight FROM ef)"


@query("reliability_weights", f"WITH {EMB_SQL}, {_REL} SELECT i, round(weight, 6) AS weight FROM w")
def reliability_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LN.reliability(emb8(spark, sf_dir), N).select("i", F.round("weight", 6).alias("weight"))


@query("gram_additive", f"WITH {EMB_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, round(avg(x[i + 1] * x[j + 1]), 6) AS g FROM emb, (SELECT unnest(range(0, 8)) AS i) a, (SELECT unnest(range(0, 8)) AS j) b GROUP BY ALL")
def gram_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, _ = LN.gram(emb8(spark, sf_dir), [F.col("x")[i] for i in range(N)], F.col("y"))
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(N) for j in range(N)], "i int, j int, g double").select("i", "j", F.round("g", 6).alias("g"))


@query("gram_two_additive", f"WITH {EMB_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, round(avg(least(x[i + 1], x[j + 1]) * y), 6) AS c FROM emb, (SELECT unnest(range(0, 8)) AS i) a, (SELECT unnest(range(0, 8)) AS j) b WHERE i < j GROUP BY ALL")
def gram_two_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, pairs = F.col("x"), [(i, j) for i in range(N) for j in range(i + 1, N)]
    _, c, _ = LN.gram(emb8(spark, sf_dir), [F.least(x[i], x[j]) for i, j in pairs], F.col("y"))
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in zip(pairs, c, strict=True)], "i int, j int, c double").select("i", "j", F.round("c", 6).alias("c"))


@query("choquet_design", f"WITH {EMB_SQL}, u AS (SELECT vec_id, unnest(x) AS v, unnest(range(0, 8)) AS i FROM emb), r AS (SELECT vec_id, v - lag(v, 1, 0.0) OVER w AS d, sum((1 << i)::BIGINT) OVER (PARTITION BY vec_id ORDER BY v, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS mask FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY v, i)) SELECT mask, count(*) AS n, round(sum(d), 6) AS delta FROM r WHERE d <> 0 GROUP BY mask")
def choquet_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the integrals each coalition carries."""
    e = emb8(spark, sf_dir).select(F.transform(M.ordered(F.col("x")), lambda p: p["v"]).alias("v"), M.tail_masks(F.col("x")).alias("m"))
    delta = F.transform("v", lambda a, i: a - F.when(i > 0, F.get("v", i - 1)).otherwise(0.0))
    long = e.select(F.explode(F.arrays_zip(F.col("m").alias("mask"), delta.alias("d"))).alias("t")).select("t.mask", "t.d").where("d <> 0")
    return long.groupBy("mask").agg(F.count("*").alias("n"), F.round(F.sum("d"), 6).alias("delta"))


@query("balanced_sample_counts", f"WITH {EMB_SQL}, c AS (SELECT sum((y >= 0.5)::INTEGER) AS p, sum((y < 0.5)::INTEGER) AS n FROM emb) SELECT k AS positive, least(p, n, 30)::BIGINT AS n FROM c, (SELECT unnest([true, false]) AS k)")
def balanced_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = LN.balanced_sample(emb8(spark, sf_dir), max_samples=60, key="vec_id")
    return s.groupBy((F.col("y") >= 0.5).alias("positive")).agg(F.count("*").alias("n"))


@query("pooled_sample_counts", f"WITH {EMB_SQL}, g AS (SELECT label % 3 AS g, y FROM emb), c AS (SELECT g, sum((y >= 0.5)::INTEGER) AS p, sum((y < 0.5)::INTEGER) AS n FROM g GROUP BY g) SELECT g, CASE WHEN least(p, n) > 0 THEN 2 * least(p, n, 20) ELSE least(p + n, 40) END::BIGINT AS n FROM c")
def pooled_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb8(spark, sf_dir).withColumn("g", F.col("label") % 3)
    return LN.balanced_sample(e, max_samples=40, by=["g"], key="vec_id").groupBy("g").agg(F.count("*").alias("n"))


def _model_rows(spark: SparkSession, specs: dict) -> DataFrame:
    rows = [(k, s["kind"], i, float(v)) for k, s in specs.items() for i, v in enumerate(s.get("capacity_table", []))]
    return spark.createDataFrame(rows, "measure string, kind string, mask int, mu double").withColumn("mu", F.round("mu", 4))


@query("learn_additive")
def learn_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_rows(spark, {"additive": LN.learn_additive(emb8(spark, sf_dir), N)})


@query("learn_two_additive")
def learn_two_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_rows(spark, {"two_additive": LN.learn_two_additive(emb8(spark, sf_dir), N)})


@query("learn_full_capacity")
def learn_full_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_rows(spark, {"full": LN.learn_full(emb8(spark, sf_dir), N)})


def _sugeno_sql(targets: dict[str, float]) -> str:
    """su: name, mask, mu of the Sugeno measures whose densities are the reliability weights times a target; the root by bisection."""
    named = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in targets.items())
    f = lambda z: f"(list_sum(list_transform(g, lambda v: ln(1 + {z} * v))) - ln(1 + {z}))"
    return f"""WITH RECURSIVE {EMB_SQL}, {_REL},
gs AS (SELECT name, list(least(0.95::DOUBLE, greatest(1e-5::DOUBLE, weight * target)) ORDER BY i) AS g FROM w, (VALUES {named}) t(name, target) GROUP BY name),
st0 AS (SELECT name, g, list_sum(g) AS s FROM gs),
z AS (SELECT name, g, s, CASE WHEN s < 1 THEN 1e-9::DOUBLE ELSE -1 + 1e-12::DOUBLE END AS lo, CASE WHEN s < 1 THEN 1e9::DOUBLE ELSE -1e-12::DOUBLE END AS hi, 0 AS k FROM st0 UNION ALL
  SELECT name, g, s, CASE WHEN ({f('(lo + hi) / 2')} > 0) = (s > 1) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ({f('(lo + hi) / 2')} > 0) = (s > 1) THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM z WHERE k < 140),
la AS (SELECT name, g, s, CASE WHEN abs(s - 1) < 1e-9 THEN 0.0::DOUBLE ELSE (lo + hi) / 2 END AS la FROM z WHERE k = 140),
bits AS (SELECT name, s, la, mask, list_transform(range(1, 9), lambda i: CASE WHEN (mask >> (i - 1)::BIGINT) & 1 = 1 THEN g[i] ELSE 0.0 END) AS own FROM la, (SELECT unnest(range(0, 256)) AS mask)),
su AS (SELECT name, mask, CASE WHEN mask = 0 THEN 0.0 WHEN mask = 255 THEN 1.0 WHEN la = 0 THEN list_sum(own) / s ELSE least(1.0, greatest(0.0, (list_product(list_transform(own, lambda v: 1 + la * v)) - 1) / la)) END AS mu FROM bits)"""


_SUMS = {f"sugeno_{s:g}": s for s in (0.6, 0.8, 1.0, 1.2, 1.4)}


@query("learn_sugeno", _sugeno_sql(_SUMS) + " SELECT name AS measure, 'sugeno_lambda' AS kind, mask::INTEGER AS mask, round(mu, 4) AS mu FROM su")
def learn_sugeno(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model_rows(spark, {k: LN.learn_sugeno(emb8(spark, sf_dir), N, target_sum=s) for k, s in _SUMS.items()})


@query(
    "interpretability",
    _sugeno_sql({"sugeno": 0.7})
    + """, ed AS (SELECT l.name, i, l.mask, bit_count(l.mask) AS card, u.mu - l.mu AS gain FROM su l, (SELECT unnest(range(0, 8)) AS i) b JOIN su u ON u.name = l.name AND u.mask = (l.mask | (1::BIGINT << i)) WHERE l.mask & (1::BIGINT << i) = 0)
SELECT name AS measure, 'e' || i AS feature, NULL::VARCHAR AS partner, round(sum(factorial(card::INTEGER) * factorial((7 - card)::INTEGER) / 40320.0::DOUBLE * gain), 6) + 0.0 AS value FROM ed GROUP BY name, i
UNION ALL SELECT a.name, 'e' || a.i, 'e' || j, round(sum(factorial(a.card::INTEGER) * factorial((6 - a.card)::INTEGER) / 5040.0::DOUBLE * (c.gain - a.gain)), 6) + 0.0 FROM ed a, (SELECT unnest(range(0, 8)) AS j) b JOIN ed c ON c.name = a.name AND c.i = a.i AND c.mask = (a.mask | (1::BIGINT << j)) WHERE j > a.i AND a.mask & (1::BIGINT << j) = 0 GROUP BY ALL""",
)
def interpretability(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = {"sugeno": LN.learn_sugeno(emb8(spark, sf_dir), N)}
    return spark.createDataFrame(LN.interpretability(specs, [f"e{i}" for i in range(N)]), "measure string, feature string, partner string, value double").withColumn("value", F.round("value", 6) + 0.0)


_F3 = ["f0", "f1", "f2"]
_F3_SQL = "t AS (SELECT vec_id, label, x[1] AS f0, x[2] AS f1, x[3] AS f2 FROM emb), s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _F3) + " FROM t), z AS (SELECT vec_id, label, " + ", ".join(f"({c} - m_{c}) / (s_{c} + 1e-8) AS {c}" for c in _F3) + " FROM t, s), c AS (SELECT label, " + ", ".join(f"avg({c}) AS c_{c}" for c in _F3) + " FROM z GROUP BY label)"


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb8(spark, sf_dir).select("vec_id", "label", *[F.col("x")[i].alias(f"f{i}") for i in range(3)])


@query("context_centroids", f"WITH {EMB_SQL}, {_F3_SQL} SELECT label, " + ", ".join(f"round(c_{c}, 6) AS c_{c}" for c in _F3) + " FROM c")
def context_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _ = LN.fit_centroids(_three(spark, sf_dir), "label", _F3)
    return c.select("label", *[F.round(f"c_{f}", 6).alias(f"c_{f}") for f in _F3])


@query("nearest_centroid", f"WITH {EMB_SQL}, {_F3_SQL}, d AS (SELECT vec_id, c.label, " + " + ".join(f"power({c} - c_{c}, 2)" for c in _F3) + " AS d FROM z, c) SELECT vec_id, arg_min(label, (d, label)) AS predicted FROM d GROUP BY vec_id")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _three(spark, sf_dir)
    c, s = LN.fit_centroids(t, "label", _F3)
    return LN.nearest_centroid(t, "vec_id", "label", c, s, _F3).select("vec_id", "predicted")


# ---- evaluation of scores without geometry

_PROBS = "[" + ", ".join(repr(p) for p in E.threshold_probs(25)) + "]"


@query(
    "document_pr_curve",
    f"""WITH {DOC_SQL}, th AS (SELECT DISTINCT unnest(quantile_cont(score, {_PROBS})) AS t FROM de),
cv AS (SELECT t, sum((score >= t)::INTEGER) AS n, sum((score >= t AND y)::INTEGER) AS k, sum(y::INTEGER) AS p FROM de, th GROUP BY t)
SELECT round(t, 6) AS threshold, round(k / greatest(n, 1)::DOUBLE, 6) AS precision, round(k / greatest(p, 1)::DOUBLE, 6) AS recall FROM cv""",
)
def document_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pr_curve(doc_eval(spark, sf_dir), "score", "y", 0, 25).select(*[F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall")])


@query("document_roc_auc", f"WITH {DOC_SQL}, k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM de) SELECT round((sum(CASE WHEN y THEN r END) - sum(y::INTEGER) * (sum(y::INTEGER) + 1) / 2.0::DOUBLE) / (sum(y::INTEGER)::DOUBLE * sum((NOT y)::INTEGER)), 6) AS ROC_AUC FROM k")
def document_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.roc_auc(doc_eval(spark, sf_dir), "score", "y").select(F.round("ROC_AUC", 6).alias("ROC_AUC"))


# ---- sweeps: lineitem stands in for a table of results

_RES = "res AS (SELECT l_returnflag AS method, l_linestatus AS family, l_suppkey AS config, round(avg(l_discount), 6) AS ODS, round(avg(l_tax), 6) AS AP, round(avg(l_quantity), 4) AS OIS FROM lineitem GROUP BY ALL)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("family"), F.col("l_suppkey").alias("config"))
    return g.agg(F.round(F.avg("l_discount"), 6).alias("ODS"), F.round(F.avg("l_tax"), 6).alias("AP"), F.round(F.avg("l_quantity"), 4).alias("OIS"))


@query("config_grid_topk", f"WITH {_RES}, g AS (SELECT res.*, q, d, round(ODS * q + AP * d, 6) AS score FROM res, (SELECT unnest([0.5, 0.6, 0.7, 0.8]) AS q) a, (SELECT unnest([0, 1, 2]) AS d) b) SELECT method, family, config, q::DOUBLE AS q, d::BIGINT AS d, score, row_number() OVER (ORDER BY score DESC, AP DESC, OIS DESC, method, family, config, q, d)::INTEGER AS selection_rank FROM g QUALIFY selection_rank <= 100")
def config_grid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = results(spark, sf_dir).crossJoin(F.broadcast(sweep.grid(spark, q=[0.5, 0.6, 0.7, 0.8], d=[0, 1, 2])))  # a dozen settings
    g = g.withColumn("score", F.round(F.col("ODS") * F.col("q") + F.col("AP") * F.col("d"), 6))
    return sweep.rank(g, ("score", "AP", "OIS"), ("method", "family", "config", "q", "d"), 100).select("method", "family", "config", "q", "d", "score", "selection_rank")


@query("best_per_method", f"WITH {_RES} SELECT method, first(config ORDER BY ODS DESC, AP DESC, config, family) AS config, first(CASE WHEN family = 'O' THEN AP END ORDER BY ODS DESC, AP DESC, config, family) FILTER (WHERE family = 'O') AS first_o FROM res GROUP BY method")
def best_per_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).withColumn("first_o", F.when(F.col("family") == "O", F.col("AP")))
    return sweep.best_per(r, ["method"], ["ODS", "AP"], ["config", "first_o"], ["config", "family"])


@query("running_best", f"WITH {_RES}, b AS (SELECT method, family, config, max([ODS, AP, OIS]) OVER (PARTITION BY method, family ORDER BY config) AS best FROM res) SELECT method, family, config, best[1] AS best_ODS, best[2] AS best_AP, best[3] AS best_OIS FROM b")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sweep.running_best(results(spark, sf_dir), ["method", "family"], ["config"], ["ODS", "AP", "OIS"])
    return b.select("method", "family", "config", "best_ODS", "best_AP", "best_OIS")


@query("remaining_configs", "SELECT DISTINCT l_returnflag AS method, l_suppkey AS config FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_returnflag = l.l_returnflag AND d.l_suppkey = l.l_suppkey AND d.l_linestatus = 'F' AND d.l_discount >= 0.1 AND d.l_tax >= 0.08)")
def remaining_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("config"), "l_linestatus", "l_discount", "l_tax")
    done = li.where((F.col("l_linestatus") == "F") & (F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.08))
    return sweep.remaining(li.select("method", "config").distinct(), done, ["method", "config"])


@query("orientation_stability", f"WITH {_RES} SELECT method, round(avg(ODS), 6) AS mean, min(ODS) AS least, max(ODS) AS most, round(stddev_samp(ODS), 6) AS std, round(max(ODS) - min(ODS), 6) AS range FROM res GROUP BY method")
def orientation_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sweep.stability(results(spark, sf_dir), "method", "ODS")
    return s.select("method", F.round("mean", 6).alias("mean"), "least", "most", F.round("std", 6).alias("std"), F.round("range", 6).alias("range"))


@query("family_means", f"WITH {_RES} SELECT family, round(avg(ODS), 6) AS ODS, round(avg(AP), 6) AS AP, round(avg(OIS), 6) AS OIS FROM res GROUP BY family")
def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy("family").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("ODS", "AP", "OIS")])


@query("micro_counts", "SELECT l_returnflag AS method, round(sum((l_discount >= 0.05 AND l_tax >= 0.04)::INTEGER) / sum((l_discount >= 0.05)::INTEGER)::DOUBLE, 6) AS precision, round(sum((l_discount >= 0.05 AND l_tax >= 0.04)::INTEGER) / sum((l_tax >= 0.04)::INTEGER)::DOUBLE, 6) AS recall FROM lineitem GROUP BY ALL")
def micro_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.04
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method"), "l_suppkey").agg(F.count_if(p & t).alias("mp"), F.count_if(p).alias("npred"), F.count_if(p & t).alias("mg"), F.count_if(t).alias("ngt"))
    return sweep.micro(c, ["method"]).select("method", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("left_join_default_roi", f"WITH {_RES}, ch AS (SELECT config, max(OIS) / 100 AS roi_q FROM res WHERE config % 3 = 0 GROUP BY config) SELECT config, count(*) AS n, round(coalesce(max(roi_q), 0.55), 6) AS roi_q FROM res LEFT JOIN ch USING (config) GROUP BY config")
def left_join_default_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    chosen = r.where(F.col("config") % 3 == 0).groupBy("config").agg((F.max("OIS") / 100).alias("roi_q"))
    return sweep.with_default(r, chosen, "config", "roi_q", 0.55).groupBy("config").agg(F.count("*").alias("n"), F.round(F.max("roi_q"), 6).alias("roi_q"))


@query("positional_split", f"WITH {_RES}, d AS (SELECT DISTINCT config FROM res) SELECT config FROM (SELECT config, row_number() OVER (ORDER BY config) - 1 AS n FROM d) WHERE n >= 20 AND n < 60")
def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import rows_between

    return rows_between(results(spark, sf_dir).select("config").distinct(), "config", 20, 60)


@query("spec_union_distinct", f"WITH {_RES} SELECT method, family, count(*) AS n FROM (SELECT method, family FROM res UNION ALL SELECT method, NULL FROM res) GROUP BY ALL")
def spec_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return r.select("method", "family").unionByName(r.select("method"), allowMissingColumns=True).groupBy("method", "family").agg(F.count("*").alias("n"))


@query("annotator_consensus", "WITH a AS (SELECT user_id AS y, day(ts) AS x, event_type, sum(value) > 100 AS b FROM events GROUP BY ALL), c AS (SELECT y, x, avg(b::INTEGER) AS prob FROM a GROUP BY y, x) SELECT x::INTEGER AS x, count(*) AS n, sum((prob >= 0.5)::INTEGER)::BIGINT AS agreed FROM c GROUP BY x")
def annotator_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import consensus

    e = table(spark, sf_dir, "events")
    a = e.groupBy(F.lit("all").alias("img"), F.col("user_id").alias("y"), F.dayofmonth("ts").alias("x"), "event_type").agg((F.sum("value") > 100).alias("boundary"))
    return consensus(a).groupBy("x").agg(F.count("*").alias("n"), F.count_if("gt").alias("agreed"))


# ---- experiments on the events' images


def _images(spark: SparkSession, sf_dir: str, kinds: str = "'click', 'error', 'purchase', 'signup', 'view'") -> DataFrame:
    """img, y, x, v, gt of the events' images of some types."""
    return materialize(scored(spark, sf_dir).where(f"img IN ({kinds})").select("img", "y", "x", "v", "gt"), "images")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _planted(images: DataFrame, configs: list[dict], maker) -> DataFrame:
    """Every block of the images with every configuration's shape planted in it."""
    spark = images.sparkSession
    cut = materialize(S.blocks(images), "blocks")
    named = spark.createDataFrame([(json.dumps(c),) for c in configs], "cfg string")
    return S.planted(cut, cut.select("img").distinct().crossJoin(F.broadcast(named)), maker)  # a short list of configurations


@query("synthetic_cases")
def synthetic_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analytic shapes, planted in blocks of the events' images."""
    configs = [{"id": k, "seed": i} for i, k in enumerate(S.CASES)]
    p = _planted(_images(spark, sf_dir), configs, lambda c: S.make_case(c["id"], int(c["n"]), int(c["seed"])))
    return p.groupBy("img").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.count_if("gt").alias("edge"))


@query("synthetic_split")
def synthetic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's degraded primitives (ten families in turn), planted in blocks of the events' images."""
    p = _planted(_images(spark, sf_dir, "'click', 'view'"), S.split("val", 20, 41000), S.make_sample)
    return p.groupBy("img").agg(F.round(F.avg("v"), 6).alias("mean"), F.count_if("gt").alias("edge"))


@query("orientation_benchmark")
def orientation_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's best F on each image in its eight turns and mirrorings, and how stable it is over them."""
    from . import experiments as X

    score = X.detector_maps(S.turned(_images(spark, sf_dir)), ["scharr"])
    best = E.image_best(materialize(score, "turned"), "scharr", "gt", 2, 25).withColumn("of", F.substring_index("img", "_", 1))
    return _rounded(sweep.stability(best, "of", "best_f"))


@query("operator_screen")
def operator_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of known pairs, ranked by pooled best F on the events' images."""
    from ..operators.multiscale import features

    images = _images(spark, sf_dir)
    feats = features(images, [5], keep=["gt"])
    specs = [r.asDict() for r in sweep.operator_specs(spark, "knownpairs").collect()]
    feats = feats.select("img", "y", "x", "gt", F.explode(sweep.integrals(F.col("desc"), 8, specs)).alias("s")).select("img", "y", "x", "gt", "s.operator", F.round("s.value", 12).alias("value"))
    scores = E.benchmark_by(materialize(feats, "screen"), "value", "gt", ["operator"], 2, 25)
    return _rounded(sweep.rank(scores.select("operator", "ODS", "ODS_threshold", "AP", "OIS"), ("ODS", "AP", "OIS"), ("operator",), 20))


@query("exp_classic_gates")
def exp_classic_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import experiments as X

    return _rounded(X.classic(_images(spark, sf_dir), ("scharr", "sobel"), (0.6, 0.8), (0, 1), 15, scales=(5, 3)))


@query("exp_canny_grid")
def exp_canny_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import experiments as X

    return _rounded(X.canny_grid(_images(spark, sf_dir), scales=(5, 3)))


@query("exp_staged_selection")
def exp_staged_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import experiments as X

    return _rounded(X.staged(_images(spark, sf_dir, "'click', 'error', 'purchase'"), _images(spark, sf_dir, "'signup', 'view'"), ("none", "median"), n_thresholds=7, scales=(5, 3))["pooled"])


@query("exp_measure_competition")
def exp_measure_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures learned on two types of events, ranked on two others and tested on the last; a type is a context."""
    from . import experiments as X

    some = lambda kinds: _images(spark, sf_dir, kinds).withColumn("oracle", F.col("img"))
    return _rounded(X.competition(spark, some("'click', 'error'"), some("'purchase', 'signup'"), some("'view'"))[1])


@query("exp_region_cost")
def exp_region_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import experiments as X

    return _rounded(X.region_cost(X.mfi(_images(spark, sf_dir), scales=(5, 3))))
