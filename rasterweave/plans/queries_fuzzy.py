"""Registered queries over descriptors: functions, measures, integrals, lattices, information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary
from ..functions import measures as M
from ..operators import information as I
from ..operators import lattice as L
from ..operators.choquet import integral, relational
from . import sweep
from ..operators.storage import materialize
from .views import EMB_SQL, LI_SQL, emb8, li_desc

Q: dict = {}
SQL: dict[str, str] = {}
BY = ("l_returnflag", "l_linestatus")
_BY = "l_returnflag, l_linestatus"


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _summary(df: DataFrame, value: Column) -> DataFrame:
    v = df.select(*BY, value.alias("value"))
    return v.groupBy(*BY).agg(F.count("value").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


_SUMMARY = f"SELECT {_BY}, count(value) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most FROM z GROUP BY {_BY}"

# ---- binary functions


@query("fuzzy_fn_bank", f"WITH {LI_SQL} SELECT {_BY}, " + ", ".join(f'round(sum({binary.sql(k, "x[2]", "x[1]")}), 4) AS "{k}"' for k in binary.names()) + f" FROM li GROUP BY {_BY}")
def fuzzy_fn_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return li_desc(spark, sf_dir).groupBy(*BY).agg(*[F.round(F.sum(binary.column(k)(x[1], x[0])), 4).alias(k) for k in binary.names()])


_GRID = f"g AS (SELECT a.i / 100.0::DOUBLE AS x, b.i / 100.0::DOUBLE AS y FROM (SELECT unnest(range(0, 101)) AS i) a, (SELECT unnest(range(0, 101)) AS i) b), pt AS (SELECT x, y FROM g UNION SELECT round(x[2], 3), round(x[1], 3) FROM li), v AS (SELECT x, y, [{', '.join(binary.sql(k, 'x', 'y') for k in binary.names())}] AS z FROM pt)"
_NAMES = "[" + ", ".join(f"'{k}'" for k in binary.names()) + "]"
_K = len(binary.names())


@query(
    "pair_check_admissible",
    f"""WITH {LI_SQL}, {_GRID}, u AS (SELECT x, y, unnest(z) AS z, unnest(range(1, {_K + 1})) AS i FROM v WHERE (x, y) IN (SELECT x, y FROM g)),
inc AS (SELECT i, min(d) AS d FROM (SELECT i, z - lag(z) OVER (PARTITION BY i, y ORDER BY x) AS d FROM u) GROUP BY i),
lo AS (SELECT i, z FROM u WHERE x = 0 AND y = 1), hi AS (SELECT i, z FROM u WHERE x = 1 AND y = 1),
m AS (SELECT a.i AS i, b.j AS j, min(z[a.i] - z[b.j]) AS m FROM v, (SELECT unnest(range(1, {_K + 1})) AS i) a, (SELECT unnest(range(1, {_K + 1})) AS j) b GROUP BY a.i, b.j)
SELECT {_NAMES}[m.i] AS F1, {_NAMES}[m.j] AS F2, m >= -1e-9 AS dominates, inc.d >= -1e-9 AS F1_first_increasing,
  abs(l1.z) < 1e-7 AND abs(l2.z) < 1e-7 AND abs(hi.z - 1) < 1e-7 AS boundary_ok,
  m >= -1e-9 AND inc.d >= -1e-9 AND abs(l1.z) < 1e-7 AND abs(l2.z) < 1e-7 AND abs(hi.z - 1) < 1e-7 AS passes, round(m, 6) + 0.0 AS min_margin
FROM m JOIN inc ON inc.i = m.i JOIN lo l1 ON l1.i = m.i JOIN lo l2 ON l2.i = m.j JOIN hi ON hi.i = m.i""",
)
def pair_check_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.pair_checks(spark, points=_points(spark, sf_dir)).select("F1", "F2", "dominates", "F1_first_increasing", "boundary_ok", "passes", (F.round("min_margin", 6) + 0.0).alias("min_margin"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of descriptors that occur in lineitem, each once."""
    x = F.col("x")
    return li_desc(spark, sf_dir).select(F.round(x[1], 3).alias("x"), F.round(x[0], 3).alias("y")).distinct()


_CF = "UNION ALL ".join(f"SELECT 'CF_{k}' AS operator, 'CF' AS family, '{k}' AS F, NULL AS F1, NULL AS F2 " for k in binary.names())
_CC = "UNION ALL ".join(f"SELECT 'CC_{k}', 'CC', '{k}', NULL, NULL " for k in binary.names() if k in binary.COPULA_LIKE)


@query("operator_specs", f"WITH pc AS ({SQL['pair_check_admissible']}) {_CF} UNION ALL {_CC} UNION ALL SELECT 'CF1F2_' || F1 || '_' || F2, 'CF1F2', NULL, F1, F2 FROM pc WHERE passes")
def operator_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.operator_specs(spark, points=_points(spark, sf_dir))


@query("robust01_lineitem", f"WITH {LI_SQL}, z AS (SELECT {_BY}, x[1] + 2 * x[2] + 3 * x[3] + 4 * x[4] AS value FROM li) {_SUMMARY}")
def robust01_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _summary(li_desc(spark, sf_dir), x[0] + 2 * x[1] + 3 * x[2] + 4 * x[3])


# ---- integrals

_SORTED = "u AS (SELECT rid, l_returnflag, l_linestatus, x AS xs, unnest(x) AS v, unnest(range(1, 5)) AS i FROM li), r AS (SELECT *, row_number() OVER w AS k, lag(v, 1, 0.0) OVER w AS a, sum((1 << (i - 1))::BIGINT) OVER (PARTITION BY rid ORDER BY v, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS mask FROM u WINDOW w AS (PARTITION BY rid ORDER BY v, i))"


def _integral_sql(family: str, mu: str, f: str = "TP", f1: str = "TP", f2: str = "TL") -> str:
    """mu: SQL over the sorted rows (k: place, mask: coalition, i: index, xs: all values)."""
    terms = {
        "choquet": "(v - a) * m",
        "expanded": "v * m - a * m",
        "CF": binary.sql(f, "(v - a)", "m"),
        "CC": f"{binary.sql(f, 'v', 'm')} - {binary.sql(f, 'a', 'm')}",
        "CF1F2": f"CASE WHEN k = 1 THEN v ELSE {binary.sql(f1, 'v', 'm')} - {binary.sql(f2, 'a', 'm')} END",
    }
    total = "sum(t)" if family in ("choquet", "expanded") else "least(1, greatest(0, sum(t)))"
    return f"WITH {LI_SQL}, {_SORTED}, mm AS (SELECT *, {mu} AS m FROM r), z AS (SELECT rid, {_BY}, {total} AS value FROM (SELECT rid, {_BY}, {terms[family]} AS t FROM mm) GROUP BY rid, {_BY}) {_SUMMARY}"


def _power_sql(q: str) -> str:
    return f"power((5 - k) / 4.0::DOUBLE, {q})"


def _table_sql(t) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in t) + "][mask + 1]"


def _integral_query(name: str, family: str, spec: dict, mu: str, **fs: str) -> None:
    @query(name, _integral_sql(family, mu, **fs))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _summary(li_desc(spark, sf_dir), integral(F.col("x"), 4, family, spec=spec, **fs))


_POWER = {"kind": "power", "q": 0.1}
for _name, _family, _fs in (
    ("choquet_power", "choquet", {}),
    ("choquet_expanded", "expanded", {}),
    ("cf_tp", "CF", {"f": "TP"}),
    ("cf_cl", "CF", {"f": "CL"}),
    ("cc_cl", "CC", {"f": "CL"}),
    ("cc_thp", "CC", {"f": "THP"}),
    ("cf1f2_cl_cl", "CF1F2", {"f1": "CL", "f2": "CL"}),
    ("cf1f2_tp_tl", "CF1F2", {"f1": "TP", "f2": "TL"}),
):
    _integral_query(_name, _family, _POWER, _power_sql("0.1"), **_fs)

_W = [0.1, 0.2, 0.3, 0.4]
_SINGLE, _PAIRS = [0.3, 0.2, 0.25, 0.15], [[0, 0.05, 0, -0.05], [0.05, 0, 0.02, 0], [0, 0.02, 0, 0.08], [-0.05, 0, 0.08, 0]]
_FULL = [0.0, 0.2, 0.3, 0.5, 0.1, 0.4, 0.35, 0.7, 0.15, 0.45, 0.5, 0.8, 0.3, 0.6, 0.65, 1.0]
_integral_query("choquet_additive", "choquet", {"kind": "additive", "weights": _W}, _table_sql(M.additive_table(_W)))
_integral_query("capacity_sugeno", "choquet", {"kind": "sugeno_lambda", "densities": [0.3, 0.2, 0.25, 0.1]}, _table_sql(M.sugeno_table([0.3, 0.2, 0.25, 0.1])))
_integral_query("capacity_2additive", "choquet", {"kind": "two_additive", "singletons": _SINGLE, "pairs": _PAIRS}, _table_sql(M.two_additive_table(_SINGLE, _PAIRS)))
_integral_query("capacity_full_lookup", "CF1F2", {"kind": "full_capacity", "capacity_table": _FULL}, _table_sql(_FULL), f1="TM", f2="CL")
_integral_query("adaptive_power_mean", "choquet", {"kind": "adaptive_power", "mode": "mean"}, _power_sql("greatest(0.02, least(1.0, list_avg(list_transform(xs, lambda e: greatest(e, 1e-12)))))"))
_integral_query("local_additive_evidence", "choquet", {"kind": "local_additive", "mode": "evidence", "gamma": 1.5}, "sum(power(v + 1e-3, 1.5)) OVER (PARTITION BY rid ORDER BY v, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / list_sum(list_transform(xs, lambda e: power(e + 1e-3, 1.5)))")
_integral_query("local_additive_softmax", "choquet", {"kind": "local_additive", "mode": "softmax", "temperature": 4.0}, "sum(exp(4 * (v - list_max(xs)))) OVER (PARTITION BY rid ORDER BY v, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / list_sum(list_transform(xs, lambda e: exp(4 * (e - list_max(xs)))))")
# routers: one measure a label, chosen on the driver, picked by row
_ROUTER = {"kind": "context_router", "measures": {"A": {"kind": "power", "q": 0.5}, "N": {"kind": "additive", "weights": _W}}, "default": {"kind": "power", "q": 2.0}}


@query("context_router", _integral_sql("choquet", f"CASE l_returnflag WHEN 'A' THEN {_power_sql('0.5')} WHEN 'N' THEN {_table_sql(M.additive_table(_W))} ELSE {_power_sql('2.0')} END"))
def context_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda k: integral(F.col("x"), 4, "choquet", spec=_ROUTER, label=k)
    flag = F.col("l_returnflag")
    return _summary(li_desc(spark, sf_dir), F.when(flag == "A", one("A")).when(flag == "N", one("N")).otherwise(one("other")))


@query("scale_router", _integral_sql("choquet", f"CASE WHEN l_linestatus = 'O' THEN {_power_sql('0.2')} ELSE {_power_sql('0.1')} END"))
def scale_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"kind": "scale_router", "measures": {"9": {"kind": "power", "q": 0.2}}}
    one = lambda s: integral(F.col("x"), 4, "choquet", spec=spec, scale=s)
    return _summary(li_desc(spark, sf_dir), F.when(F.col("l_linestatus") == "O", one(9)).otherwise(one(17)))


@query("choquet_relational", f"WITH {EMB_SQL}, u AS (SELECT vec_id, unnest(x) AS v, unnest(range(1, 9)) AS i FROM emb), r AS (SELECT *, row_number() OVER w AS k, lag(v, 1, 0.0) OVER w AS a FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY v, i)) SELECT vec_id, round(sum((v - a) * power((9 - k) / 8.0::DOUBLE, 0.1)), 6) AS value FROM r GROUP BY vec_id")
def choquet_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    mu = [((8 - i) / 8) ** 0.1 for i in range(8)]
    return relational(emb8(spark, sf_dir), "vec_id", "x", mu, "choquet").select("vec_id", F.round("value", 6).alias("value"))


_MODE_SQL = {
    "max": "list_max(e)", "min": "list_min(e)", "prod": "list_product(e)", "mean": "list_avg(e)", "geomean": "exp(list_avg(list_transform(e, lambda q: ln(q))))",
    "harmmean": "8.0 / list_sum(list_transform(e, lambda q: 1 / q))", "lukasiewicz": "greatest(list_sum(e) - 7.0, 0.0)",
    "hamacher": "CASE WHEN list_sum(e) - list_product(e) > 1e-12 THEN list_product(e) / (list_sum(e) - list_product(e)) ELSE 0 END",
    "odiv": "(list_product(e) + list_min(e)) / 8.0", "dispersion": "list_stddev_pop(e) / (list_avg(e) + 1e-12)",
}


@query("adaptive_q_modes", f"WITH {EMB_SQL}, c AS (SELECT vec_id, list_transform(x, lambda q: greatest(least(q, 1.0), 1e-12)) AS e FROM emb) SELECT vec_id, " + ", ".join(f"round(greatest(0.02, least(1.0, {v})), 6) AS q_{k}" for k, v in _MODE_SQL.items()) + " FROM c")
def adaptive_q_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emb8(spark, sf_dir).select("vec_id", *[F.round(M.clip(M.raw_q(F.col("x"), m), 0.02, 1.0), 6).alias(f"q_{m}") for m in M.Q_MODES])


@query(
    "hetero_power",
    f"""WITH {EMB_SQL}, h AS (SELECT *, list_stddev_pop(x) AS h FROM emb), p AS (SELECT quantile_cont(h, 0.02) AS lo, quantile_cont(h, 0.98) AS hi FROM h),
c AS (SELECT vec_id, x, 0.05 + least(1, greatest(0, (h - lo) / (hi - lo))) * 1.15 AS q FROM h, p),
u AS (SELECT vec_id, q, unnest(x) AS v, unnest(range(1, 9)) AS i FROM c), r AS (SELECT *, row_number() OVER w AS k, lag(v, 1, 0.0) OVER w AS a FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY v, i))
SELECT vec_id, round(sum((v - a) * power((9 - k) / 8.0::DOUBLE, q)), 6) AS value FROM r GROUP BY vec_id""",
)
def hetero_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = 8.0
    mean = M.total(F.col("x")) / n
    e = emb8(spark, sf_dir).withColumn("h", F.sqrt(M.total(F.transform("x", lambda v: (v - mean) * (v - mean))) / n))
    e = I.robust01(e, ["h"], lo=2, hi=98)
    spec = {"kind": "heterogeneity_power", "q_min": 0.05, "q_max": 1.2}
    return e.select("vec_id", F.round(integral(F.col("x"), 8, "choquet", spec=spec, context={"heterogeneity": F.col("h")}), 6).alias("value"))


@query("measure_bank", None)
def measure_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every baseline measure on every vector, summed by label."""
    e = emb8(spark, sf_dir)
    n = 8.0
    mean = M.total(F.col("x")) / n
    e = e.withColumn("h", F.sqrt(M.total(F.transform("x", lambda v: (v - mean) * (v - mean))) / n)).withColumn("d", M.raw_q(F.col("x"), "dispersion"))
    e = I.robust01(e, ["h", "d"], lo=2, hi=98)
    context = {"heterogeneity": F.col("h"), "dispersion": F.col("d")}
    return e.groupBy("label").agg(*[F.round(F.sum(integral(F.col("x"), 8, "CF1F2", f1="CL", f2="CL", spec=s, context=context)), 6).alias(s["name"].replace(".", "_")) for s in M.registry(8)])


# ---- lattices

_MASKS = ", ".join("sum(" + ("greatest(" + ", ".join(f"x[{i + 1}]" for i in range(4) if m >> i & 1) + ", 0.0)" if m else "0.0") + ")" for m in range(16))
_LAT = f"s AS (SELECT {_BY}, [{_MASKS}] AS t FROM li GROUP BY {_BY}), lat AS (SELECT l_returnflag || '|' || l_linestatus AS name, unnest(t) / t[16] AS mu, unnest(range(0, 16)) AS mask FROM s), ed AS (SELECT l.name, i, l.mask, bit_count(l.mask) AS card, l.mu AS lower, u.mu AS upper FROM lat l, (SELECT unnest(range(0, 4))::INTEGER AS i) b JOIN lat u ON u.name = l.name AND u.mask = (l.mask | (1 << i)) WHERE l.mask & (1 << i) = 0)"


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacities that the descriptors of lineitem's groups have."""
    return L.empirical(li_desc(spark, sf_dir), BY, "x", 4)


@query("capacity_validate", f"WITH {LI_SQL}, {_LAT}, b AS (SELECT name, bool_and(CASE WHEN mask = 0 THEN abs(mu) <= 1e-8 WHEN mask = 15 THEN abs(mu - 1) <= 1e-8 ELSE true END) AS boundary_ok, bool_and(mu >= -1e-8 AND mu <= 1 + 1e-8) AS range_ok FROM lat GROUP BY name), m AS (SELECT name, bool_and(upper - lower >= -1e-8) AS monotone FROM ed GROUP BY name) SELECT name, boundary_ok, range_ok, monotone, boundary_ok AND range_ok AND monotone AS valid FROM b JOIN m USING (name)")
def capacity_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.validate(_lattice(spark, sf_dir))


@query("shapley_values", f"WITH {LI_SQL}, {_LAT} SELECT name, i, round(sum(factorial(card::INTEGER) * factorial((3 - card)::INTEGER) / 24.0 * (upper - lower)), 6) AS shapley FROM ed GROUP BY name, i")
def shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.shapley(_lattice(spark, sf_dir)).select("name", "i", F.round("shapley", 6).alias("shapley"))


@query("interaction_matrix", f"WITH {LI_SQL}, {_LAT} SELECT a.name, a.i, b.j, round(sum(factorial(a.card::INTEGER) * factorial((2 - a.card)::INTEGER) / 6.0 * (c.upper - c.lower - a.upper + a.lower)), 6) + 0.0 AS interaction FROM ed a, (SELECT unnest(range(0, 4))::INTEGER AS j) b JOIN ed c ON c.name = a.name AND c.i = a.i AND c.mask = (a.mask | (1 << j)) WHERE j > a.i AND a.mask & (1 << j) = 0 GROUP BY ALL")
def interaction_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.interaction(_lattice(spark, sf_dir)).select("name", "i", "j", (F.round("interaction", 6) + 0.0).alias("interaction"))


@query("tail_masks", f"WITH {LI_SQL}, {_SORTED} SELECT {_BY}, k::INTEGER AS k, mask, count(*) AS n FROM r GROUP BY ALL")
def tail_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = li_desc(spark, sf_dir).select(*BY, F.posexplode(M.tail_masks(F.col("x"))).alias("k", "mask"))
    return li.groupBy(*BY, (F.col("k") + 1).alias("k"), "mask").agg(F.count("*").alias("n"))


# ---- information

_RAW = f"{LI_SQL}, {_SORTED}, raw AS (SELECT rid, {_BY}, any_value(xs) AS x, round(least(1, greatest(0, sum(CASE WHEN k = 1 THEN v ELSE {binary.sql('CL', 'v', 'm')} - {binary.sql('CL', 'a', 'm')} END))), 9) AS raw FROM (SELECT *, {_power_sql('0.1')} AS m FROM r) GROUP BY rid, {_BY})"
_BITS = "cut AS (SELECT quantile_cont(raw, 0.6) AS c FROM raw), bg AS (SELECT raw AS b, count(*) AS nb FROM raw, cut WHERE raw <= c GROUP BY raw), dist AS (SELECT DISTINCT raw FROM raw), cum AS (SELECT raw, coalesce(sum(nb) OVER (ORDER BY raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx, (SELECT sum(nb) FROM bg) AS n FROM dist LEFT JOIN bg ON b = raw), bits AS (SELECT raw.*, round(-log2(greatest((n - idx + 1) / (n + 1.0::DOUBLE), 1e-9)), 9) + 0.0 AS bits FROM raw JOIN cum USING (raw))"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = li_desc(spark, sf_dir).withColumn("raw", F.round(integral(F.col("x"), 4, "CF1F2", f1="CL", f2="CL"), 9))
    return materialize(raw.select(*BY, "raw"), "raw")  # read several times


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.surprisal(_raw(spark, sf_dir), "raw").withColumn("bits", F.round("bits", 9))


@query("surprisal_bits", f"WITH {_RAW}, {_BITS}, z AS (SELECT {_BY}, bits AS value FROM bits) {_SUMMARY}")
def surprisal_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(_bits(spark, sf_dir), F.col("bits"))


_EMB_CONF = "s AS (SELECT vec_id, label, list_avg(x) AS score FROM emb), o AS (SELECT *, (row_number() OVER (ORDER BY round(score, 9), vec_id) - 1) / ((SELECT count(*) FROM s) - 1.0::DOUBLE) AS conf FROM s)"


def _emb_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb8(spark, sf_dir).select("vec_id", "label", (M.total(F.col("x")) / 8.0).alias("score")).withColumn("rounded", F.round("score", 9))
    return I.percentile_confidence(e, "rounded", ["vec_id"])


@query("percentile_confidence", f"WITH {EMB_SQL}, {_EMB_CONF} SELECT vec_id, round(conf, 9) AS conf FROM o")
def percentile_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emb_conf(spark, sf_dir).select("vec_id", F.round("conf", 9).alias("conf"))


@query("mfi_roi", f"WITH {EMB_SQL}, {_EMB_CONF} SELECT vec_id, conf >= 0.7 AS roi FROM o")
def mfi_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _emb_conf(spark, sf_dir).select("vec_id", (F.col("conf") >= 0.7).alias("roi"))


@query("gates", f"WITH {EMB_SQL}, {_EMB_CONF} SELECT label, round(sum(CASE WHEN conf >= 0.7 THEN score ELSE 0 END), 6) AS hard, round(sum(CASE WHEN conf >= 0.7 THEN score * conf ELSE 0 END), 6) AS soft FROM o GROUP BY label")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb_conf(spark, sf_dir).withColumn("roi", F.col("conf") >= 0.7)
    s, r, c = F.col("score"), F.col("roi"), F.col("conf")
    return e.groupBy("label").agg(F.round(F.sum(I.hard_gate(s, r)), 6).alias("hard"), F.round(F.sum(I.soft_gate(s, r, c)), 6).alias("soft"))


@query("roi_coverage", f"WITH {EMB_SQL}, {_EMB_CONF} SELECT round(sum(CASE WHEN conf >= 0.7 AND label = 0 THEN 1 ELSE 0 END) / greatest(sum((label = 0)::INTEGER), 1)::DOUBLE, 6) AS coverage, round(avg((conf >= 0.7)::INTEGER), 6) AS fraction FROM o")
def roi_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    roi, gt = F.col("conf") >= 0.7, F.col("label") == 0
    return _emb_conf(spark, sf_dir).agg(F.round(F.count_if(roi & gt) / F.greatest(F.count_if(gt), F.lit(1)), 6).alias("coverage"), F.round(F.avg(roi.cast("double")), 6).alias("fraction"))


@query("flagship_roi", f"WITH {_RAW}, {_BITS}, q AS (SELECT quantile_cont(bits, 0.7) AS t FROM bits) SELECT {_BY}, count(*) AS n, round(sum(raw), 4) AS total_raw, round(avg(bits), 6) AS mean_bits, round(avg((bits >= t)::INTEGER), 6) AS roi_fraction FROM bits, q GROUP BY {_BY}")
def flagship_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors, CF1F2(CL,CL) under a power measure, surprisal, and the share of rows in the region of interest."""
    b = materialize(_bits(spark, sf_dir), "bits")
    t = I.exact_quantiles(b, {"bits": [0.7]})["bits"][0]
    return b.groupBy(*BY).agg(F.count("*").alias("n"), F.round(F.sum("raw"), 4).alias("total_raw"), F.round(F.avg("bits"), 6).alias("mean_bits"), F.round(F.avg((F.col("bits") >= t).cast("double")), 6).alias("roi_fraction"))


@query("collapse_scales", f"WITH {EMB_SQL}, s AS (SELECT vec_id, unnest([33, 17, 9]) AS scale, unnest([0, 1, 2]) AS k, unnest([round(x[1], 2), round(x[2], 2), round(x[3], 2)]) AS bits FROM emb) SELECT vec_id, max(bits) AS final_bits, arg_max(scale, bits * 1000 - k) AS best_scale FROM s GROUP BY vec_id")
def collapse_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    rows = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(k).alias("scale_index"), F.round(x[k], 2).alias("bits")) for k, s in enumerate((33, 17, 9))])
    return I.collapse_scales(emb8(spark, sf_dir).select("vec_id", F.explode(rows).alias("r")).select("vec_id", "r.*"), ["vec_id"])
