"""Integrals of large groups, table functions, routed measures, iterated filters and the learners' optimality."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import measures as M
from rasterweave.functions import routing, tables
from rasterweave.operators import kernels as K
from rasterweave.operators import learning as LN
from rasterweave.operators import ordering as O
from rasterweave.operators import tiles as T
from rasterweave.operators.choquet import aggregate

from .test_tiles import arrays, frame

G = np.random.default_rng(29)


# ---- integrals of groups


def integral(v, q, family, f=lambda a, b: a * b):
    v = np.sort(v)
    w = (np.arange(len(v), 0, -1) / len(v)) ** q
    a = np.concatenate([[0.0], v[:-1]])
    if family == "choquet":
        return ((v - a) * w).sum()
    return np.clip((f(v - a, w) if family == "cf" else f(v, w) - f(a, w)).sum(), 0, 1)


@pytest.mark.parametrize("whole", [10, 10**9])
def test_integrals_of_groups(spark, monkeypatch, whole):
    monkeypatch.setattr(O, "WHOLE", whole)
    rows = [("a" if i % 3 else None, float(v)) for i, v in enumerate(np.round(G.random(3000), 2))] + [("one", 0.3), ("odd", float("nan")), ("odd", None), ("odd", 0.7)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    groups = {k: np.array([v for g, v in rows if g == k and v is not None and v == v]) for k in ("a", None, "one", "odd")}
    for family, f in (("choquet", None), ("cf", lambda a, b: a * b), ("cc", np.minimum)):
        got = {r.g: r for r in aggregate(df, ["g"], "v", lambda s: F.pow(s, F.lit(0.6)), family, "TM" if family == "cc" else "TP").collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            assert got[k].n == len(v) and got[k].integral == pytest.approx(integral(v, 0.6, family, f))
    assert aggregate(df.where("false"), ["g"], "v", lambda s: s).collect() == []
    with pytest.raises(ValueError):
        aggregate(df, ["g"], "v", lambda s: s, "CF1F2")


# ---- table functions


def test_raster_runs(spark):
    rows = [(f"i{k}", y, x, float(v) if v >= 0.1 else None) for k in range(2) for y in range(6) for x, v in enumerate(G.random(25)) if x % 11 != 5]
    df = spark.createDataFrame(rows, "img string, y int, x int, v double").repartition(4)
    want = []
    for k in range(2):
        for y in range(6):
            run = None
            for _, _, x, v in sorted(r for r in rows if r[0] == f"i{k}" and r[1] == y):
                ok = v is not None and v >= 0.5
                if run and (not ok or x != run[3] + 1):
                    want.append(tuple(run))
                    run = None
                if ok:
                    run = [f"i{k}", y, x, x, v] if run is None else [*run[:3], x, run[4] + v]
            if run:
                want.append(tuple(run))
    plain = lambda rows: sorted((*r[:4], round(r[4], 9)) for r in rows)
    assert plain(tables.runs(df, 0.5).collect()) == plain(want)
    tables.register(spark)
    df.createOrReplaceTempView("some_pixels")
    assert spark.sql("SELECT count(*) AS n FROM raster_runs(TABLE(some_pixels), 0.5D)").first().n == len(want)
    for bad in ("SELECT * FROM raster_runs(TABLE(SELECT img, y FROM some_pixels), 0.5D)", "SELECT * FROM raster_runs(TABLE(some_pixels), CAST(NULL AS DOUBLE))", "SELECT * FROM raster_runs(1, 0.5D)"):
        with pytest.raises(Exception, match="raster_runs"):
            spark.sql(bad).collect()


# ---- routed measures


def test_routes(spark):
    texts = [("a", '{"kind": "power", "q": 0.5}'), ("b", '{"kind":"additive","weights":[3,1,0,9]}'), ("bad", "{"), ("zero", '{"kind":"power","q":0}'), ("odd", '{"kind":"sugeno"}'), (None, '{"kind":"power","q":2}'), ("default", '{"kind":"POWER","q":2,"more":{"x":[1]}}'), ("a", '{"kind": "additive", "weights": [1]}')]
    of = routing.models(spark.createDataFrame(texts, "label string, model string"))
    held = of.first().models
    assert set(held) == {"a", "b", "default"} and held["default"].q == 2 and held["b"].weights == [3, 1, 0, 9] and held["a"].kind == "power"
    x = np.round(G.random((40, 3)), 2)
    labels = ["a", "b", "nowhere", None]
    df = spark.createDataFrame([(i, labels[i % 4], [float(v) for v in r]) for i, r in enumerate(x)], "id long, label string, x array<double>")
    z = df.crossJoin(F.broadcast(of)).withColumn("m", routing.route(F.col("models"), F.col("label"))).withColumn("v", routing.routed_choquet(F.col("x"), 3, F.col("m")))
    for r in z.collect():
        s = np.sort(r.x)
        d = np.diff(np.concatenate([[0], s]))
        if r.label == "b":
            w = np.array([0.75, 0.25, 0.0])[np.argsort(r.x, kind="stable")]
            mu = np.cumsum(w[::-1])[::-1]
        else:
            mu = (np.array([3, 2, 1]) / 3) ** (0.5 if r.label == "a" else 2)
        assert r.v == pytest.approx((d * mu).sum())
    more = routing.spec_map({"b": {"kind": "power", "q": 1.0}, "new": {"kind": "additive", "weights": [1.0]}})
    both = of.select(routing.override(F.col("models"), more).alias("m")).first().m
    assert both["b"].q == 1 and both["new"].weights == [1] and both["a"].q == 0.5
    empty = routing.models(spark.createDataFrame([], "label string, model string"))
    assert df.crossJoin(empty).select(routing.route(F.col("models"), F.col("label")).alias("m")).first().m.q == 0.1


# ---- iterated filters


def test_diffusion_over_borders_that_meet(spark):
    images = [G.random((40, 23)), G.random((7, 50)), G.random((3, 2))]
    for tile in (16, 64):
        for a, img in zip(arrays(T.diffusion(frame(spark, images), "v", "o", 10, tile=tile), "o", images), images, strict=True):
            assert np.allclose(a, K.anisotropic(img, 10))


def test_gravity_in_rounds(spark):
    images = [G.random((70, 30)), np.pad(G.random((20, 20)), 10)]
    for a, img in zip(arrays(T.gravitational(frame(spark, images), "v", "o", iterations=3, tile=32), "o", images), images, strict=True):
        assert np.allclose(a, K.gravitational(img, iterations=3))


def test_gravity_goes_all_rounds(spark, monkeypatch):
    """The query did 6 of the filter's 30 rounds; each round left its tables on the disk."""
    import inspect

    from rasterweave.plans import queries_raster as Q

    seen = {}
    monkeypatch.setattr(Q.T, "gravitational", lambda d, v, o, f=T.gravitational, **more: seen.update(inspect.signature(f).bind(d, v, o, **more).arguments) or d.withColumnRenamed(v, o))
    Q.gravity_rounds(spark, "/root/testdata/sf0.001")
    assert seen.get("iterations", 30) == inspect.signature(K.gravitational).parameters["iterations"].default == 30


def test_gravity_leaves_one_table(spark):
    import os

    kept = lambda: {n for n in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) if n.startswith("gravity-")}
    before = kept()
    T.gravitational(frame(spark, [G.random((9, 9))]), "v", "o", iterations=3).count()
    assert len(kept() - before) == 2  # the radii and the result


def test_gravity_of_a_long_image(spark):
    """The square of this many rows is no int any more."""
    rows, frac = 47_000, 2.5 / 47_000
    a = G.random((rows, 1))
    d = spark.createDataFrame(pd.DataFrame({"img": "i0", "y": np.arange(rows, dtype=np.int32), "x": np.zeros(rows, np.int32), "v": a[:, 0]}), "img string, y int, x int, v double")
    got = T.gravitational(d, "v", "o", iterations=1, interaction_radius_frac=frac).orderBy("y").toPandas()["o"].to_numpy()
    assert np.allclose(got, K.gravitational(a, iterations=1, interaction_radius_frac=frac)[:, 0])


# ---- learners


def optimal(g, c, a, lo, hi, z, u, tol=1e-4):
    """The conditions of the least squares program with lo <= az <= hi: feasible, stationary, multipliers of the right sign where a bound holds."""
    az = a @ z
    assert (az >= lo - tol).all() and (az <= hi + tol).all()
    assert np.abs(g @ z - c + a.T @ u).max() < tol
    assert (u[az < hi - 10 * tol] <= tol).all() and (u[az > lo + 10 * tol] >= -tol).all()


@pytest.fixture(scope="module")
def eight():
    x = G.random((400, 8))
    y = np.clip(0.5 * x.min(1) + 0.5 * x[:, 0] * x[:, 1] + 0.1 * G.normal(size=400), 0, 1)
    return x, y


def test_additive_and_two_additive_are_optimal(eight):
    x, y = eight
    n = 8
    g, c = x.T @ x / len(x) + 1e-4 * np.eye(n), x.T @ y / len(x) + 1e-4 / n
    a = np.vstack([np.eye(n), np.ones((1, n))])
    lo, hi = np.append(np.zeros(n), 1.0), np.append(np.ones(n), 1.0)
    optimal(g, c, a, lo, hi, *LN.solve(g, c, a, lo, hi, np.full(n, 1 / n)))
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    d = np.hstack([x, np.stack([np.minimum(x[:, i], x[:, j]) for i, j in pairs], 1)])
    p = d.shape[1]
    g, c = d.T @ d / len(x), d.T @ y / len(x)
    g[n:, n:] += 1e-4 * np.eye(len(pairs))
    a = np.vstack([np.eye(p), np.ones((1, p))])
    lo, hi = np.concatenate([np.zeros(n), -np.ones(len(pairs)), [1.0]]), np.ones(p + 1)
    z, u, rows = LN.solve_lazily(g, c, a, lo, hi, np.append(np.full(n, 1 / n), np.zeros(len(pairs))), LN.two_additive_broken(n))
    optimal(g, c, np.vstack([a, rows]), np.concatenate([lo, np.zeros(len(rows))]), np.concatenate([hi, np.full(len(rows), np.inf)]), z, u)
    # every one of the n * 2**(n - 1) conditions holds, also those that never became rows
    member = (np.arange(1 << (n - 1))[:, None] >> np.arange(n - 1)) & 1
    for i in range(n):
        w = [z[n + pairs.index((min(i, j), max(i, j)))] for j in range(n) if j != i]
        assert (z[i] + member @ np.array(w)).min() > -1e-5
    assert len(rows) < n * 2 ** (n - 1) / 4


def choquet_design(x):
    n = x.shape[1]
    out = np.zeros((len(x), 1 << n))
    for r, v in enumerate(x):
        o = np.argsort(v, kind="stable")
        mask, last = (1 << n) - 1, 0.0
        for i in o:
            out[r, mask] += v[i] - last
            last, mask = v[i], mask & ~(1 << i)
    return out


def test_full_is_optimal(eight):
    x, y = eight
    n, full = 8, 255
    d = choquet_design(x)
    d, t = d[:, 1:full], y - d[:, full]
    p = full - 1
    g, c = d.T @ d / len(x) + 5e-4 / p * np.eye(p), d.T @ t / len(x) + 5e-4 / p * np.array([(m.bit_count() / n) ** 0.1 for m in range(1, full)])
    z, u, rows = LN.solve_lazily(g, c, np.eye(p), np.zeros(p), np.ones(p), np.linspace(0, 1, p), LN.full_broken(n))
    a = np.vstack([np.eye(p), rows])
    optimal(g, c, a, np.zeros(len(a)), np.concatenate([np.ones(p), np.full(len(rows), np.inf)]), z, u, 1e-4)
    assert all(z[(m | 1 << i) - 1] >= z[m - 1] - 1e-5 for m in range(1, full) for i in range(n) if not m >> i & 1 and m | 1 << i != full)


def test_ten_criteria(spark):
    n = 10
    x = np.round(G.random((1500, n)), 6)
    y = np.clip(0.6 * np.sort(x, 1)[:, 2] + 0.4 * x[:, 3] * x[:, 4] + 0.05 * G.normal(size=1500), 0, 1)
    df = spark.createDataFrame([(i, v, float(t)) for i, (v, t) in enumerate(zip(x.tolist(), y, strict=True))], "id long, x array<double>, y double")
    full, two = LN.learn_full(df, n), LN.learn_two_additive(df, n)
    d = choquet_design(x)
    loss = lambda m: ((d @ np.array(m["capacity_table"]) - y) ** 2).mean()
    assert M.is_capacity(full["capacity_table"], 1e-6) and loss(full) <= loss(two) + 1e-4
    assert full["n_edges"] < n * 2 ** (n - 1)
    with pytest.raises(ValueError):
        LN.learn_full(df, LN.MOST + 1)


def test_small_and_wide_designs_give_one_gram(spark, eight, monkeypatch):
    x, y = eight
    df = spark.createDataFrame([(v, float(t)) for v, t in zip(x.tolist(), y, strict=True)], "x array<double>, y double")
    cols = [F.col("x")[i] for i in range(8)]
    few = LN.gram(df, cols, F.col("y"))
    monkeypatch.setattr(LN, "FEW", 0)
    many = LN.gram(df, cols, F.col("y"))
    assert few[2] == many[2] == 400 and np.allclose(few[0], many[0]) and np.allclose(few[1], many[1]) and np.allclose(few[0], x.T @ x / 400)


def test_models_are_json(spark):
    spec = {"kind": "power", "q": 0.3}
    assert json.loads(spark.range(1).select(F.to_json(routing.route(routing.spec_map({"default": spec}), F.lit(None).cast("string")))).first()[0]) == spec


def test_days_of_events_are_not_sent_to_all_tasks(spark, tmp_path):
    """Spark chose to send all the images' sums by way of the driver, as they are small in a file; days past the thirtieth and null keys have no pixel."""
    from rasterweave.plans.views import ev_img

    rows = [(u, k, f"2024-01-{d:02d} 10:00:00", v) for u, k, d, v in ((0, "a", 1, 1.5), (0, "a", 1, 2.0), (1, "b", 30, 4.0), (1, "b", 31, 8.0), (None, "a", 2, 9.0), (0, "b", 3, None))]
    spark.createDataFrame(rows, "user_id long, event_type string, t string, value double").selectExpr("user_id", "event_type", "timestamp(t) as ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    d = ev_img(spark, str(tmp_path))
    got = {(r.img, r.y, r.x): r.v for r in d.collect()}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert len(got) == 2 * 3 * 30 and {k: v for k, v in got.items() if v} == {("a", 0, 0): 3.5, ("b", 1, 29): 4.0}
    assert "BroadcastHashJoin" not in plan.split("Initial Plan")[0]
