"""Information, evaluation, learning, sweeps and streaming against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import measures as M
from rasterweave.operators import evaluation as E
from rasterweave.operators import information as I
from rasterweave.operators import kernels as K
from rasterweave.operators import learning as LN
from rasterweave.operators.multiscale import features, refine
from rasterweave.plans import sweep
from rasterweave.sources import synthetic
from rasterweave.streaming import scorer

rng = np.random.default_rng(4)
V = np.round(rng.gamma(2, 1, 700), 2)


@pytest.fixture(scope="module")
def nums(spark):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(V)] + [(700, float("nan")), (701, None), (702, float("inf"))], "id long, v double").cache()


def test_quantiles_both_ways(nums):
    p = [0.0, 0.01, 0.25, 0.6, 0.777, 0.995, 1.0]
    want = np.quantile(V, p).tolist()
    assert I.exact_quantiles(nums, {"v": p})["v"] == pytest.approx(want)
    old, I.FEW = I.FEW, 20
    try:
        assert I.exact_quantiles(nums, {"v": p}, small=0)["v"] == pytest.approx(want)
    finally:
        I.FEW = old
    assert I.exact_quantiles(nums.where("id < 0"), {"v": [0.5]})["v"] == [None]


def test_robust01(spark, nums):
    got = {r.id: r.v for r in I.robust01(nums.where("id < 700"), ["v"]).collect()}
    assert [got[i] for i in range(700)] == pytest.approx(K.robust01(V).tolist())
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 2.0)], "img string, v double")
    out = I.robust01(flat, ["v"], by=["img"]).groupBy("img").agg(F.sum("v").alias("s")).collect()
    assert {r.img: r.s for r in out} == {"a": 0.0, "b": 1.0}


def brute_bits(v):
    cut = np.quantile(v, 0.6)
    bg = np.sort(v[v <= cut])
    bg = np.sort(v) if len(bg) < 100 else bg
    return -np.log2((len(bg) - np.searchsorted(bg, v) + 1) / (len(bg) + 1))


def test_surprisal(spark, nums):
    got = {r.id: r.bits for r in I.surprisal(nums.where("id < 700"), "v", n_buckets=7).collect()}
    assert [got[i] for i in range(700)] == pytest.approx(brute_bits(V).tolist())
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(V)] + [("b", i, float(v)) for i, v in enumerate(V[:60])], "img string, id long, v double")
    by = {(r.img, r.id): r.bits for r in I.surprisal(d, "v", by=["img"]).collect()}
    assert [by["a", i] for i in range(700)] == pytest.approx(brute_bits(V).tolist())
    assert [by["b", i] for i in range(60)] == pytest.approx(brute_bits(V[:60]).tolist())
    thinned = I.surprisal(nums.where("id < 700"), "v", max_samples=100).agg(F.max("bits")).first()[0]
    assert 5.5 < thinned < 8


def test_surprisal_of_a_large_background(spark):
    v = np.arange(420_000) * 7919 % 420_000 / 420_000
    want = brute_bits(v)  # 252,000 background rows
    d = spark.range(420_000).select("id", (F.col("id") * 7919 % 420_000 / 420_000).alias("v"), F.lit("a").alias("img"))
    for by in ([], ["img"]):
        got = I.surprisal(d, "v", by=by).agg(F.sum("bits").alias("s"), F.max("bits").alias("m")).first()
        assert got.m == pytest.approx(want.max()) and got.s == pytest.approx(want.sum())


def test_percentile_confidence(nums):
    want = np.empty(700)
    want[np.argsort(V, kind="stable")] = np.linspace(0, 1, 700)
    for n in (1, 9):
        got = {r.id: r.conf for r in I.percentile_confidence(nums.where("id < 700"), "v", ["id"], n_buckets=n).collect()}
        assert [got[i] for i in range(700)] == pytest.approx(want.tolist())


@pytest.fixture(scope="module")
def maps(spark):
    out = []
    for k, (h, w) in enumerate(((20, 25), (18, 16))):
        s, g = np.round(rng.random((h, w)), 2), rng.random((h, w)) > 0.85
        s = np.where(g, np.minimum(1, s + 0.3), s)
        out.append((s, g))
    rows = [(f"i{k}", y, x, float(s[y, x]), bool(g[y, x])) for k, (s, g) in enumerate(out) for y in range(s.shape[0]) for x in range(s.shape[1])]
    return out, spark.createDataFrame(rows, "img string, y int, x int, v double, gt boolean").cache()


def counts(s, g, t, tol):
    p = s >= t
    return np.array([(p & K.dilate(g, tol)).sum(), p.sum(), (g & K.dilate(p, tol)).sum(), g.sum()])


def prf(c, beta=1.0):
    p, r = c[0] / max(c[1], 1), c[2] / max(c[3], 1)
    return p, r, (1 + beta**2) * p * r / max(beta**2 * p + r, 1e-12)


def brute_curve(maps, n, tol, beta=1.0):
    t = np.unique(np.quantile(np.concatenate([s.ravel() for s, _ in maps]), np.linspace(0.01, 0.995, n)))
    return np.array([[x, *prf(sum(counts(s, g, x, tol(s)) for s, g in maps), beta)] for x in t])


def brute_ap(c):
    o = np.lexsort((c[:, 0], c[:, 2]))
    r, p = c[o, 2], np.maximum.accumulate(c[o, 1][::-1])[::-1]
    r, p = np.concatenate([[0], r, [1]]), np.concatenate([[p[0]], p, [0]])
    return float(((r[1:] - r[:-1]) * (p[1:] + p[:-1]) / 2).sum())


def test_benchmark(maps):
    some, df = maps
    for tol in (0, 2):
        c = brute_curve(some, 15, lambda s, tol=tol: tol)
        got = np.array(sorted(map(tuple, E.pr_curve(df, "v", "gt", tol, 15).collect())))
        assert got == pytest.approx(c)
        m = E.benchmark(df, "v", "gt", tol, 15).first()
        assert m.ODS == pytest.approx(c[:, 3].max()) and m.AP == pytest.approx(brute_ap(c))
        assert pytest.approx(np.mean([brute_curve([x], 15, lambda s, tol=tol: tol)[:, 3].max() for x in some])) == m.OIS
        ok = c[:, 1] >= 0.5
        assert pytest.approx(c[ok, 2].max() if ok.any() else 0.0) == m.R50


def test_curve_of_rows_without_a_place(spark):
    """Documents have a score and a truth (named y here), but no place; scores that are no number count for nothing but the truth's number."""
    rows = [("a", 1.0, True), ("a", 2.0, False), (None, 3.0, True), ("b", 4.0, None), ("b", float("nan"), True), ("b", None, True), ("a", 2.0, True)]
    df = spark.createDataFrame(rows, "img string, score double, y boolean")
    finite = [(s, bool(g)) for _, s, g in rows if s is not None and s == s]
    want = []
    for t in np.unique(np.quantile([s for s, _ in finite], E.threshold_probs(5))):
        hit = sum(g for s, g in finite if s >= t)
        want.append([t, hit / max(sum(s >= t for s, _ in finite), 1), hit / 5])
    assert np.array(sorted(E.pr_curve(df, "score", "y", 0, 5).select("threshold", "precision", "recall").collect())) == pytest.approx(np.array(want))


def test_variable_tolerance(maps):
    some, df = maps
    tol = lambda s: max(1, round(0.05 * math.hypot(*s.shape)))
    assert {tol(s) for s, _ in some} == {1, 2}
    m = E.variable_tolerance(df, "v", "gt", 9, 0.05).first()
    c, half = brute_curve(some, 9, tol), brute_curve(some, 9, tol, 0.5)
    assert m.ODS == pytest.approx(c[:, 3].max()) and m.F05_ODS == pytest.approx(half[:, 3].max())
    each = [max(prf(counts(s, g, t, tol(s)))[2] for t in c[:, 0]) for s, g in some]
    assert pytest.approx(np.mean(each)) == m.OIS


def test_roc(spark, maps):
    some, df = maps
    s, g = np.concatenate([a.ravel() for a, _ in some]), np.concatenate([b.ravel() for _, b in some])
    want = np.mean([(x > s[~g]).mean() + 0.5 * (x == s[~g]).mean() for x in s[g]])
    assert E.roc_auc(df, "v", "gt", 5).first().ROC_AUC == pytest.approx(want)
    one = spark.createDataFrame([(0.5, True)], "v double, gt boolean")
    assert E.roc_auc(one, "v", "gt").first().ROC_AUC is None


X = rng.random((900, 4))
Y = (X[:, 0] + 0.7 * X[:, 1] > 0.9).astype(float)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, x.tolist(), float(y)) for i, (x, y) in enumerate(zip(X, Y))], "id long, x array<double>, y double").cache()


def test_reliability(labelled):
    p, n = X[Y == 1], X[Y == 0]
    e = np.maximum(np.maximum(p.mean(0) - n.mean(0), 0) / (0.5 * (p.std(0) + n.std(0)) + 0.05), 0.02)
    assert LN.reliability_weights(labelled, 4) == pytest.approx(e / e.sum())
    assert LN.reliability_weights(labelled.where("y = 1"), 4) == pytest.approx(0.25)


def test_learners(labelled):
    loss = lambda t: ((np.array([r.v for r in labelled.select("id", capacity(t).alias("v")).orderBy("id").collect()]) - Y) ** 2).mean()
    from rasterweave.operators.choquet import integral

    def capacity(t):
        return integral(F.col("x"), 4, "choquet", spec={"kind": "capacity", "capacity_table": list(t)})

    a, two, full = LN.learn_additive(labelled, 4), LN.learn_two_additive(labelled, 4), LN.learn_full(labelled, 4)
    for m in (a, two, full, LN.learn_sugeno(labelled, 4)):
        assert M.is_capacity(m["capacity_table"], 1e-5)
    start = loss(M.additive_table(LN.reliability_weights(labelled, 4)))
    la, l2, lf = loss(a["capacity_table"]), loss(two["capacity_table"]), loss(full["capacity_table"])
    assert la <= start + 1e-6 and l2 <= la + 1e-3 and lf <= l2 + 1e-3
    w = np.array(a["weights"])  # no simplex point nearby does better
    for _ in range(50):
        v = np.clip(w + rng.normal(0, 0.05, 4), 0, None)
        v /= v.sum()
        assert ((X @ v - Y) ** 2).mean() >= la - 1e-4
    with pytest.raises(ValueError):
        LN.learn_full(labelled, LN.MOST + 1)


def test_gram_and_banks(labelled):
    g, c, n = LN.gram(labelled, [F.col("x")[i] for i in range(4)], F.col("y"))
    assert n == 900 and g == pytest.approx(X.T @ X / 900) and c == pytest.approx(X.T @ Y / 900)
    specs = LN.learned_specs(labelled.withColumn("ctx", F.when(F.col("id") % 2 == 0, "a").otherwise("b")), 4, context="ctx")
    assert specs["additive_by_ctx"]["measures"].keys() == {"a", "b"} and M.resolve(specs["additive_by_ctx"], label="a")["kind"] == "additive"
    assert len(LN.interpretability(specs, list("abcd"))) > 20


def test_samples(labelled):
    s = LN.balanced_sample(labelled, max_samples=100).groupBy("y").count().collect()
    assert {r["count"] for r in s} == {50}
    assert LN.balanced_sample(labelled.where("y = 1"), max_samples=30).count() == 30
    again = lambda: sorted(r.id for r in LN.balanced_sample(labelled, max_samples=60, seed=3).collect())
    assert again() == again()


def test_centroids(labelled):
    t = labelled.select("id", "y", *[F.col("x")[i].alias(f"f{i}") for i in range(4)])
    c, s = LN.fit_centroids(t, "y", [f"f{i}" for i in range(4)])
    got = {r.id: r.predicted for r in LN.nearest_centroid(t, "id", "y", c, s, [f"f{i}" for i in range(4)]).collect()}
    z = (X - X.mean(0)) / (X.std(0) + 1e-8)
    d = np.stack([((z - z[y == Y].mean(0)) ** 2).sum(1) for y in (0.0, 1.0)], 1)
    assert [got[i] for i in range(900)] == d.argmin(1).tolist()


def test_multiscale(spark):
    scales = (9, 5)
    px = synthetic.cases(spark, 40).where("img IN ('circle', 'box')")
    out = refine(features(px, scales), scales, 8, f1="CL", f2="CL").collect()
    from rasterweave.functions import binary as B

    for img in ("circle", "box"):
        v = {(r.y, r.x): r.v for r in px.where(F.col("img") == img).collect()}
        a = np.array([[v[y, x] for x in range(40)] for y in range(40)])
        active = np.ones((40, 40), bool)
        for k, s in enumerate(scales):
            x, _, hetero = K.descriptors(a, s)
            xs = np.sort(x, -1)
            mu = np.array([((8 - i) / 8) ** 0.1 for i in range(8)])
            raw = np.clip(xs[..., 0] + (B.array("CL")(xs[..., 1:], mu[1:]) - B.array("CL")(xs[..., :-1], mu[1:])).sum(-1), 0, 1).round(12)
            bits = brute_bits(raw.ravel()).reshape(raw.shape)
            bits = np.where(active, bits, 0) if k else bits
            got = np.zeros_like(bits)
            on = np.zeros_like(active)
            for r in out:
                if r.img == img and r.scale == s:
                    got[r.y, r.x], on[r.y, r.x] = r.bits, r.active
            assert (np.abs(got - bits) > 1e-6).mean() < 0.01
            hot = (bits >= np.quantile(bits[active], 0.82)) | (hetero >= np.quantile(hetero[active], 0.82))
            nxt = K.dilate(hot & active, 3)
            assert (on != nxt).mean() < 0.02
            active = on


def test_rankings(spark):
    d = spark.createDataFrame([("a", 1, 0.5, None), ("a", 2, 0.7, None), ("a", 3, 0.6, 9.0), ("b", 4, 0.1, 1.0)], "m string, c int, ODS double, z double")
    best = {r.m: (r.c, r.z) for r in sweep.best_per(d, ["m"], ["ODS"], ["c", "z"]).collect()}
    assert best == {"a": (2, 9.0), "b": (4, 1.0)}
    top = sweep.rank(d, ["ODS"], ["c"], 2).orderBy("selection_rank").collect()
    assert [(r.c, r.selection_rank) for r in top] == [(2, 1), (3, 2)]
    assert sweep.grid(spark, a=[1, 2], b=["x", "y", "z"]).count() == 6
    ctx = spark.createDataFrame([("gaussian",), ("motion",), ("texture",), ("clean",)], "f string").select(sweep.coarse_context(F.col("f")).alias("c")).collect()
    assert [r.c for r in ctx] == ["stochastic", "blur_motion", "texture_compound", "structural"]


def test_frozen_background_stream(spark, tmp_path, nums):
    bg = scorer.Background.fit(nums.where("id < 700"), "v")
    static = {r.id: r.bits for r in scorer.score(nums.where("id < 700"), "v", bg).collect()}
    assert [static[i] for i in range(700)] == pytest.approx(brute_bits(V).tolist())
    src = nums.where("id < 700").withColumn("ts", F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scorer.read_files(spark, str(tmp_path / "in"), src.schema)
    q = scorer.surprising(scorer.score(stream, "v", bg), "ts", "bits", 3.0, late="30 days").writeStream.format("memory").queryName("surprising").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    total = spark.table("surprising").agg(F.sum("n"), F.sum("surprising")).first()
    assert tuple(total) == (700, int((brute_bits(V) >= 3).sum()))


def test_quantiles_of_large_columns_need_no_sketches(spark, monkeypatch):
    """Counts by bin and then by value, also where a column has no value, one value, or others that are not finite."""
    d = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("a"), F.lit(3.0).alias("b"), F.when(F.col("id") < 0, 1.0).alias("c"), F.when(F.col("id") % 2 == 0, float("inf")).otherwise(F.col("id") / 7).alias("d"))
    p = [0.0, 0.013, 0.5, 0.99, 1.0]
    want = I.exact_quantiles(d, dict.fromkeys("abcd", p))

    def no(*_):
        raise AssertionError("a sketch was asked for")

    monkeypatch.setattr(F, "percentile_approx", no)
    monkeypatch.setattr("rasterweave.operators.ordering.WHOLE", 100)
    assert I.exact_quantiles(d, dict.fromkeys("abcd", p), small=0) == want and want["c"] == [None] * 5


def test_surprisal_keeps_rows_in_place_where_values_are_few(spark):
    """Many rows with few different values: the values' bits are sent to the rows, which are not shuffled; above the bound they are joined by a shuffle."""
    d = spark.range(4000).select("id", (F.col("id") % 50 / 50.0).alias("v"))
    old, spark_limit = I.FEW, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = I.surprisal(d, "v")
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        I.FEW = 10
        large = I.surprisal(d, "v")
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(small.collect()) == sorted(large.collect())
    finally:
        I.FEW = old
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", spark_limit)


def test_both_betas_of_a_variable_tolerance_read_one_count(maps, monkeypatch):
    """Thresholds and scores around truth were made anew for each beta."""
    calls = []
    for name in ("prepared", "exact_quantiles"):
        monkeypatch.setattr(E, name, lambda *a, f=getattr(E, name), n=name: calls.append(n) or f(*a))
    E.variable_tolerance(maps[1], "v", "gt", 9, 0.05).first()
    assert sorted(calls) == ["exact_quantiles", "prepared"]


def test_variable_tolerance_of_no_image(maps):
    m = E.variable_tolerance(maps[1].where("false"), "v", "gt", 9).first()
    assert (m.ODS, m.ODS_threshold, m.F05_ODS, m.R50) == (0.0, 0.0, 0.0, 0.0) and m.OIS is None


def test_quantiles_of_many_columns_read_a_table_once(spark, monkeypatch):
    from rasterweave.operators import ordering as O

    monkeypatch.setattr(O, "WHOLE", 10)
    d = spark.range(300).selectExpr("id % 2 as g", *[f"IF(id % 7 = {i}, double('nan'), double((id * {i + 3}) % 101)) as c{i}" for i in range(5)])
    seen = []
    monkeypatch.setattr(O, "materialize", lambda t, name, f=O.materialize: seen.append((name, t._jdf.queryExecution().optimizedPlan().toString())) or f(t, name))
    got = {r.g: r for r in O.group_quantiles(d, ["g"], {f"c{i}": [0.0, 0.31, 1.0] for i in range(5)}).collect()}
    p = d.toPandas()
    for g, own in p.groupby("g"):
        for i in range(5):
            assert list(got[g][f"c{i}"]) == pytest.approx(np.nanquantile(own[f"c{i}"], [0.0, 0.31, 1.0]))
    assert {"bins", "values"} <= {n for n, _ in seen} and not any("Union" in plan for _, plan in seen)
