"""Experiment drivers on a few small generated images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import measures as M
from rasterweave.operators import evaluation as E
from rasterweave.plans import experiments as X
from rasterweave.plans import sweep
from rasterweave.sources import synthetic

OPTIONS = {"scales": (5, 3)}


@pytest.fixture(scope="module")
def images(spark):
    return X.materialize(synthetic.cases(spark, 32).where("img IN ('vertical', 'box')"), "images")


def test_grouped_benchmark_is_the_plain_one(images):
    two = images.withColumn("config", F.lit("a")).union(images.withColumn("v", 1 - F.col("v")).withColumn("config", F.lit("b")))
    got = {r.config: r for r in E.benchmark_by(two, "v", "gt", ["config"], 1, 11).collect()}
    for k, d in (("a", images), ("b", images.withColumn("v", 1 - F.col("v")))):
        want = E.benchmark(d, "v", "gt", 1, 11).first()
        for c in ("ODS", "ODS_threshold", "OIS", "AP", "R50", "ROC_AUC"):
            assert got[k][c] == pytest.approx(want[c]), c


def test_classic_and_canny(images):
    r = X.classic(images, ("scharr", "sobel"), (0.6, 0.8), (0, 1), 11, **OPTIONS).collect()
    assert len(r) == 2 * 2 * 2 * 2 and [x.selection_rank for x in r] == list(range(1, 17)) and r[0].ODS >= r[-1].ODS and r[0].ODS > 0.5
    c = X.canny_grid(images, (1.0,), ((0.6, 0.8), (0.8, 0.95)), **OPTIONS).collect()
    assert len(c) == 2 and all(0 <= x.AP <= 1 for x in c)


def test_staged_selection(spark, images):
    out = X.staged(images, images, ("none", "median"), n_thresholds=3, **OPTIONS)
    assert out["chosen"]["preconditioner"] in ("none", "median") and len(out["linkers"]) == 3
    assert out["per_image"].count() == 2 and 0 < out["pooled"].first().F1 <= 1


def test_measures_and_chunks(spark, images, tmp_path):
    ranked, tested = X.competition(spark, images, images, images, top=2, n_thresholds=7)
    assert ranked.count() == 2 == tested.count()
    ops = [r.asDict() for r in sweep.operator_specs(spark, "knownpairs").collect()][:3]
    some = [m for m in M.registry(8) if m["name"] in ("power_q0.1", "additive_uniform")]
    path = str(tmp_path / "f")
    assert X.factorial(spark, images, path, ops, some, 2, n_thresholds=5) == [(0, 2), (2, 3)]
    assert X.factorial(spark, images, path, ops, some, 2, n_thresholds=5) == []
    assert spark.read.parquet(path).count() == 6


def test_array_measures_are_the_columns(spark):
    """All kinds that the competition ranks, on random descriptors."""
    import numpy as np

    from rasterweave.functions import binary
    from rasterweave.operators import kernels as K
    from rasterweave.operators.choquet import integral

    rng = np.random.default_rng(8)
    x, h = rng.random((150, 8)).round(2), rng.random(150)
    full = {"kind": "full_capacity", "capacity_table": [(m.bit_count() / 8) ** (0.3 + 0.1 * (m & 1)) if m not in (0, 255) else m / 255 for m in range(256)]}
    specs = M.registry(8, {"full": full, "router": {"kind": "scale_router", "measures": {"5": full}, "default": M.DEFAULT}, "sugeno": {"kind": "sugeno_lambda", "capacity_table": M.sugeno_table([0.1] * 8).tolist()}})
    assert len(specs) == 24 + 3
    w = K.reliability(x.reshape(10, 15, 8), 5, 1e-3).reshape(150, 8)
    d = spark.createDataFrame([(i, r.tolist(), float(v), u.tolist()) for i, (r, v, u) in enumerate(zip(x, h, w))], "id int, x array<double>, h double, w array<double>")
    columns = {"heterogeneity": F.col("h"), "dispersion": F.col("h"), "weights": F.col("w")}
    arrays = {"heterogeneity": lambda: h, "dispersion": lambda: h, "weights": lambda size, floor: w}
    xs, cl = np.sort(x, -1), binary.array("CL")
    got = d.orderBy("id").select(*[integral(F.col("x"), 8, "CF1F2", f1="CL", f2="CL", spec=s, scale=5, context=columns).alias(f"m{i}") for i, s in enumerate(specs)]).toPandas()
    for i, s in enumerate(specs):
        mu = M.array_tails(x, s, 5, None, arrays)
        want = np.clip(xs[:, 0] + (cl(xs[:, 1:], mu[:, 1:]) - cl(xs[:, :-1], mu[:, 1:])).sum(-1), 0, 1)
        assert got[f"m{i}"].to_numpy() == pytest.approx(want), s["name"]


def test_array_benchmark_is_the_plain_one(images):
    from rasterweave.operators import kernels as K

    d = images.toPandas()
    m = K.benchmark([tuple(K.to_raster(g, ["v", "gt"])) for _, g in d.groupby("img")], E.threshold_probs(11), 2)
    plain = E.benchmark(images, "v", "gt", 2, 11).first()
    for c in m:
        assert m[c] == pytest.approx(plain[c]), c


def test_array_multiscale_is_the_columns(images):
    from rasterweave.operators import kernels as K
    from rasterweave.operators.information import collapse_scales
    from rasterweave.operators.multiscale import features, refine

    spec = {"kind": "local_additive", "mode": "reliability", "window": 5}
    feats = X.materialize(features(images, (5, 3), "oriented"), "features")
    got = collapse_scales(refine(feats, (5, 3), 8, f1="CL", f2="CL", spec=spec), ["img", "y", "x"]).toPandas()
    for i, f in images.toPandas().groupby("img"):
        v = K.to_raster(f, ["v"])[0]
        want = K.multiscale([K.descriptors(v, s, "oriented")[::2] for s in (5, 3)], (5, 3), spec)
        assert (abs(K.to_raster(got[got["img"] == i], ["final_bits"])[0] - want) > 1e-6).mean() < 0.02


def test_competition_ranks_all_measures(images, monkeypatch):
    from rasterweave.operators import learning as LN

    for name in ("learn_additive", "learn_sugeno", "learn_two_additive", "learn_full"):
        monkeypatch.setattr(LN, name, lambda d, n, **k: {"kind": "additive", "weights": [1 / n] * n})
    specs = M.registry(8, X.competing(X.prepared_images(images), (5, 3), "oriented"))
    assert len({s["name"] for s in specs}) == 38 and len(X.REGION_QS) == 8
    assert sum(s.get("kind") == "context_router" for s in specs) == 4 and sum(s.get("kind") == "scale_router" for s in specs) == 2


def test_region_cost(images):
    r = X.region_cost(X.mfi(images, **OPTIONS), "median").collect()
    assert len(r) == 2 and all(0 < x.share <= 1 and x.difference < 0.05 for x in r)


def test_measures_that_need_the_image(images):
    from rasterweave.operators.multiscale import multiscale_detect

    for spec in ({"kind": "local_additive", "mode": "reliability"}, {"kind": "heterogeneity_power"}, {"kind": "adaptive_power", "mode": "dispersion"}):
        d = multiscale_detect(images, (5,), spec=spec)
        assert d.count() == 2 * 32 * 32 and d.where("final_bits IS NULL OR isnan(final_bits)").count() == 0


def test_images_decoded_by_the_source_equal_ours(spark, tmp_path):
    from rasterweave.sources import files

    a = np.random.default_rng(4).integers(0, 256, (9, 7, 3)).astype(np.uint8)
    (tmp_path / "one.png").write_bytes(files.encode_png(a))
    jpeg = spark._jvm.java.io.File(str(tmp_path / "two.jpg"))
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(str(tmp_path / "one.png")))
    assert spark._jvm.javax.imageio.ImageIO.write(image, "jpg", jpeg)
    ours = {(r.y, r.x): r.v for r in files.read_images(spark, str(tmp_path)).collect()}
    got = files.read_decoded(spark, str(tmp_path)).collect()
    assert {(r.y, r.x): r.v for r in got if r.img == "one"} == pytest.approx(ours)
    assert sum(r.img == "two" for r in got) == 63


def test_counts_of_many_points_from_one_row_a_pixel(spark):
    """Fifty points (more than one word of bits): counts as of each binary map by itself; only edges are rows."""
    from rasterweave.operators import kernels as K

    rng = np.random.default_rng(8)
    gt, maps = rng.random((70, 9)) < 0.1, rng.random((50, 70, 9)) < rng.random(50)[:, None, None] * 0.2
    maps[7] = False
    at = [(y, x) for y in range(70) for x in range(9)]
    truth = spark.createDataFrame([("a/b", y, x, bool(gt[y, x])) for y, x in at], "img string, y int, x int, gt boolean")
    on = spark.createDataFrame([("a/b", int(y), int(x), int(no)) for no, y, x in zip(*np.nonzero(maps), strict=True)], "img string, y int, x int, no int")
    got = {r.k: r for r in X._counts(on, truth, [(f"k{i}", i / 50) for i in range(50)], ["k", "low"], 2).collect()}
    assert len(got) == 50
    for i in range(50):
        near, want = K.dilate(maps[i], 2), got[f"k{i}"]
        assert (want.img, want.low, want.mp, want.npred, want.mg, want.ngt) == ("a/b", i / 50, (maps[i] & K.dilate(gt, 2)).sum(), maps[i].sum(), (gt & near).sum(), gt.sum())


def test_measures_of_an_image_go_in_groups(images):
    """An image's measures used to be one group; each now gives what it gives by itself."""
    from pyspark.sql import functions as F
    from rasterweave.operators import kernels as K

    some = images.withColumns({"oracle": F.col("img"), "estimated": F.col("img")})
    specs = [m for m in M.registry(8) if m.get("kind") != "context_router"][: X.TOGETHER + 1]
    got = X.gated_by_measure(some, [(m, (0.5, 0.8)) for m in specs], (5, 3), "oriented").toPandas()
    assert len(got) == 2 * 2 * len(specs) == len(got.drop_duplicates(["measure", "roi_q", "img"]))
    frames = {i: K.to_raster(f, ["v"])[0] for i, f in images.toPandas().groupby("img")}
    for spec in specs:
        for i, v in frames.items():
            conf = K.ordinal(K.multiscale([K.descriptors(v, s, "oriented")[::2] for s in (5, 3)], (5, 3), spec))
            score = K.suppress(K.detector(v, "scharr"), K.orientation(v)) * (conf >= 0.8)
            row = got[(got["measure"] == spec["name"]) & (got["img"] == i) & (got["roi_q"] == 0.8)].iloc[0]
            assert list(row["at"]) == list(score.ravel().nonzero()[0]) and list(row["score"]) == list(score[score != 0])


def test_staged_selection_makes_maps_once(spark, images, monkeypatch):
    """The chosen preconditioner's maps were made a second time for the linkers."""
    calls = []
    monkeypatch.setattr(X, "detector_maps", lambda *a, f=X.detector_maps, **k: calls.append(1) or f(*a, **k))
    X.staged(images, images, ("none",), n_thresholds=3, methods=(("none", {}),), **OPTIONS)
    assert len(calls) == 2


def test_chunks_share_descriptors(spark, images, tmp_path, monkeypatch):
    """Each chunk made the descriptors anew."""
    calls = []
    monkeypatch.setattr(X, "features", lambda *a, f=X.features, **k: calls.append(1) or f(*a, **k))
    ops = [r.asDict() for r in sweep.operator_specs(spark, "knownpairs").collect()][:2]
    some = [m for m in M.registry(8) if m["name"] == "additive_uniform"]
    for _ in range(2):
        X.factorial(spark, images, str(tmp_path / "f"), ops, some, 1, n_thresholds=3)
    assert len(calls) == 1
    alone = X.measure_bank(images, some, operators=ops[1:], n_thresholds=3).first()
    got = {r.config: r for r in spark.read.parquet(str(tmp_path / "f")).collect()}
    assert got[alone.config].ODS == pytest.approx(alone.ODS) and got[alone.config].AP == pytest.approx(alone.AP)
