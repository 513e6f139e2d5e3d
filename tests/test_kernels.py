"""Dense kernels and raster operators against obvious loops and against each other."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterweave.operators import kernels as K
from rasterweave.operators import morphology as MO
from rasterweave.operators import raster as R
from rasterweave.sources import files, synthetic

rng = np.random.default_rng(2)
IMG = rng.random((14, 11))


@pytest.fixture(scope="module")
def px(spark):
    rows = [("a", y, x, float(IMG[y, x])) for y in range(14) for x in range(11)] + [("one", 0, 0, 0.5)]
    return spark.createDataFrame(rows, "img string, y int, x int, v double").cache()


def grid(df, col, img="a"):
    out = np.zeros(IMG.shape)
    for r in df.where(F.col("img") == img).select("y", "x", F.col(col).cast("double").alias("v")).collect():
        out[r.y, r.x] = r.v
    return out


def fold(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def loops(a, k):
    h, w = k.shape
    return np.array([[sum(k[j, i] * a[fold(y + j - h // 2, a.shape[0]), fold(x + i - w // 2, a.shape[1])] for j in range(h) for i in range(w)) for x in range(a.shape[1])] for y in range(a.shape[0])])


@pytest.mark.parametrize("name", sorted(R.KERNELS))
def test_gradients(px, name):
    kx, ky = (np.reshape(k, (3, 3)).astype(float) for k in R.KERNELS[name])
    want = np.hypot(loops(IMG, kx), loops(IMG, ky))
    assert np.hypot(*K.three(IMG, name)) == pytest.approx(want)
    assert grid(R.nine(px).withColumn("m", R.magnitude(F.col("n9"), name)), "m") == pytest.approx(want)


def test_gaussians(px):
    for order in ((0, 0), (0, 1), (2, 0), (1, 1)):
        k = np.outer(R.gaussian_kernel(1.1, order[0]), R.gaussian_kernel(1.1, order[1]))
        want = loops(IMG, k)
        assert K.gaussian(IMG, 1.1, order) == pytest.approx(want)
        assert grid(R.gaussian(px, "v", 1.1, "g", order), "g") == pytest.approx(want)
    ramp = np.tile(np.arange(30.0), (30, 1))
    assert K.gaussian(ramp, 1.0, (0, 1))[15, 15] == pytest.approx(1, abs=1e-3)
    assert K.gaussian(ramp**2, 1.0, (0, 2))[15, 15] == pytest.approx(2, abs=2e-2)


def test_boxes_and_ranks(px):
    for size in (2, 3, 4, 5):
        want = loops(IMG, np.full((size, size), 1 / size**2))
        assert K.box(IMG, size) == pytest.approx(want)
        assert grid(R.box(px, "v", size, "b"), "b") == pytest.approx(want)
    assert grid(R.nine(px).withColumn("m", R.median3(F.col("n9"))), "m") == pytest.approx(K.median(IMG))
    hi = K.rank(IMG, K.square(5), np.max)
    assert grid(R.box(px, "v", 5, "b", "max"), "b") == pytest.approx(hi)


def test_wide_kernels_by_fourier():
    k = rng.random((17, 17))
    a = rng.random((40, 30))
    assert K.correlate(a, k) == pytest.approx(loops(a, k))


def test_suppression_agrees(px):
    theta = K.orientation(IMG)
    score = K.detector(IMG, "sobel")
    for compat in (True, False):
        want = K.suppress(score, theta, compat)
        rows = [("a", y, x, float(score[y, x]), float(theta[y, x])) for y in range(14) for x in range(11)]
        d = R.inner(R.nine(px.sparkSession.createDataFrame(rows, "img string, y int, x int, v double, theta double")))
        assert grid(d.withColumn("o", R.suppress(F.col("n9"), F.col("theta"), F.col("_inner"), compat)), "o") == pytest.approx(want)


def test_diffusion_step():
    a = K.anisotropic(IMG, 1)
    assert a.shape == IMG.shape and a.std() < IMG.std()


def test_morphology(px):
    m = IMG > 0.7
    d = px.withColumn("on", F.col("v") > 0.7)
    assert (grid(MO.dilate(d, "on", 2, "o"), "o") == K.dilate(m, 2)).all()
    assert (grid(MO.erode(d, "on", 1, "o"), "o") == ~K.dilate(~m, 1)).all()
    assert (grid(MO.boundary(d, "on", "o"), "o") == synthetic.inner_edge(m)).all()
    lab, n = K.label(m)
    got = MO.components(d.where("img = 'a'"), "on").collect()
    pairs = {(r.label, int(lab[r.y, r.x])) for r in got}
    assert len(got) == m.sum() and len(pairs) == n == len({p for p, _ in pairs})
    h = grid(MO.hysteresis(d, "v", 0.6, 0.9, "o"), "o")
    assert (h == K.hysteresis(IMG, 0.6, 0.9)).all()


def test_thin_is_thin_and_connected():
    m = np.zeros((30, 30), bool)
    m[5:25, 10:14] = True
    m[14:17, 10:28] = True
    s = K.thin(m)
    assert s.any() and (s & ~m).sum() == 0 and K.label(s)[1] == 1 and s.sum() < 50
    assert (K.thin(s) == s).all() and not K.thin(np.zeros((5, 5), bool)).any()


def test_distance():
    m = rng.random((12, 9)) > 0.2
    off = np.argwhere(~m)
    want = np.array([[np.hypot(*(off - (y, x)).T).min() for x in range(9)] for y in range(12)])
    assert K.distance(m) == pytest.approx(want)
    assert np.isinf(K.distance(np.ones((3, 3), bool))).all()


def test_route_is_cheapest():
    cost = rng.random((6, 7)) + 0.05
    way, total = K.route(cost, (0, 0), (5, 6))
    assert way[0] == (0, 0) and way[-1] == (5, 6)
    best = {(0, 0): 0.0}
    for _ in range(60):
        for y in range(6):
            for x in range(7):
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        j, i = y + dy, x + dx
                        if (y, x) in best and 0 <= j < 6 and 0 <= i < 7 and (dy or dx):
                            e = best[y, x] + math.hypot(dy, dx) * (cost[y, x] + cost[j, i]) / 2
                            best[j, i] = min(best.get((j, i), math.inf), e)
    assert total == pytest.approx(best[5, 6])


def test_geodesic_link_closes_a_gap():
    img = np.zeros((40, 40))
    img[20:, :] = 1.0
    theta, line = K.orientation(img), np.zeros((40, 40))
    line[20, :] = 1
    line[20, 18:22] = 0
    out = K.geodesic_link(line > 0.5, np.full((40, 40), 0.9), np.full((40, 40), 0.9), theta)
    assert out[20, 18:22].all() and K.label(out)[1] == 1
    assert K.label(K.geodesic_link(line > 0.5, np.zeros((40, 40)), np.zeros((40, 40)), theta))[1] == 2
    c = K.continuity(out, line > 0.5)
    assert c["edge_components_on_gt"] == 1 and c["largest_component_gt_coverage"] == 1.0


def test_canny_and_conditioning():
    a, gt = synthetic.make_case("vertical", 64)
    e = K.canny(a, 1.5, 0.8, 0.95)
    assert (e & K.dilate(gt, 3)).sum() > 0.5 * gt.sum()
    assert not K.canny(a, 1.5, 0.8, 0.95, np.zeros_like(gt)).any()
    for m in ("none", "gaussian", "box", "median", "bilateral", "meanshift", "anisotropic", "gravitational"):
        out = K.condition(a, m)
        assert out.shape == a.shape and 0 <= out.min() <= out.max() <= 1 and K.halo_of(m) >= 1
    roi = np.zeros_like(gt)
    roi[10:20, 10:20] = True
    out, share = K.condition_tiles(a, roi, "median")
    assert 0 < share < 1 and (out[40:] == a[40:]).all() and (out != a)[12:18, 12:18].any()
    with pytest.raises(ValueError):
        K.condition(a, "nope")
    with pytest.raises(ValueError):
        K.detector(a, "nope")


def test_tiles_as_keys_equal_the_array_form(spark):
    from pyspark.sql import functions as F

    from rasterweave.operators.tiles import conditioned_region, share_read

    a, _ = synthetic.make_case("circle", 80)
    y, x = np.indices(a.shape)
    rows = spark.createDataFrame(pd.DataFrame({"img": "a", "y": y.ravel(), "x": x.ravel(), "v": a.ravel()}), "img string, y int, x int, v double")
    for method in ("median", "bilateral", "anisotropic"):
        want, share = K.condition_tiles(a, a >= 0.6, method, tile=16)
        got = conditioned_region(rows, F.col("v") >= 0.6, method, 16).toPandas()
        assert np.allclose(want[got["y"], got["x"]], got["out"])
        assert share_read(rows, F.col("v") >= 0.6, method, 16).first().share == pytest.approx(share)


def test_descriptors():
    a, _ = synthetic.make_case("circle", 48)
    for mode, names in K.MODES.items():
        x, n, h = K.descriptors(a, 9, mode)
        assert x.shape == (48, 48, len(names)) and n == names and 0 <= x.min() <= x.max() <= 1 and h.shape == a.shape
    flat = K.descriptors(np.full((20, 20), 0.4), 5)[0]
    assert np.isfinite(flat).all()


def test_generators(spark):
    for k in synthetic.CASES:
        img, gt = synthetic.make_case(k)
        assert img.shape == (160, 160) and gt.any() and (img == synthetic.make_case(k)[0]).all()
    plan = synthetic.split("val", 40, 41000)
    assert len({c["id"] for c in plan}) == 40 and {c["family"] for c in plan} == set(synthetic.FAMILIES) and {c["primitive"] for c in plan} == set(synthetic.PRIMITIVES)
    for c in plan:
        img, gt = synthetic.make_sample(c)
        assert 0 <= img.min() <= img.max() <= 1 and gt.any()
    d = synthetic.pixels(spark, plan[:3])
    assert d.count() == 3 * 96 * 96 and d.select("img").distinct().count() == 3


def test_png_round_trip(spark, tmp_path):
    for a in (rng.integers(0, 256, (9, 13)).astype(np.uint8), rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)):
        assert (files.decode_png(files.encode_png(a)) == a).all()
    d = spark.createDataFrame([("p", y, x, float((y + x) % 2)) for y in range(4) for x in range(5)], "img string, y int, x int, v double")
    raw = files.images_as_png(d).first().png
    (tmp_path / "p.png").write_bytes(raw)
    got = files.read_images(spark, str(tmp_path)).collect()
    assert {(r.y, r.x): r.v for r in got} == {(y, x): float((y + x) % 2) for y in range(4) for x in range(5)}
    truth = files.read_images(spark, str(tmp_path), truth=True).where("gt").count()
    assert truth == 10


def test_dense_and_long(spark):
    d = spark.createDataFrame([("p", y, x, float(10 * y + x)) for y in range(3) for x in range(4)], "img string, y int, x int, v double")
    r = files.dense(d).first()
    assert (r.h, r.w) == (3, 4) and r.data[5] == 11.0
    assert sorted(map(tuple, files.long(files.dense(d)).collect())) == sorted(map(tuple, d.collect()))


def test_matlab_boundaries():
    import struct
    import zlib

    def element(t, body):
        return struct.pack("<II", t, len(body)) + body + b"\0" * (-len(body) % 8)

    def matrix(a):
        flags = element(6, struct.pack("<II", 9, 0))
        dims = element(5, struct.pack("<ii", *a.shape))
        return element(14, flags + dims + element(1, b"b") + element(2, a.astype(np.uint8).tobytes(order="F")))

    m = (rng.random((25, 30)) > 0.5).astype(np.uint8)
    cell = element(14, element(6, struct.pack("<II", 1, 0)) + element(5, struct.pack("<ii", 1, 1)) + element(1, b"c") + matrix(m))
    packed = zlib.compress(cell)
    raw = b"x" * 124 + b"\x00\x01IM" + struct.pack("<II", 15, len(packed)) + packed
    found = files.boundaries(raw)
    assert len(found) == 1 and (found[0] == m).all()


def test_manifest_pairs_models_and_chunks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("case,seed,image,ground_truth\nvertical,0,a.png,b.png\nbox,3,c.png,d.png\n")
    assert [r.seed for r in files.read_manifest(spark, str(tmp_path / "m.csv")).orderBy("seed").collect()] == [0, 3]
    (tmp_path / "pairs.lst").write_text('[["a", "b"], ["c", "d"], ["e", "f"]]')
    assert [tuple(r) for r in files.read_pairs(spark, str(tmp_path / "pairs.lst"), 2).collect()] == [(0, "a", "b"), (1, "c", "d")]
    files.write_model(spark, {"w": np.array([1.0, math.nan]), "n": np.int64(3)}, str(tmp_path / "model"))
    assert files.read_model(spark, str(tmp_path / "model")) == {"n": 3, "w": [1.0, None]}
    made = lambda a, z: spark.range(a, z)
    assert files.write_chunks(spark, str(tmp_path / "chunks"), 10, 4, made) == [(0, 4), (4, 8), (8, 10)]
    assert files.write_chunks(spark, str(tmp_path / "chunks"), 10, 4, made) == []
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 10


def test_attraction_of_some_rows():
    """Rows of a tile are pulled as in the whole image, and only pairs with one of them are looked at."""
    a = np.random.default_rng(5).random((60, 9))
    whole, some = K.attraction(a, 7, 0.05, 20.0), K.attraction(a, 7, 0.05, 20.0, (20, 30))
    assert np.allclose(whole[20:30], some[20:30]) and not some[:20].any() and not some[30:].any()
    y, x = np.mgrid[:60, :9]
    near = ((y - 22) ** 2 + (x - 4) ** 2 <= 49) & ~((y == 22) & (x == 4))
    gap, far = a[near] - a[22, 4], ((y - 22) ** 2 + (x - 4) ** 2)[near] / 49
    assert np.isclose(whole[22, 4], (0.05 * gap / (far + (20 * gap) ** 2 + 1e-4) ** 1.5).mean())


def test_gabor_kernels_go_along_the_axes():
    a = np.random.default_rng(6).random((20, 17))
    want = np.zeros_like(a)
    for i in range(4):
        k = K.gabor_kernel(0.25, np.pi * i / 4)
        want = np.maximum(want, np.hypot(K.convolve(a, k.real.copy()), K.convolve(a, k.imag.copy())))
    assert np.allclose(K.gabor_energy(a, 5), want, atol=1e-12)
