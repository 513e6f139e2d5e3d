"""Tiles, thinning rounds, links, distances and grouped order statistics against whole arrays."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterweave.operators import distance as D
from rasterweave.operators import information as I
from rasterweave.operators import kernels as K
from rasterweave.operators import morphology as MO
from rasterweave.operators import linking as L
from rasterweave.operators import ordering as O
from rasterweave.operators import storage
from rasterweave.operators import tiles as T

G = np.random.default_rng(17)


def frame(spark, images, name="v"):
    rows = []
    for i, a in enumerate(images):
        y, x = np.indices(a.shape)
        rows.append(pd.DataFrame({"img": f"i{i}", "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), name: a.ravel()}))
    return spark.createDataFrame(pd.concat(rows))


def arrays(df, col, images):
    t = df.select("img", "y", "x", col).toPandas()
    out = []
    for i, a in enumerate(images):
        f = t[t["img"] == f"i{i}"]
        assert len(f) == a.size
        b = np.zeros(a.shape, bool if f[col].dtype == bool else float)
        b[f["y"], f["x"]] = f[col]
        out.append(b)
    return out


def blobs(h, w, density=0.55, smooth=2.0):
    return K.gaussian(G.random((h, w)), smooth) > np.quantile(K.gaussian(G.random((h, w)), smooth), 1 - density)


def test_thin_in_rounds(spark):
    masks = [blobs(70, 45), blobs(33, 90, 0.7, 4.0), np.zeros((20, 9), bool), np.ones((50, 61), bool), np.ones((1, 1), bool)]
    df = frame(spark, masks, "m")
    got = arrays(T.thin(df, "m", "s", 16, 4), "s", masks)
    for a, b in zip(got, masks, strict=True):
        assert (a == K.thin(b)).all()
    with pytest.raises(ValueError):
        T.thin(df, "m", tile=8, steps=8)


def test_by_tile_equals_whole_images(spark):
    images = [G.random((75, 40)), G.random((20, 97))]
    df = frame(spark, images)
    for mode in K.MODES:
        names = K.MODES[mode]
        got = T.by_tile(df, ["v"], lambda v, m=mode: K.raw_descriptors(v, 7, m)[0], K.descriptor_halo(7, mode), ", ".join(f"{n} double" for n in names), 32)
        for n in names:
            for a, img in zip(arrays(got, n, images), images, strict=True):
                assert np.allclose(a, K.raw_descriptors(img, 7, mode)[0][n], atol=1e-9), (mode, n)


def test_distance_lines(spark):
    masks = [G.random((40, 33)) < 0.03, np.zeros((5, 4), bool), np.ones((3, 3), bool), G.random((1, 50)) < 0.1, np.eye(30, dtype=bool)]
    got = arrays(D.distance(frame(spark, masks, "m"), "m"), "distance", masks)
    for a, m in zip(got, masks, strict=True):
        assert np.allclose(a, K.distance(~m))


def test_links_equal_the_greedy_walk(spark):
    images, scores, thetas, edges = [], [], [], []
    for h, w in ((60, 48), (40, 70)):
        base = np.zeros((h, w))
        for _ in range(14):
            y, x, d = G.integers(5, h - 5), G.integers(5, w - 5), G.random() * np.pi
            for t in np.arange(-12, 12, 0.5):
                j, i = int(round(y + t * np.sin(d))), int(round(x + t * np.cos(d)))
                if 0 <= j < h and 0 <= i < w and not 2 < abs(t) < 4:
                    base[j, i] = 1
        v = np.clip(K.gaussian(base, 0.7) + 0.05 * G.random((h, w)), 0, 1)
        images.append(v)
        scores.append(v / v.max())
        thetas.append(K.orientation(v))
        edges.append(base > 0)
    df = frame(spark, scores, "score").join(frame(spark, thetas, "theta"), ["img", "y", "x"]).join(frame(spark, edges, "edge"), ["img", "y", "x"])
    got = arrays(L.geodesic_link(df, "edge", "score", "score", "theta", "out"), "out", edges)
    linked = 0
    for a, e, s, t in zip(got, edges, scores, thetas, strict=True):
        want = K.geodesic_link(e, s, s, t)
        assert (a == want).all()
        linked += (want & ~K.thin(e)).sum()
    assert linked > 0


def test_matching_in_rounds_is_the_greedy_one(spark):
    rows = [("i0", float(G.integers(1, 6)), int(a), int(b)) for a, b in (sorted(G.choice(30, 2, replace=False)) for _ in range(120))]
    pairs = spark.createDataFrame(sorted(set(rows)), "img string, length double, id_a long, id_b long")
    taken, want = set(), []
    for r in sorted(set(rows), key=lambda r: r[1:]):
        if r[2] not in taken and r[3] not in taken:
            taken |= {r[2], r[3]}
            want.append(tuple(r[1:]))
    assert sorted(tuple(r)[1:] for r in L.matched(pairs).select("img", "length", "id_a", "id_b").collect()) == sorted(want)
    assert sorted(tuple(r)[1:] for r in L.matched(pairs, 3).select("img", "length", "id_a", "id_b").collect()) == sorted(want[:3])


# ---- grouped order statistics


@pytest.fixture(scope="module")
def hot(spark):
    """A group of 600,000 rows beside small ones, with ties and what is not finite."""
    big = spark.range(600_000).select(F.lit("hot").alias("img"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(250_000)) / 1000.0).alias("v"))
    v = G.integers(0, 40, 500) / 7
    small = spark.createDataFrame([(None if i % 5 == 0 else f"g{i % 5}", int(i), 0, float(x)) for i, x in enumerate(v)] + [("g1", 1000, 0, float("nan")), ("g1", 1001, 0, None), ("none", 0, 0, float("inf"))], "img string, y int, x int, v double")
    return big.union(small).repartition(7)


@pytest.fixture
def ranges(monkeypatch):
    monkeypatch.setattr(O, "WHOLE", 1000)


def plans_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_quantiles(hot, ranges):
    p = [0.0, 0.01, 0.337, 0.5, 0.99, 1.0]
    got = {r.img: r for r in O.group_quantiles(hot.withColumn("w", -F.col("v")), ["img"], {"v": p, "w": [0.25]}).collect()}
    t = hot.toPandas()
    assert set(got) == {None, "hot", "g1", "g2", "g3", "g4"}
    for g, r in got.items():
        x = t["v"][t["img"].isna() if g is None else t["img"] == g]
        x = x[np.isfinite(x.astype(float))]
        assert np.allclose(r.v, np.quantile(x, p)) and np.isclose(r.w[0], np.quantile(-x, 0.25))


def test_places_in_a_large_group(hot, ranges):
    out = I.percentile_confidence(hot.where("v IS NOT NULL AND NOT isnan(v)"), "v", ["y", "x"], by=["img"])
    assert "_range" in plans_of(out)
    t = out.toPandas()
    for g, f in t.groupby(t["img"].fillna("null")):
        f = f.sort_values(["v", "y"])
        want = np.arange(len(f)) / max(1, len(f) - 1)
        assert np.allclose(f["conf"], want), g


def test_surprisal_and_scaling_of_groups(hot, ranges):
    ok = hot.where("img IS NOT NULL")
    t = I.robust01(I.surprisal(ok, "v", by=["img"]), ["v"], by=["img"], suffix="_s").toPandas()
    for g, f in t.groupby("img"):
        x = f["v"].to_numpy(float)
        fin = np.isfinite(x)
        assert f["bits"].notna().to_numpy().tolist() == fin.tolist()
        if fin.any() and g != "none":
            assert np.allclose(f["bits"][fin], K.surprisal(x[fin]), atol=1e-9), g
            lo, hi = np.quantile(x[fin], [0.01, 0.99])
            assert np.allclose(f["v_s"][fin], np.clip((x[fin] - lo) / (hi - lo), 0, 1))


def test_null_groups_have_surprisal(hot, ranges):
    f = I.surprisal(hot.where("img IS NULL"), "v", by=["img"]).toPandas()
    assert np.allclose(f["bits"], K.surprisal(f["v"].to_numpy()))


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://there:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.shared_dir(Session())
    Context.master = "local[4]"
    assert storage.shared_dir(Session()) == storage.FALLBACK_DIR


# ---- edges, context, continuity, pyramids


def test_canny_on_rows(spark):
    from rasterweave.operators import edges as ED

    images = [K.gaussian(G.random((50, 40)), 1.5), K.gaussian(G.random((33, 71)), 1.0)]
    df = frame(spark, images)
    for a, img in zip(arrays(ED.canny(df, "v", 1.0, 0.6, 0.9), "edge", images), images, strict=True):
        want = K.canny(img, 1.0, 0.6, 0.9)
        assert (a == want).all() and want.any()
    roi = [np.pad(np.ones((30, 20), bool), 10), np.pad(np.ones((13, 51), bool), 10)]
    masked = df.join(frame(spark, roi, "m"), ["img", "y", "x"])
    for a, img, m in zip(arrays(ED.canny(masked, "v", 1.2, 0.6, 0.9, roi=F.col("m")), "edge", images), images, roi, strict=True):
        assert (a == K.canny(img, 1.2, 0.6, 0.9, m)).all()
    for a, img in zip(arrays(ED.canny_persistence(df, "v"), "persistence", images), images, strict=True):
        assert np.allclose(a, K.canny_persistence(img))


def test_context_on_rows(spark):
    from rasterweave.operators import context as C

    images = [G.random((70, 30)), K.gaussian(G.random((20, 90)), 1.0), np.full((9, 9), 0.5)]
    got = {r.img: r for r in C.context_vectors(frame(spark, images)).collect()}
    for i, img in enumerate(images):
        assert np.allclose([got[f"i{i}"][n] for n in C.NAMES], K.context(img), atol=1e-9)


def test_continuity_on_rows(spark):
    preds = [blobs(40, 60, 0.2), np.zeros((10, 10), bool), blobs(30, 30, 0.3, 1.0)]
    truths = [blobs(40, 60, 0.1, 3.0), np.ones((10, 10), bool), np.zeros((30, 30), bool)]
    df = frame(spark, preds, "p").join(frame(spark, truths, "g"), ["img", "y", "x"])
    got = {r.img: r.asDict() for r in L.continuity(df, "p", "g").collect()}
    for i, (p, g) in enumerate(zip(preds, truths, strict=True)):
        want = K.continuity(p, g)
        assert {k: v for k, v in got[f"i{i}"].items() if k != "img"} == pytest.approx(want)


def test_mean_shift_over_a_pyramid(spark):
    images = [np.round(K.gaussian(G.random((70, 41)), 2.0), 3), G.random((6, 30)), np.kron(G.random((5, 4)), np.ones((9, 9)))]
    df = frame(spark, images)
    for levels in (0, 2):
        for a, img in zip(arrays(T.mean_shift(df, "v", "o", 3, 18, levels, 2, tile=32), "o", images), images, strict=True):
            assert np.allclose(a, K.mean_shift(img, 3, 18, levels, 2)), levels


def test_postprocessing_on_rows(spark):
    scores = [np.clip(K.gaussian((G.random((36, 44)) > 0.97).astype(float), 0.9) * 6, 0, 1), K.gaussian(G.random((30, 26)), 1.2)]
    thetas = [K.orientation(s) for s in scores]
    df = frame(spark, scores, "s").join(frame(spark, thetas, "theta"), ["img", "y", "x"])
    for method, p in (("none", {}), ("closing", {"radius": 2}), ("hyst_geo", {"max_gap": 6.0, "max_mean_cost": 0.9})):
        got = arrays(L.postprocess(df, "s", 0.5, method, "s", "theta", **p), "edge", scores)
        for a, s, t in zip(got, scores, thetas, strict=True):
            assert (a == K.postprocess(s, 0.5, method, s, t, **p)).all(), method
    with pytest.raises(ValueError):
        L.postprocess(df, "s", 0.5, "nope", "s", "theta")


def test_most_within_is_the_diamond():
    for shape, r in (((9, 4), 6), ((5, 12), 3), ((7, 7), 0), ((40, 3), 17)):
        a = np.where(G.random(shape) < 0.3, G.random(shape), -np.inf)
        y, x = np.mgrid[: shape[0], : shape[1]]
        want = [[a[(abs(y - j) + abs(x - i)) <= r].max() for i in range(shape[1])] for j in range(shape[0])]
        assert np.array_equal(K.most_within(a, r), np.array(want))


def test_distance_frames_do_not_end_with_the_line(spark):
    from rasterweave.operators.distance import distance

    df = spark.createDataFrame([("a", i, 0, i == 3) for i in range(8)], "img string, y int, x int, on boolean")
    d = distance(df, "on")
    assert "unboundedfollowing" not in plans_of(d).lower()  # such a frame is summed anew for each row
    assert sorted((r.y, r.distance) for r in d.collect()) == [(i, abs(i - 3.0)) for i in range(8)]


def test_dilation_shuffles_a_pixel_once(spark):
    from rasterweave.operators.morphology import dilate

    m = G.random((20, 9)) < 0.05
    df = spark.createDataFrame([("a", int(j), int(i), bool(m[j, i]), [1.0]) for j, i in np.ndindex(m.shape) if (j + i) % 7], "img string, y int, x int, on boolean, kept array<double>")
    d = dilate(df, "on", 3, "out")
    assert d.columns == ["img", "y", "x", "on", "kept", "out"] and "o.dy" not in plans_of(d) and "Join" not in plans_of(d)
    some = m & (np.add.outer(np.arange(20), np.arange(9)) % 7 != 0)
    assert all(r.out == K.dilate(some, 3)[r.y, r.x] and r.kept == [1.0] for r in d.collect())


def test_quantiles_shuffle_bins_of_large_tables(hot, ranges, monkeypatch):
    seen, plain = [], O.laid_out
    monkeypatch.setattr(O, "laid_out", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    O.group_quantiles(hot, ["img"], {"v": [0.01, 0.99]}).collect()
    assert max(seen) < 5_000  # 250,000 values before


@pytest.mark.parametrize("connectivity", [1, 2])
def test_components_meet_across_tiles(spark, connectivity):
    """Labels by tile, joined at the rims only: a snake over many tiles, dense noise, and an image inside one tile, for which no label goes in rounds."""
    rng = np.random.default_rng(5)
    snake = np.zeros((30, 21), bool)
    snake[::4] = True
    snake[2::8, -1] = snake[1::8, -1] = snake[3::8, -1] = True
    snake[6::8, 0] = snake[5::8, 0] = snake[7::8, 0] = True
    images = {"snake": snake, "noise": rng.random((33, 19)) < 0.5, "small": np.eye(4, dtype=bool)}
    rows = [(k, int(y), int(x), True) for k, m in images.items() for y, x in zip(*np.nonzero(m), strict=True)]
    df = spark.createDataFrame(rows, "img string, y int, x int, on boolean")
    got = {(r.img, r.y, r.x): r.label for r in MO.components(df, "on", connectivity=connectivity, tile=4).collect()}
    assert len(got) == len(rows)
    for k, m in images.items():
        own, n = K.label(m, connectivity == 2)
        for c in range(1, n + 1):
            at = [(int(y), int(x)) for y, x in zip(*np.nonzero(own == c), strict=True)]
            assert {got[(k, y, x)] for y, x in at} == {min(y * (1 << 20) + x for y, x in at)}


def test_tiles_before_an_image_are_not_made(spark):
    """A halo over the first row or column used to send pixels to tiles that hold none."""
    got = T.dealt(frame(spark, [np.zeros((20, 5))]), 6, 8).select("ty", "tx").distinct()
    assert sorted(map(tuple, got.collect())) == [(y, x) for y in range(4) for x in (0, 1)]


def test_thinning_rests_where_nothing_is_new(spark):
    """Bridged lines were thinned again everywhere."""
    m = K.thin(np.random.default_rng(5).random((70, 40)) < 0.6)
    new = np.zeros_like(m)
    new[14:19, 14:19] = True
    new &= ~m
    y, x = np.indices(m.shape)
    rows = [("a", int(j), int(i), bool(o), bool(f)) for j, i, o, f in zip(y.ravel(), x.ravel(), (m | new).ravel(), new.ravel(), strict=True)]
    df = spark.createDataFrame(rows, "img string, y int, x int, m boolean, f boolean")
    got = {(r.y, r.x) for r in T.thin(df, "m", "s", 16, 4, fresh="f").where("s").collect()}
    assert got == set(map(tuple, np.argwhere(K.thin(m | new)).tolist()))
    still = T.thin(df.selectExpr("img", "y", "x", "true as m", "false as f"), "m", "s", 16, 4, fresh="f")
    assert still.where("s").count() == m.size


def test_thinning_ends_with_the_round_that_ends_it(spark, monkeypatch):
    """A tile that had lost a pixel in a round was thinned once more, and each round left its tables on the disk."""
    gone, kept = [], []
    monkeypatch.setattr(T, "materialize", lambda d, name, f=T.materialize: kept.append(name) or f(d, name))
    monkeypatch.setattr(T, "release", lambda *t, f=T.release: gone.extend(t) or f(*t))
    masks = [np.random.default_rng(6).random((300, 30)) < 0.8, np.pad(np.ones((280, 90), bool), 3)]
    df = frame(spark, [m.astype(float) for m in masks]).withColumn("m", F.col("v") > 0)
    first = df.where("img = 'i0'")
    got = arrays(T.thin(first, "m", "s"), "s", masks[:1])
    assert (got[0] == K.thin(masks[0])).all() and len(kept) == 2 and not gone
    kept.clear()
    for a, b in zip(arrays(T.thin(df, "m", "s"), "s", masks), masks, strict=True):
        assert (a == K.thin(b)).all()
    assert len(kept) - len(gone) == 2 and gone  # the last round's two


def test_corridors_shuffle_narrow_rows(spark):
    """A corridor's hundreds of rows carried both ends' places, length and heading through two shuffles."""
    import re

    pairs = L._placed(spark.createDataFrame([("a", 1 << 20 | 2, 4 << 20 | 6)], "img string, id_a long, id_b long")).selectExpr("*", "double(5) as length").withColumn("heading", L._heading())
    y, x = np.indices((8, 9))
    pixels = spark.createDataFrame(pd.DataFrame({"img": "a", "y": y.ravel(), "x": x.ravel(), "c": G.random(72)}), "img string, y int, x int, c double")
    got = L.ways(pairs, pixels, F.col("c") + 0 * F.col("heading"), 3)
    r = got.first()
    c = np.array([p.c for p in pixels.orderBy("y", "x").collect()]).reshape(8, 9)
    way, total = K.route(c[0:8, 0:9], (1, 2), (4, 6))
    assert r.length == 5.0 and [(p.y, p.x) for p in r.way] == [tuple(map(int, p)) for p in way] and r["mean"] == pytest.approx(total / len(way))
    taken = re.search(r"FlatMapGroupsInPandas.*?run\((.*?)\)", got._jdf.queryExecution().analyzed().toString())[1]
    assert [t.split("#")[0] for t in taken.split(", ")] == ["img", "id_a", "id_b", "y", "x", "cost"]
