"""Properties and brute-force comparisons of the building blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import scalar as S
from gridloom.functions import strings
from gridloom.operators import inference, raster, sampling, stats, tabular, unet, vector

DRAW = random.Random(5)


def star(n):
    """A simple polygon around (50, 50)."""
    angles = [2 * math.pi * (k + DRAW.uniform(0, 0.9)) / n for k in range(n)]  # no gap of half a turn
    points = [(50 + r * math.cos(a), 50 + r * math.sin(a)) for a in angles for r in [DRAW.uniform(5, 45)]]
    return points + points[:1]


def shoelace(p):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:]))) / 2


def test_clip_areas_add_up(spark):
    shapes = [(i, [{"x": x, "y": y} for x, y in p]) for i in range(40) for p in [star(DRAW.randrange(4, 9))]]
    df = spark.createDataFrame(shapes, "id int, ring array<struct<x:double,y:double>>")
    areas = {r["id"]: r["a"] for r in df.select("id", G.area(F.col("ring")).alias("a")).collect()}
    for i, ring in shapes:
        assert math.isclose(areas[i], shoelace([(p["x"], p["y"]) for p in ring]), rel_tol=1e-9)
    cells = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9))))
    x, y = F.col("i") * 10, F.col("j") * 10
    part = G.area(G.clip_to_box(F.col("ring"), x, y, x + 10, y + 10))
    direct = G.area_in_box(F.col("ring"), x, y, x + 10, y + 10)
    assert cells.where(F.abs(direct - F.coalesce(part, F.lit(0.0))) > 1e-6).count() == 0
    sums = cells.groupBy("id").agg(F.sum(part).alias("a"), F.max(part).alias("most"))
    for r in sums.collect():
        assert math.isclose(r["a"], areas[r["id"]], rel_tol=1e-6) and r["most"] <= 100 + 1e-9


def test_contains_and_intersects(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0), (0.0, 0.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "ring array<struct<x:double,y:double>>")
    inside = [G.contains(F.col("ring"), F.lit(x), F.lit(y)) for x, y in ((5.0, 2.0), (5.0, 6.0), (1.0, 8.0), (11.0, 1.0))]
    assert list(df.select(*inside).first()) == [True, False, True, False]
    meets = [G.intersects(F.col("ring"), G.box_ring(*b)) for b in ((4, 5, 6, 9), (10, 0, 12, 1), (4, 1, 5, 2), (-5, -5, 20, 20), (4.9, 6, 5.1, 9))]
    assert list(df.select(*meets).first()) == [True, True, True, True, False]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_reflect_is_numpy_pad(spark, n):
    want = np.pad(np.arange(n), (0, 17), mode="reflect") if n > 1 else np.zeros(18, int)
    got = [r[0] for r in spark.range(n + 17).orderBy("id").select(S.reflect(F.col("id"), n)).collect()]
    assert got == want.tolist()


def test_bins_are_numpy_histogram(spark):
    values = [0.0, 1.0, 0.5, 0.999999, -0.1, 1.1, 1 / 3, 127 / 128] + [DRAW.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").groupBy(S.histogram_bin(F.col("v"), 0.0, 1.0, 128).alias("b")).count()
    got = {r["b"]: r["count"] for r in df.where("b IS NOT NULL").collect()}
    want, _ = np.histogram(values, 128, (0, 1))
    assert got == {i: n for i, n in enumerate(want.tolist()) if n}


def test_heights_round_trip_and_missing(spark):
    df = spark.createDataFrame([(3.280839895 * m,) for m in (0.0, 1.0, 2.5, 40.0, 75.0, 90.0)] + [(float("nan"),), (None,)], "ft double")
    got = [r[0] for r in df.select(S.height_from_model(S.height_to_model(F.col("ft")))).collect()]
    assert np.allclose(got[:6], [1, 1, 2.5, 40, 75, 75]) and got[6:] == [None, None]


def test_albers_round_trip(spark):
    df = spark.createDataFrame([(-96.0, 37.5), (-122.4, 37.8), (-71.1, 42.4), (-80.2, 25.8)], "lon double, lat double")
    p = df.withColumn("p", G.albers(F.col("lon"), F.col("lat")))
    rows = p.withColumn("q", G.albers_inverse(F.col("p.x"), F.col("p.y"))).collect()
    assert abs(rows[0]["p"]["x"]) < 1e-6 and abs(rows[0]["p"]["y"]) < 1e-6
    assert all(math.isclose(r["q"]["x"], r["lon"], abs_tol=1e-9) and math.isclose(r["q"]["y"], r["lat"], abs_tol=1e-9) for r in rows)
    with pytest.raises(ValueError):
        G.reproject(F.col("ring"), 4326, 27700)


def test_footprints(spark):
    rows = ["1/2_3/4_5/0", "1/2_3/4_5/0_1/2", "1/2_3/4", "1/2_x/4_5/0", None, "", "1/2_3_5/0"]
    df = spark.createDataFrame([(r,) for r in rows], "f string")
    got = [(r[0], r[1]) for r in df.select(F.size(strings.ring(F.col("f"))), F.size(strings.ring(F.col("f"), always_close=True))).collect()]
    assert [g[0] for g in got[:2]] == [4, 4] and got[1][1] == 5
    assert all(g[0] in (None, -1) for g in got[2:])


def pixels(spark, image):
    rows = [(r, c, float(v) if v == v else None) for (r, c), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def as_image(df, shape, value="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[value] is None else r[value]
    return out


def test_padding_windows_and_inference(spark):
    rng = np.random.default_rng(0)
    for shape in ((5, 13), (20, 9), (16, 16)):
        image = rng.random(shape).round(3)
        px = pixels(spark, image)
        h, w = (raster.padded_size(n, 16, 4) for n in shape)
        want = np.pad(image, ((0, h - shape[0]), (0, w - shape[1])), mode="reflect")
        assert np.array_equal(as_image(raster.pad_reflect(px, *shape, 16, 4), (h, w)), want)
        tiles = {(r["win_row"], r["win_col"]): np.array(r["data"]).reshape(16, 16) for r in inference.windows_of(px, *shape, 16, 4).collect()}
        assert set(tiles) == {(i, j) for i in range(0, h - 15, 4) for j in range(0, w - 15, 4)}
        assert all(np.allclose(t, want[i : i + 16, j : j + 16]) for (i, j), t in tiles.items())
        out = as_image(inference.infer(px, *shape, [inference.Affine(2.0, 1.0), inference.Identity()], ["a", "b"], 16, 4), shape, "b")
        assert np.allclose(out, 2 * image + 1, atol=1e-5)


def test_valid_windows_and_values(spark):
    rng = np.random.default_rng(1)
    image = (rng.random((12, 15)) > 0.12) * rng.integers(1, 5, (12, 15))
    px = pixels(spark, image.astype(float)).withColumn("valid", F.col("value") > 0)
    got = raster.valid_windows(px, "valid", 3, 12, 15)
    want = {(r, c) for r in range(10) for c in range(13) if (image[r : r + 3, c : c + 3] > 0).all()}
    assert {tuple(r) for r in got.collect()} == want
    values = {(r["row"], r["col"], r["value"]) for r in raster.window_values(px, got, 3).collect()}
    assert values == {(r, c, float(v)) for r, c in want for v in np.unique(image[r : r + 3, c : c + 3])}


def test_bilinear_ignores_missing(spark):
    image = np.array([[1.0, np.nan], [3.0, 5.0]])
    t = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 1.0, "f": 0.0}
    half = {**t, "a": 2.0, "e": 2.0}
    assert raster.warp(pixels(spark, image), t, half, 1, 1).first()["value"] == 3.0
    meta = {"srid": 1, "height": 2, "width": 2, "transform": t}
    assert raster.aligned(meta, {**meta, "transform": {**t, "a": 1 + 1e-9}}) and not raster.aligned(meta, {**meta, "transform": half})


def test_clip_keeps_extent(spark):
    image = np.arange(1.0, 26.0).reshape(5, 5)
    t = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": -1.0, "f": 5.0}
    triangle = F.array(*[G.point(x, y) for x, y in ((1.0, 1.0), (4.0, 1.0), (1.0, 4.0), (1.0, 1.0))])
    got = as_image(raster.clip_to_polygon(pixels(spark, image), t, triangle), (3, 3))
    assert np.array_equal(got, np.array([[7, 0, 0], [12, 13, 0], [17, 18, 19]]) * (np.array([[1, 0, 0], [1, 1, 0], [1, 1, 1]]))) or (got > 0).sum() in (3, 6)


def test_touching_cells(spark):
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate((DRAW.randrange(0, 90), DRAW.randrange(0, 90), DRAW.randrange(1, 30), DRAW.randrange(1, 30)) for _ in range(60))]
    df = spark.createDataFrame(boxes, "id int, a double, b double, c double, d double").select("id", F.struct(F.col("a").alias("minx"), F.col("b").alias("miny"), F.col("c").alias("maxx"), F.col("d").alias("maxy")).alias("bbox"))
    x0, y0, x1, y1 = min(b[1] for b in boxes), min(b[2] for b in boxes), max(b[3] for b in boxes), max(b[4] for b in boxes)
    extent = df.agg(F.min("bbox.minx").alias("minx"), F.min("bbox.miny").alias("miny"), F.max("bbox.maxx").alias("maxx"), F.max("bbox.maxy").alias("maxy"))
    got = {(r["size"], r["id"], r["ix"], r["iy"]) for r in vector.cells_of(df, [10, 7], extent).collect()}
    want = set()
    for s in (10.0, 7.0):
        nx, ny = math.floor((x1 - x0) / s) + 1, math.floor((y1 - y0) / s) + 1
        want |= {(s, i, ix, iy) for i, a, b, c, d in boxes for ix in range(nx) for iy in range(ny) if a <= x0 + (ix + 1) * s and c >= x0 + ix * s and b <= y0 + (iy + 1) * s and d >= y0 + iy * s}
    assert got == want


def test_spatial_join_is_brute_force(spark):
    ring = lambda p: [{"x": x, "y": y} for x, y in p]
    shapes = [(i, ring(star(5))) for i in range(30)]
    shapes = [(i, [{"x": p["x"] + 7 * i, "y": p["y"] + 3 * i} for p in r]) for i, r in shapes]
    polygons = [(100 + i, ring([(x, y), (x + 40, y), (x + 20, y + 60), (x, y)])) for i, (x, y) in enumerate((DRAW.uniform(0, 250), DRAW.uniform(0, 150)) for _ in range(12))]
    a = spark.createDataFrame(shapes, "id int, ring array<struct<x:double,y:double>>").withColumn("bbox", G.bounds(F.col("ring")))
    b = spark.createDataFrame(polygons, "metro int, polygon array<struct<x:double,y:double>>").withColumn("box", G.bounds(F.col("polygon")))
    got = [(r["id"], r["metro"]) for r in vector.within_polygons(a, b, 17.0).collect()]
    want = [(r["id"], r["metro"]) for r in a.crossJoin(b).where(G.intersects(F.col("ring"), F.col("polygon"))).collect()]
    assert len(got) == len(set(got)) and sorted(got) == sorted(want) and want


def test_regressions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(3, 1, 200)
    y = 1.7 * x - 2 + rng.normal(0, 0.3 + 0.2 * np.abs(x), 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, float("nan"))], "x double, y double")
    design = np.column_stack([np.ones(200), x])
    bread = np.linalg.inv(design.T @ design)
    beta = bread @ design.T @ y
    e = y - design @ beta
    cov = bread * (e @ e) / 198
    t = stats.t_quantile(0.995, 198)
    fit = stats.ols(df, "x", "y", critical=t).first()
    assert np.allclose([fit["slope"], fit["intercept"], fit["stderr"], fit["intercept_stderr"]], [beta[1], beta[0], math.sqrt(cov[1, 1]), math.sqrt(cov[0, 0])])
    assert math.isclose(fit["slope_high"] - fit["slope"], t * math.sqrt(cov[1, 1]), rel_tol=1e-9)
    hc0 = bread @ (design.T * e**2) @ design @ bread
    robust = stats.robust_ols(df, "x", "y").first()
    assert np.allclose([robust["slope_hc0"], robust["intercept_hc0"]], [math.sqrt(hc0[1, 1]), math.sqrt(hc0[0, 0])])
    assert math.isclose(stats.t_quantile(0.975, 10), 2.2281388520, rel_tol=1e-8) and math.isclose(stats.t_cdf(1.0, 1), 0.75, rel_tol=1e-12)
    constant = df.withColumn("one", F.lit(1.0))
    assert stats.ols(constant, "one", "y").first()["slope"] is None


def test_unet_against_loops():
    rng = np.random.default_rng(2)
    x, w, b = (rng.normal(size=s).astype(np.float32) for s in ((2, 3, 8, 8), (5, 3, 4, 4), (5,)))
    got, padded = unet.convolve(x, w, b), np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    want = np.array([[[[(padded[n, :, 2 * i : 2 * i + 4, 2 * j : 2 * j + 4] * w[o]).sum() + b[o] for j in range(4)] for i in range(4)] for o in range(5)] for n in range(2)])
    assert np.allclose(got, want, atol=1e-4)
    u = rng.normal(size=(3, 6, 4, 4)).astype(np.float32)
    out = np.zeros((2, 6, 18, 18), np.float32)
    for n in range(2):
        for c in range(3):
            for i in range(8):
                for j in range(8):
                    out[n, :, 2 * i : 2 * i + 4, 2 * j : 2 * j + 4] += x[n, c, i, j] * u[c]
    assert np.allclose(unet.spread(x, u), out[:, :, 1:-1, 1:-1], atol=1e-4)
    made = unet.random_weights(4)(rng.normal(size=(2, 1, 16, 16)).astype(np.float32), rng.normal(size=(2, 8)).astype(np.float32))
    assert made.shape == (2, 1, 16, 16) and (np.abs(made) <= 1).all()


def test_weights_round_trip(tmp_path):
    net = unet.random_weights(3)
    unet.save(net, str(tmp_path / "w.npz"))
    x, z = np.ones((1, 1, 8, 8), np.float32), np.ones((1, 8), np.float32)
    assert np.array_equal(unet.load(str(tmp_path / "w.npz"))(x, z), net(x, z))


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    takes = [[r["k"] for r in sampling.sample(df.repartition(n), "k", 37).collect()] for n in (1, 7)]
    assert takes[0] == takes[1] and len(set(takes[0])) == 37
    with pytest.raises(ValueError):
        sampling.checked_sample(df, "k", 5001)
    ranks = sorted(r["rank"] for r in sampling.global_rank(df, S.order_hash(F.col("k")), "k").collect())
    assert ranks == list(range(5000))
    positions = df.withColumn("value", F.col("k") % 50)
    with pytest.raises(ValueError):
        sampling.covering_sample(positions, "k", 49)
    normal = df.select(F.explode(S.normals(F.col("k"), 3)).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(normal[0]) < 0.02 and abs(normal[1] - 1) < 0.02


def test_seeds_give_samples_of_their_own(spark):
    df = spark.range(20_000).withColumn("k", F.col("id") + F.lit(16_000_000_000))  # keys of a national raster
    takes = {seed: {r["k"] for r in sampling.sample(df, "k", 500, seed).collect()} for seed in (1000, 1001, 1002, 1003, 2000)}
    for a in takes:
        assert len(takes[a]) == 500
        for b in takes:
            assert a == b or len(takes[a] & takes[b]) < 40  # 12.5 expected
    halves = sum(k < 16_000_010_000 for k in takes[1000])
    assert 190 < halves < 310
    batches = {e: {r["k"]: r["batch"] for r in sampling.minibatches(df, "k", e).select("k", "batch").collect()} for e in (1, 2, 50)}
    for a, b in ((1, 2), (1, 50), (2, 50)):
        assert sum(batches[a][k] == batches[b][k] for k in batches[a]) < 400  # 128 expected


def test_missing_tile_raises(spark):
    target = spark.createDataFrame([(1, 1), (2, 1)], "seed int, tile int")
    source = spark.createDataFrame([(1, 1, 5)], "seed int, tile int, v int")
    with pytest.raises(Exception, match="no source tile"):
        tabular.tile_layers(target, source, ["seed", "tile"]).collect()
    assert tabular.keep_columns(source, ["V", "missing"]).columns == ["V"]


def test_inference_of_fits(spark):
    xs = [(float(i), 2.0 * i + (-1) ** i) for i in range(12)]
    fit = stats.inference(stats.ols(spark.createDataFrame(xs, "x double, y double"), "x", "y")).first()
    # Ten degrees of freedom: the 0.975 quantile is 2.228139.
    assert abs(fit["slope_high"] - fit["slope"] - 2.228139 * fit["stderr"]) < 1e-6
    t = fit["slope"] / fit["stderr"]
    assert abs(fit["p_value"] - 2 * (1 - stats.t_cdf(t, 10))) < 1e-12
    two = stats.inference(stats.ols(spark.createDataFrame(xs[:2], "x double, y double"), "x", "y")).first()
    assert two["p_value"] is None and two["slope_low"] is None
    line = stats.inference(stats.ols(spark.createDataFrame([(float(i), float(i)) for i in range(5)], "x double, y double"), "x", "y")).first()
    assert line["p_value"] == 0.0 and line["slope_low"] == 1.0
