"""Repair of rings, areas of rings that touch, and the index of sides, against fine grids and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions.noding import even_odd, signed_area
from gridloom.operators import polygon_index, repair, vector

RINGS = "array<array<struct<x:double,y:double>>>"


def rows(rings):
    return [[(float(x), float(y)) for x, y in r] for r in rings]


def odd(points, rings):
    """Whether points lie in an odd number of windings."""
    n = np.zeros(len(points), int)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, 0)):
            if ay != by:
                n += ((ay <= points[:, 1]) != (by <= points[:, 1])) & (points[:, 0] < ax + (points[:, 1] - ay) / (by - ay) * (bx - ax))
    return n % 2 == 1


def wobbly(cx, cy, radius, sides, waves):
    t = np.linspace(0, 2 * np.pi, sides + 1)
    q = radius * (1 + 0.3 * np.sin(waves * t) + 0.1 * np.sin(7 * waves * t + 1))
    p = np.stack([cx + q * np.cos(t), cy + q * np.sin(t)], 1)
    p[-1] = p[0]
    return p


SQUARE = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
CASES = {
    "bow-tie": ([[[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]]], 2, 2.0),
    "hole that touches a corner": ([SQUARE, [[0, 0], [3, 1], [1, 3], [0, 0]]], 2, 96.0),
    "hole that touches a side": ([SQUARE, [[5, 0], [6, 2], [4, 2], [5, 0]]], 2, 98.0),
    "parts that share a corner": ([SQUARE, [[10, 10], [11, 10], [11, 11], [10, 11], [10, 10]]], 2, 101.0),
    "parts that share a side": ([SQUARE, [[10, 0], [12, 0], [12, 10], [10, 10], [10, 0]]], 1, 120.0),
    "a ring twice": ([SQUARE, SQUARE], 0, 0.0),
    "spike": ([[[0, 0], [10, 0], [10, 5], [20, 5], [10, 5], [10, 10], [0, 10], [0, 0]]], 1, 100.0),
    "walk back to a corner": ([[*SQUARE, [2, 1], [3, 2], [2, 3], [1, 2], [2, 1], [0, 0]]], 2, 98.0),
    "line": ([[[0, 0], [1, 1], [0, 0]]], 0, 0.0),
    "point": ([[[1, 1]]], 0, 0.0),
    "nothing": ([], 0, 0.0),
    "open": ([SQUARE[:-1]], 1, 100.0),
    "three lines through a point": ([[[0, 0], [4, 4], [4, 0], [0, 4], [2, 4], [2, 0], [0, 0]]], None, None),
    "far away": ([[[4e6 + x, 3e6 + y] for x, y in ([0, 0], [2, 2], [2, 0], [0, 2], [0, 0])]], 2, 2.0),
}


@pytest.mark.parametrize("name", CASES)
def test_repair(name):
    rings, count, area = CASES[name]
    made = even_odd([np.array(r, float).reshape(-1, 2) for r in rings])
    assert count is None or len(made) == count
    assert area is None or sum(map(signed_area, made)) == pytest.approx(area, abs=1e-9 if name != "far away" else 1e-6)
    assert all((r[0] == r[-1]).all() and len(np.unique(r[:-1], axis=0)) == len(r) - 1 for r in made)


@pytest.mark.parametrize("seed", range(40))
def test_repair_keeps_what_is_inside(seed):
    rng = np.random.default_rng(seed)
    size = lambda: int(rng.integers(3, 14))
    rings = [rng.integers(0, 8, (size(), 2)).astype(float) if seed % 2 else rng.random((size(), 2)) * 8 for _ in range(1 + seed % 3)]
    made, points = even_odd(rings), rng.random((4_000, 2)) * 8
    assert (odd(points, rings) == odd(points, [r[:-1] for r in made])).all()
    # Outer rings add and holes take away what they enclose; repairing again changes nothing.
    area = sum(map(signed_area, made))
    assert area == pytest.approx(odd(points, rings).mean() * 64, abs=2.5)
    assert sum(map(signed_area, even_odd(made))) == pytest.approx(area)
    assert len(even_odd(made)) == len(made)


def test_repair_of_many_sides():
    ring = wobbly(0, 0, 100, 10_000, 9)
    assert sum(map(signed_area, even_odd([ring]))) == pytest.approx(abs(signed_area(ring)))


def test_repaired_rows_and_areas(spark):
    good = {k: v for k, v in CASES.items() if v[2] is not None}
    data = [(k, rows(v[0]), 1) for k, v in good.items()] + [("null", None, 1)]
    df = repair.repaired(spark.createDataFrame(data, f"name string, rings {RINGS}, keep int"), "rings", "rings")
    assert df.columns == ["name", "keep", "rings"]
    got = {r[0]: (r[1], r[2]) for r in df.select("name", F.size("rings"), G.rings_area(F.col("rings"))).collect()}
    assert got.pop("null")[1] is None
    assert all(got[k][0] == v[1] and got[k][1] == pytest.approx(v[2], abs=1e-6) for k, v in good.items())
    single = spark.createDataFrame([(rows([SQUARE])[0],), (None,)], "ring array<struct<x:double,y:double>>")
    assert [r[0] for r in repair.repaired(single).select(F.size("rings")).collect()] == [1, None] or repair.repaired(single).where("rings IS NULL").count() == 1


def test_areas_of_rings_that_touch(spark):
    inner = [[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]]
    hole = [[4, 4], [7, 4], [7, 7], [4, 7], [4, 4]]
    cases = [([SQUARE, [[0, 0], [2, 0], [2, 5], [0, 5], [0, 0]]], 90.0), ([[[10, 10], [20, 10], [20, 20], [10, 20], [10, 10]], SQUARE], 200.0), ([inner, hole, SQUARE], 92.0), ([SQUARE, SQUARE, inner], 1.0), ([hole, inner], 8.0), ([], 0.0)]
    df = spark.createDataFrame([(i, rows(r)) for i, (r, _) in enumerate(cases)], f"i int, r {RINGS}")
    corner = [F.lit(v) for v in (-1.0, -1.0, 30.0, 30.0)]
    got = {r[0]: r[1:] for r in df.select("i", G.rings_area(F.col("r")), G.rings_area_in_box(F.col("r"), *corner)).collect()}
    assert all(got[i] == pytest.approx((a, a)) for i, (_, a) in enumerate(cases))


POLYGONS = {
    0: [wobbly(0, 0, 100, 10_000, 9), wobbly(0, 0, 30, 2_000, 5)],
    1: [wobbly(250, 40, 60, 500, 4)],
    2: [np.array([[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]], float)],
    3: [np.array([[-128, -128], [0, -128], [0, 0], [-128, 0], [-128, -128]], float), np.array([[0, 0], [64, 0], [64, 64], [0, 64], [0, 0]], float)],
    4: [np.array([[0.3, 0.2], [0.3, 0.2]], float)],
}


@pytest.fixture(scope="module")
def polygons(spark):
    return spark.createDataFrame([(k, rows(v), "n") for k, v in POLYGONS.items()] + [(9, None, "n")], f"metro long, polygon {RINGS}, name string").cache()


def test_points_in_large_polygons(spark, polygons):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.uniform(-160, 330, (3_000, 2)), rng.integers(-130, 66, (1_500, 2)).astype(float)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, y double")
    found = polygon_index.points_within(df, polygons, "metro", "polygon")
    got = sorted((r["id"], r["metro"]) for r in found.collect())
    assert got == sorted((int(i), k) for k, v in POLYGONS.items() for i in np.flatnonzero(odd(points, [r[:-1] for r in v])))
    one = polygons.where("metro = 0")
    every = polygon_index.points_within(df, one, "metro", "polygon", outside=True)
    assert every.count() == len(points) and every.where("metro = 0").count() == sum(k == 0 for _, k in got)
    assert polygon_index.points_within(df, polygons.limit(0), "metro", "polygon").count() == 0


def _meet(a, b):
    """Whether two closed rings' sides share a point."""
    turn = lambda p, q, r: np.sign((q[0] - p[0]) * (r[..., 1] - p[1]) - (q[1] - p[1]) * (r[..., 0] - p[0]))
    c, d = b[:-1], b[1:]
    for p, q in zip(a[:-1], a[1:]):
        s1, s2 = turn(p, q, c), turn(p, q, d)
        s3 = np.sign((d[:, 0] - c[:, 0]) * (p[1] - c[:, 1]) - (d[:, 1] - c[:, 1]) * (p[0] - c[:, 0]))
        s4 = np.sign((d[:, 0] - c[:, 0]) * (q[1] - c[:, 1]) - (d[:, 1] - c[:, 1]) * (q[0] - c[:, 0]))
        boxes = (np.minimum(c, d) <= np.maximum(p, q)).all(1) & (np.maximum(c, d) >= np.minimum(p, q)).all(1)
        if ((s1 * s2 <= 0) & (s3 * s4 <= 0) & boxes).any():
            return True
    return False


def test_shapes_that_meet_large_polygons(spark, polygons):
    rng = np.random.default_rng(2)
    boxes = [(x, y, x + w, y + h) for x, y, w, h in zip(rng.uniform(-160, 320, 500), rng.uniform(-160, 160, 500), rng.uniform(0.1, 12, 500), rng.uniform(0.1, 12, 500))]
    # Around a whole polygon; touching a corner, a side; on whole numbers.
    boxes += [(4, 4, 7, 7), (64, 64, 70, 70), (-140, -60, -128, -50), (-300, -300, 400, 300), (6, 5, 8, 6), (5.2, 5.2, 5.4, 5.4)]
    rings = [np.array([[a, b], [c, b], [c, d], [a, d], [a, b]], float) for a, b, c, d in boxes]
    df = spark.createDataFrame([(i, rows([r])[0], "b") for i, r in enumerate(rings)], "id long, ring array<struct<x:double,y:double>>, box string")
    want = []
    for k, v in POLYGONS.items():
        if k == 4:
            continue  # a polygon without area has no sides, and meets nothing
        held = odd(np.array([r[0] for r in rings]), [p[:-1] for p in v])
        want += [(i, k) for i, r in enumerate(rings) if held[i] or any(odd(p[:1], [r[:-1]])[0] or _meet(r, p) for p in v)]
    met = vector.within_polygons(df, polygons)
    assert met.columns[-1] == "name" and sorted((r["id"], r["metro"]) for r in met.collect()) == sorted(want)


def test_no_expression_meets_all_sides_of_a_pair(spark, polygons):
    df = spark.createDataFrame([(1, rows([SQUARE])[0])], "id long, ring array<struct<x:double,y:double>>")
    most = polygon_index.index(polygons, "metro", "polygon", [4]).agg(F.max(F.size("sides"))).first()[0]
    assert most < 1_500
    plan = vector.within_polygons(df, polygons)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("polygon_index")] if "polygon_index" in plan else plan
    assert "Cartesian" not in joined
