"""Projections against published examples and round trips, well-known text, and warping between systems."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import projections as P
from gridloom.operators import raster, warp

CLARKE = {"axis": 6378206.4, "flattening": 1 - (1 - 0.00676866) ** 0.5}
#: Snyder (1987), numerical examples; given to the decimetre.
PUBLISHED = [
    (P.System("lambert", lat0=23, lon0=-96, lat1=33, lat2=45, **CLARKE), -75, 35, 1894410.9, 1564649.5),
    (P.System("albers", lat0=23, lon0=-96, lat1=29.5, lat2=45.5, **CLARKE), -75, 35, 1885472.7, 1535925.0),
    (P.System("transverse", lon0=-75, k0=0.9996, **CLARKE), -73.5, 40.5, 127106.5, 4484124.4),
    (P.System("mercator", lon0=-180, **CLARKE), -75, 35, 11688673.7, 4139145.6),
]


@pytest.mark.parametrize("system,lon,lat,x,y", PUBLISHED, ids=lambda v: getattr(v, "method", ""))
def test_published_examples(spark, system, lon, lat, x, y):
    got = spark.range(1).select(P.project(system, F.lit(float(lon)), F.lit(float(lat))).alias("p")).first().p
    assert got["x"] == pytest.approx(x, abs=0.06) and got["y"] == pytest.approx(y, abs=0.06)


SYSTEMS = [4326, 4269, "EPSG:5070", "ESRI:102003", 102004, 3857, 26915, "EPSG:32614", P.System("lambert", lat0=40, lon0=-96, k0=0.9999, x0=1000, y0=5, unit=0.3048), P.System("lambert", lat0=-40, lon0=-96, lat1=-30, lat2=-50), P.System("albers", lat0=-30, lon0=170, lat1=-20), P.System("albers", axis=6371000.0, flattening=0.0, lat1=20, lat2=60, lon0=-96), P.System("mercator", lon0=150, lat1=30)]


@pytest.mark.parametrize("system", SYSTEMS, ids=str)
def test_round_trips_within_a_millimetre(spark, system):
    rng = np.random.default_rng(0)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-120, -72, 200), rng.uniform(26, 48, 200))] + [(-96.0, 40.0)]
    df = spark.createDataFrame(points, "lon double, lat double")
    back = df.select("lon", "lat", P.project(system, F.col("lon"), F.col("lat")).alias("p")).select("lon", "lat", P.unproject(system, F.col("p.x"), F.col("p.y")).alias("b"))
    worst = back.select(F.max(F.abs(F.col("b.x") - F.col("lon"))), F.max(F.abs(F.col("b.y") - F.col("lat")))).first()
    assert max(worst) * 111_320 < 0.001


def test_antimeridian(spark):
    fiji = P.System("transverse", lon0=179, k0=0.9996)
    df = spark.range(1).select(P.project(fiji, F.lit(-179.5), F.lit(-17.0)).alias("p")).select("p", P.unproject(fiji, F.col("p.x"), F.col("p.y")).alias("b")).first()
    assert 0 < df["p"]["x"] < 200_000 and df["b"]["x"] == pytest.approx(-179.5)


ONE = 'PROJCS["x",GEOGCS["n",DATUM["d",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Albers"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-96.0],PARAMETER["Standard_Parallel_1",29.5],PARAMETER["Standard_Parallel_2",45.5],PARAMETER["Latitude_Of_Origin",37.5],UNIT["Meter",1.0]]'
TWO = 'PROJCRS["x",BASEGEOGCRS["n",DATUM["d ""quoted""",ELLIPSOID["GRS 1980",6378137,298.257222101,LENGTHUNIT["metre",1]]],PRIMEM["Greenwich",0,ANGLEUNIT["degree",0.0174532925199433]]],CONVERSION["c",METHOD["Lambert Conic Conformal (2SP)",ID["EPSG",9802]],PARAMETER["Latitude of false origin",39,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Longitude of false origin",-96,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Latitude of 1st standard parallel",33,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Latitude of 2nd standard parallel",45,ANGLEUNIT["degree",0.0174532925199433]],PARAMETER["Easting at false origin",1000,LENGTHUNIT["metre",1]]],CS[Cartesian,2],AXIS["(E)",east,ORDER[1]],LENGTHUNIT["US survey foot",0.304800609601219]]'


def test_well_known_text():
    assert P.parse(ONE) == P.system("ESRI:102003")
    two = P.parse(TWO)
    assert (two.method, two.lat0, two.lon0, two.lat1, two.lat2) == ("lambert", 39, -96, 33, 45)
    assert two.unit == pytest.approx(0.3048006) and two.x0 * two.unit == pytest.approx(1000)
    gon = P.parse(ONE.replace("0.0174532925199433", str(math.pi / 200)).replace("-96.0", "-106.66666666666667"))
    assert gon.lon0 == pytest.approx(-96) and gon.lat1 == pytest.approx(26.55)
    assert P.parse('GEOGCS["g",DATUM["d",SPHEROID["WGS 84",6378137,298.257223563]],UNIT["degree",0.0174532925199433]]') == P.system(4326)
    assert P.parse(f'COMPD_CS["both",{ONE},VERT_CS["v",UNIT["metre",1]]]') == P.system(102003)
    for bad in ("PROJCS[", "nothing", ONE.replace('"Albers"', '"Bonne"'), ONE.replace("Central_Meridian", "Azimuth")):
        with pytest.raises(ValueError):
            P.parse(bad)
    with pytest.raises(ValueError):
        P.system(27700)


def test_rings_between_systems(spark):
    ring = G.box_ring(-97.0, 39.0, -96.0, 40.0)
    there = G.reproject(G.reproject(ring, 4326, 26914), 26914, 5070)
    direct = G.reproject(ring, 4326, "EPSG:5070")
    a, b, c = spark.range(1).select(there.alias("a"), direct.alias("b"), G.reproject(G.reproject(ring, 4326, 102003), 102003, 5070).alias("c")).first()
    for p, q, r in zip(a, b, c):
        assert math.dist(p, q) < 0.001 and math.dist(q, r) < 0.001


def affine(a, c, e, f, b=0.0, d=0.0):
    return {"a": a, "b": b, "c": c, "d": d, "e": e, "f": f}


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(0).random((150, 170))


@pytest.fixture(scope="module")
def pixels(spark, image):
    """With gaps, and some NULLs."""
    data = [(r, c, None if (r * 3 + c) % 97 == 0 else float(image[r, c])) for r in range(150) for c in range(170) if (r * 7 + c) % 50]
    return spark.createDataFrame(data, "row int, col int, value double").cache()


def read(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def off(a, b):
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) for k in a)
    return max(abs(a[k] - b[k]) for k in a if a[k] is not None)


@pytest.mark.parametrize("method", ["bilinear", "nearest"])
@pytest.mark.parametrize("scale", [1.0, 9.0])
def test_same_system_equals_the_pixel_join(pixels, method, scale):
    source, target = affine(2.0, 10.0, -2.0, 400.0), affine(3.1 * scale, 5.3, -2.7 * scale, 410.0)
    h, w = (160, 120) if scale == 1 else (20, 14)
    assert off(read(warp.warp(pixels, source, 4326, target, 4326, h, w, method)), read(raster.warp(pixels, source, target, h, w, method))) < 1e-9


def inverse_albers(x, y):
    """Of 102003, by bisection on the forward formulas, in numpy."""
    s = P.system(102003)
    n, c, rho0 = P._cone(s)
    dx, dy = x / s.axis, rho0 - y / s.axis
    q = (c - (dx * dx + dy * dy) * n * n) / n
    low, high = np.full(np.shape(x), -1.57), np.full(np.shape(x), 1.57)
    for _ in range(60):
        mid = (low + high) / 2
        sin = np.sin(mid)
        now = (1 - s.e2) * (sin / (1 - s.e2 * sin**2) + np.arctanh(s.e * sin) / s.e)
        low, high = np.where(now < q, mid, low), np.where(now < q, high, mid)
    return np.degrees(np.arctan2(dx, dy) / n) + s.lon0, np.degrees(low)


@pytest.mark.parametrize("tolerance", [0.125, 0.0])
def test_between_systems(spark, tolerance):
    """A raster of geographic coordinates themselves, seen on an Albers grid: values tell where each pixel was read."""
    source, target = affine(0.01, -101.0, -0.01, 41.0), affine(1000.0, -340_000.0, -1000.0, 270_000.0)
    rows = spark.range(300).select(F.col("id").cast("int").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(399))))
    px = rows.withColumn("value", (F.col("col") + 1000.0 * F.col("row")).cast("double"))
    got = read(warp.warp(px, source, 4326, target, 102003, 200, 220, tolerance=tolerance))
    assert len(got) == 200 * 220
    r, c = np.meshgrid(np.arange(200), np.arange(220), indexing="ij")
    lon, lat = inverse_albers(target["c"] + (c + 0.5) * 1000, target["f"] - (r + 0.5) * 1000)
    u, v = (lon + 101) / 0.01 - 0.5, (41 - lat) / 0.01 - 0.5
    inside = (u > 0.5) & (u < 398.5) & (v > 0.5) & (v < 298.5)
    outside = (u < -1.5) | (u > 400.5) | (v < -1.5) | (v > 300.5)
    values = np.array([[math.nan if got[i, j] is None else got[i, j] for j in range(220)] for i in range(200)])
    assert np.isnan(values[outside]).all() and inside.sum() > 20_000
    error = np.abs(values - (u + 1000 * v))[inside].max()
    assert error < (1e-4 if tolerance == 0 else 1001 * 0.125) and (tolerance == 0 or error > 1e-6)


def test_pixels_are_shuffled_once(pixels):
    plan = warp.warp(pixels, affine(0.01, -100.0, -0.01, 40.0), 4326, affine(1000.0, -340_000.0, -1000.0, 270_000.0), 102003, 200, 220)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryTableScan") <= 1 + plan.count("InMemoryRelation") and "Python" not in plan
