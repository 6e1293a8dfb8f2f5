"""Tiles: positional joins without an exchange, and windows by their neighbours' borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import raster, tiles


def pixels(spark, image, holes=()):
    data = [(r, c, float(v)) for (r, c), v in np.ndenumerate(image) if (r, c) not in holes]
    return spark.createDataFrame(data, "row int, col int, value double")


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(0).choice([0, 1, 2, 3], (70, 90), p=[0.02, 0.5, 0.4, 0.08]).astype(float)


def test_pack_and_unpack(spark, image):
    holes = {(3, 4), (69, 89)}
    px = pixels(spark, image, holes)
    packed = tiles.pack(px, 16)
    assert packed.count() == 5 * 6 and packed.where(F.size("data") != 256).count() == 0
    back = {(r["row"], r["col"]): r["data"] for r in tiles.unpack(packed, ["data"], 16).collect()}
    assert back == {(r["row"], r["col"]): r["value"] for r in px.collect()}


def test_stack_has_no_exchange(spark, image):
    names = ["a", "b", "c", "d"]
    for k, n in enumerate(names):
        tiles.save(tiles.pack(pixels(spark, image + k), 16), f"tiles_test_{n}", 4)
    met = tiles.stack(spark, {n: f"tiles_test_{n}" for n in names})
    out = tiles.combine(met, names, lambda p: p["a"] * p["b"] - p["c"] + p["d"], "out")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3
    got = {(r["row"], r["col"]): r["out"] for r in tiles.unpack(out, ["out"], 16).collect()}
    assert got == {k: v * (v + 1) - (v + 2) + (v + 3) for k, v in np.ndenumerate(image)}
    for n in names:
        spark.sql(f"DROP TABLE tiles_test_{n}")


@pytest.mark.parametrize("window,size", [(3, 16), (1, 16), (16, 16), (20, 8), (40, 8)])
def test_windows_equal_brute_force(spark, image, window, size):
    holes = {(40, 50)} if window < 20 else set()
    field = image if window < 10 else np.where(image == 0, 1, image)
    packed = tiles.pack(pixels(spark, field, holes), size)
    ok = field != 0
    for h in holes:
        ok[h] = False
    want = {(r, c) for r in range(71 - window) for c in range(91 - window) if ok[r : r + window, c : c + window].all()}
    assert want and {(r["row"], r["col"]) for r in tiles.valid_windows(packed, window, size).collect()} == want
    values = {(r["row"], r["col"], r["value"]) for r in tiles.window_values(packed, window, size).collect()}
    assert values == {(r, c, v) for r, c in want for v in np.unique(field[r : r + window, c : c + window])}


def test_large_windows(spark):
    """Windows of 256 pixels over tiles of 64; what is shuffled is borders, not pixels."""
    field = np.ones((300, 280))
    field[5, 7] = 0
    field[290, 100] = 2
    grid = spark.range(300 * 280).select(F.floor(F.col("id") / 280).cast("int").alias("row"), (F.col("id") % 280).cast("int").alias("col"))
    value = F.when((F.col("row") == 5) & (F.col("col") == 7), 0.0).when((F.col("row") == 290) & (F.col("col") == 100), 2.0).otherwise(1.0)
    packed = tiles.pack(grid.withColumn("value", value))
    got = {(r["row"], r["col"]) for r in tiles.valid_windows(packed, 256).collect()}
    assert got == {(r, c) for r in range(45) for c in range(25) if r > 5 or c > 7}
    twos = tiles.window_values(packed, 256).where("value = 2")
    assert {(r["row"], r["col"]) for r in twos.collect()} == {(r, c) for r, c in got if r >= 35}


def test_same_as_pixel_windows(spark, image):
    px = pixels(spark, image)
    a = tiles.valid_windows(tiles.pack(px, 16), 5, 16)
    b = raster.valid_windows(px.withColumn("valid", F.col("value") != 0), "valid", 5, *image.shape)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_only_borders_are_shuffled_from_bucketed_tiles(spark, image):
    tiles.save(tiles.pack(pixels(spark, image), 16), "tiles_test_windows", 8)
    table = spark.table("tiles_test_windows")
    spark.conf.set("spark.sql.adaptive.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = tiles.valid_windows(table, 3, 16)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" in plan
    assert tiles.valid_windows(table, 3, 16).count() == tiles.valid_windows(tiles.pack(pixels(spark, image), 16), 3, 16).count()
    spark.sql("DROP TABLE tiles_test_windows")
