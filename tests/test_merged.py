"""Operators over rows that lie in several partitions, and at places that many shapes share."""

import math

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import nesting, noding
from gridloom.operators import repair, stats, vector
from gridloom.plans import fixtures, pipelines
from gridloom.plans.queries import QUERIES


def test_correlation_with_a_constant_over_partitions(spark):
    # Parts of 49 rows: 49 * (1 / 49) is not 1, so that merged variances of ones are not 0.
    rows = spark.range(0, 294, 1, 6).select((F.col("id") % 7).cast("double").alias("v"), F.lit(1.0).alias("one"))
    assert rows.agg(F.var_pop("one")).first()[0] > 0
    got = rows.agg(stats.correlation("v", "one").alias("a"), stats.correlation("one", "v").alias("b"), stats.correlation("v", "v").alias("c")).first()
    assert got["a"] is None and got["b"] is None and abs(got["c"] - 1) < 1e-12


def test_fits_of_constants_over_partitions(spark):
    # Three rows of a group in each partition: a third of these numbers, times three, is not the number.
    off = lambda v: v / 3 * 3 != v
    x, y = next(v / 1000 for v in range(1, 1000) if off(v / 1000)), next(v / 10 for v in range(3001, 4000) if off(v / 10))
    k = F.col("id").cast("double")
    rows = spark.range(0, 12, 1, 2).withColumn("g", F.col("id") % 2)
    df = rows.select("g", F.when(F.col("g") == 0, x).otherwise(k).alias("x"), F.when(F.col("g") == 1, y).otherwise(k).alias("y"))
    fixed, flat = stats.inference(stats.ols(df, "x", "y", ["g"])).orderBy("g").collect()
    assert fixed["n"] == flat["n"] == 6 and fixed["slope"] is None and fixed["p_value"] is None
    assert flat["slope"] == 0 and flat["intercept"] == y and flat["stderr"] == 0 and math.isnan(flat["p_value"])


def test_flat_fit_as_in_sql(spark, tmp_path):
    # Four pixels of one height, four of one fraction, four that vary.
    prices = [2399.5, 1599.5, 1999.5, 3199.5, 2000.5, 3001.5, 4002.5, 5003.5, 1700.5, 2950.5, 44444.5, 4217.5]
    con = duckdb.connect()
    con.sql(f"COPY (SELECT unnest(range(12)) AS o_orderkey, 1::BIGINT AS o_custkey, unnest({prices})::DOUBLE AS o_totalprice) TO '{tmp_path}/orders.parquet'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    query, sql = QUERIES["agg_t_inference"]
    want = con.sql(sql)
    got = query(spark, str(tmp_path)).select(want.columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.fetchall()))
    assert [math.isnan(r["p_value"]) for r in sorted(got)] == [True, False]


def test_buildings_are_dealt_to_all_cores(spark, sf_dir):
    parts = fixtures.buildings(spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_footprints_are_parsed_once_and_after_dealing(spark, sf_dir):
    for name, passes in (("jn_cells_left", 2), ("pipe_taylor", 1)):  # the extent is a pass of its own
        plan = QUERIES[name][0](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(", _, -1)") == passes
        assert not any("split(" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter"))


def test_texts_that_are_no_footprints(spark):
    df = spark.createDataFrame([(1, "0.0/0.0_0.0/2.0_3.0/2.0"), (2, None), (3, ""), (4, "0/0_1/x_1/1"), (5, "0/0_1/1")], "id int, footprint string").withColumn("height_ft", F.lit(10.0))
    assert [(r["id"], r["area"]) for r in pipelines.building_volumes(df).collect()] == [(1, 3.0)]


def test_sides_against_boxes_as_in_pairs(spark, sf_dir):
    rng = np.random.default_rng(3)
    closed = lambda n: [tuple(p) for p in (lambda r: r + r[:1])(rng.integers(0, 9, (n, 2)).astype(float).tolist())]
    rows = [(k, [closed(3) for _ in range(1 + k % 2)], *(float(v) for v in rng.integers(-2, 9, 2)), *(float(v) for v in rng.integers(1, 5, 2))) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, rings array<array<struct<x: double, y: double>>>, x double, y double, w double, h double")
    x, y, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    got = df.select(G.sides_meet_box(G.rings_edges("rings"), x, y, x1, y1).alias("a"), G.rings_intersect(G.box_ring(x, y, x1, y1), F.col("rings")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and 50 < sum(r["a"] for r in got) < 350
    plan = QUERIES["geo_burn_rings"][0](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "SIGNUM" not in plan and plan.count("exists(") == 1


def test_copies_of_bounds_are_compared_once(spark, monkeypatch):
    box = lambda x: F.struct(x.alias("minx"), F.lit(0.0).alias("miny"), (x + 1.0).alias("maxx"), F.lit(1.0).alias("maxy"))
    k = F.col("id")
    own = spark.range(400).select("id", box((k % 4).cast("double") * 2).alias("bbox")).unionByName(spark.range(400, 401).select("id", F.lit(None).cast("struct<minx:double,miny:double,maxx:double,maxy:double>").alias("bbox")))
    there = spark.range(300).select(box((k % 2).cast("double") * 4 + 0.5).alias("box"))
    met = []
    join = vector.join_by_cells
    monkeypatch.setattr(vector, "join_by_cells", lambda *a, **k: met.append((a[0].count(), a[1].count())) or join(*a, **k))
    free = {r[0] for r in vector.outside_boxes(own, there, 50.0).select("id").collect()}
    assert free == {i for i in range(400) if i % 4 in (1, 3)} | {400}
    assert met == [(4, 2)]


def _square(x, y, side):
    return [{"x": x + u * side, "y": y + v * side} for u, v in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]


def test_signs_of_many_polygons(monkeypatch):
    island = [_square(4, 4, 1), _square(0, 0, 10), _square(2, 2, 5), _square(20, 0, 3)]
    polygons = [island, None, [], [_square(0, 0, 1)] * 3, [_square(1, 1, 2), [{"x": 0.0, "y": 0.0}]]]
    want = [[1, 1, -1, 1], None, [], [1, -1, 1], [1, 1]]
    made = pa.array(polygons, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    assert nesting.signs(made).to_pylist() == want
    monkeypatch.setattr(noding, "PAIRS", 2)
    assert nesting.signs(made).to_pylist() == want
    assert nesting.signs(made.slice(2, 2)).to_pylist() == want[2:4]


def test_polygons_repaired_together(monkeypatch):
    rng = np.random.default_rng(5)
    polygons = [[rng.integers(0, 5, (rng.integers(0, 8), 2)).astype(float) + k for _ in range(k % 4)] for k in range(120)]
    each = [noding.even_odd(p) for p in polygons]
    rows = [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in polygons] + [None, [[{"x": 0.0, "y": None}]]]
    column = pa.array(rows, pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    for points in (1, 50, 1 << 16):
        monkeypatch.setattr(repair, "POINTS", points)
        got = repair._repaired(column, True).to_pylist()
        assert got[-2:] == [None, []]
        assert [[[tuple(p.values()) for p in r] for r in g] for g in got[:-2]] == [[[tuple(p) for p in r.tolist()] for r in e] for e in each]
