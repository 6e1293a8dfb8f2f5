"""Rasters, buildings, metros and loss curves derived from the star-schema tables.

One order is one pixel of a raster that is WIDTH pixels wide; parts are rectangular buildings;
nations are metros on a 5 x 5 grid; events are loss curves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

WIDTH = 100
#: Land-cover class by last digit.
CLASSES = (0, 11, 21, 22, 23, 24, 31, 42, 82, 95)
IDENTITY = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 1.0, "f": 0.0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows by key over as many tasks as a shuffle has; small ones are not joined to larger ones again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _class(digit: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (digit + 1).cast("int"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, row, col, cur and proj (classes), bf (fraction), bh (feet)."""
    o = table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    return o.select(
        k.alias("k"),
        F.floor(k / WIDTH).cast("int").alias("row"),
        (k % WIDTH).cast("int").alias("col"),
        _class(F.col("o_custkey") % 10).alias("cur"),
        _class((F.col("o_custkey") + k % 3) % 10).alias("proj"),
        ((price % 1001) / F.lit(1000.0)).alias("bf"),
        (price % 400).cast("double").alias("bh"),
    )


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the raster (a count from file footers)."""
    return table(spark, sf_dir, "orders").count() // WIDTH


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, bfp, bhp of the orders that have lines."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("k")).agg((F.avg("l_discount") * 10).alias("bfp"), (F.avg("l_quantity") * 5).alias("bhp"))


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with predictions; NULL where there are none."""
    return pixels(spark, sf_dir).join(predicted(spark, sf_dir), "k", "left")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x0, y0, w, h, height_ft, footprint (text), ring, bbox."""
    # Few small files hold all parts, and each row means much work: the rows are dealt to all cores.
    p, k = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"), F.col("p_partkey")
    b = p.select(
        k.alias("id"),
        (k * 37 % 1000).cast("double").alias("x0"),
        (k * 91 % 1000).cast("double").alias("y0"),
        (1 + F.col("p_size") % 7).cast("double").alias("w"),
        (1 + F.col("p_size") % 11).cast("double").alias("h"),
        (k * 13 % 400).cast("double").alias("height_ft"),
    )
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    text = F.concat_ws("_", *[F.concat_ws("/", y.cast("string"), x.cast("string")) for x, y in corners])
    ring = G.box_ring(x0, y0, x1, y1)
    return b.withColumns({"footprint": text, "ring": ring, "bbox": F.struct(x0.alias("minx"), y0.alias("miny"), x1.alias("maxx"), y1.alias("maxy"))})


def extent(df: DataFrame, box: str = "bbox") -> DataFrame:
    """Total bounds, one row."""
    b = F.col(box)
    return df.agg(F.min(b["minx"]).alias("minx"), F.min(b["miny"]).alias("miny"), F.max(b["maxx"]).alias("maxx"), F.max(b["maxy"]).alias("maxy"))


def existing_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of side 20 as bounds ``box``."""
    k = F.col("s_suppkey")
    x, y = (k * 53 % 1000).cast("double"), (k * 29 % 1000).cast("double")
    return table(spark, sf_dir, "supplier").select(F.struct(x.alias("minx"), y.alias("miny"), (x + 20).alias("maxx"), (y + 20).alias("maxy")).alias("box"))


def metros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metro, name ("City, ST"), polygon and its bounds ``box``."""
    k = F.col("n_nationkey")
    state = F.element_at(F.array(*[F.lit(s) for s in ("AA", "BB-CC", "PR", "DD", "EE-FF-GG")]), F.col("n_regionkey") + 1)
    x, y = (k % 5 * 200).cast("double"), (F.floor(k / 5) * 200).cast("double")
    ring = G.box_ring(x, y, x + 200, y + 200)
    box = F.struct(x.alias("minx"), y.alias("miny"), (x + 200).alias("maxx"), (y + 200).alias("maxy"))
    return table(spark, sf_dir, "nation").select(k.alias("metro"), F.concat_ws(", ", "n_name", state).alias("name"), ring.alias("polygon"), box.alias("box"))


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metro, pop."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("metro")).agg((F.count(F.lit(1)) * 1000).alias("pop"))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lr, line, loss."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("lr"), F.col("event_id").alias("line"), F.col("value").alias("loss"))
