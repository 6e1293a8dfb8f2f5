"""CSV and Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import strings
from ..operators.tabular import keep_columns

# The columns of the building files.
BUILDING_COLUMNS = ["ID", "State_Abbr", "Area", "Area2D", "Height", "NumFloors", "WWR_surfaces", "BuildingType", "Standard", "lat", "lon", "geometry"]


def csv(spark: SparkSession, path: str, schema: str | None = None, drop_first: bool = False) -> DataFrame:
    """With a header; fails on malformed rows where a schema is given."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).option("mode", "FAILFAST").csv(path) if schema else reader.csv(path)
    return df.select(df.columns[1:]) if drop_first else df


def lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, line, value): the lines of text files with their numbers from 0; blank lines at a file's end are left out.

    Files are read in splits, never whole, and twice: lines are counted by split, a few numbers a
    split are summed in order, and each line adds its place in its split.  Both readings deal the
    same splits to the same partitions, as they plan the same files.
    """
    raw = spark.read.option("pathGlobFilter", pattern).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("_at"))
    filled = F.max(F.when(F.trim(F.regexp_replace("value", r"\s+", "")) != "", F.col("_at")))
    splits = raw.groupBy("path", "start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), filled.alias("_filled"))
    # One row a split, ordered within its file.
    file = Window.partitionBy("path")
    splits = splits.withColumn("_before", F.sum("_n").over(file.orderBy("start")) - F.col("_n"))
    splits = splits.withColumn("_last", F.max(F.col("_before") + F.col("_filled") - F.col("_first")).over(file)).drop("_n", "_filled")
    line = F.col("_before") + F.col("_at") - F.col("_first")
    return raw.join(splits, ["path", "start"]).where(line <= F.col("_last")).select("path", "name", line.alias("line"), "value")


def losses(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(lr, line, loss) of files with one number a line and no header; ``lr`` is the file's name."""
    return lines(spark, path, pattern).select(strings.stem(F.col("name"), "csv").alias("lr"), F.col("line").cast("int").alias("line"), F.col("value").try_cast("double").alias("loss"))


def buildings(spark: SparkSession, path: str) -> DataFrame:
    """Building CSVs, one a state: parsed centroids and footprints, tolerant of missing columns.

    Rows without a valid footprint go; ``state`` is the file's name.
    """
    raw = csv(spark, path).withColumn("state", strings.stem(F.col("_metadata.file_name"), "csv"))
    lat, lon = strings.centroid(F.col("Centroid"))
    parsed = raw.withColumns({"lat": lat, "lon": lon, "geometry": strings.ring(F.col("Footprint2D"))})
    return keep_columns(parsed, [*BUILDING_COLUMNS, "state"]).where(F.col("geometry").isNotNull())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever store Spark reaches."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).limit(1).count() > 0
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a whole result is there: jobs that died on the way leave no _SUCCESS file."""
    # Readers skip names that start with an underscore, so the store itself is asked.
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """Read a finished result that is there, else make and write it, over the remains of a job that died."""
    if not finished(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    """Parquet, partitioned (by state, layer, split): readers prune folders."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "overwrite", header: bool = True) -> None:
    """CSV, with a header (evaluation and scaling tables) or without (loss curves: one number a line)."""
    df.write.mode(mode).option("header", header).csv(path)
