"""Tiles that arrive in a folder: a file stream that summarises each new file once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import strings
from ..sources import tiff

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) to (path, pixels, mean, zeros)."""
    for b in batches:
        rows = {"path": [], "pixels": [], "mean": [], "zeros": []}
        for p, c in zip(b.column(0).to_pylist(), b.column(1)):
            image = tiff.read(c.as_py())[0].astype(np.float64)
            rows["path"].append(p)
            rows["pixels"].append(int(np.isfinite(image).sum()))
            rows["mean"].append(float(np.nanmean(image)) if np.isfinite(image).any() else None)
            rows["zeros"].append(int((image == 0).sum()))
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("path", pa.string()), ("pixels", pa.int64()), ("mean", pa.float64()), ("zeros", pa.int64())]))


def ingest(spark: SparkSession, folder: str, out: str, state: str) -> None:
    """Append a row for each file not seen before to the Parquet table ``out``, then stop.

    The checkpoint in ``state`` makes reruns, and runs after a loss, take each file once.
    """
    files = spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", "*.tif*").load(folder)
    made = files.select("path", "content").mapInArrow(summaries, "path string, pixels long, mean double, zeros long")
    named = made.withColumn("name", strings.stem(F.col("path"), "tif"))
    named.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
