"""GeoTIFF files as a source of Spark's: filters on rows, columns and bands go into the files.

    geotiff.where(spark, folder, "row between 100 and 163 and col < 64 and band = 2")

is ``spark.read.format("geotiff").load(folder).where(...)`` after ``register(spark)``.  Spark 4.1
keeps what one query pushed into a loaded DataFrame for the next one that pushes nothing: load
anew for each ``where``, as this function does.

Pixels are rows (path, band, row, col, value); NaN and nodata are NULL.  A partition is a run of
whole strips or rows of tiles, of some PART pixels; those that no filter admits are not planned,
and of the others only the strips and tiles in question are fetched, each once.  Files of SMALL
bytes at most are fetched whole by the tasks, many to a task: planning reads no header of theirs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import tiff
from .rasters import _located, _ranges

#: Pixels of all bands in a partition, if the file's pieces are no larger.
PART = 1 << 22
#: Small files in a partition, if these make no more than TASKS partitions.
FILES, TASKS = 500, 1000
#: Bytes of a file that is fetched whole.
SMALL = 1 << 16
#: Pixels of a batch.
BATCH = 1 << 16
_SCHEMA = pa.schema([("path", pa.string()), ("band", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.float64())])
_END = 2**31 - 1


def register(spark: SparkSession) -> None:
    """Make ``format("geotiff")`` known, and filters of Python sources pushed."""
    spark.dataSource.register(GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)


def where(spark: SparkSession, path: str, condition: Column | str) -> DataFrame:
    """Pixels of all files below a folder (or of a file) that meet a condition."""
    register(spark)
    return spark.read.format("geotiff").load(path).where(condition)


class GeoTiff(DataSource):
    """``format("geotiff")``; option ``strict`` (default true): whether a file that cannot be read fails the job, or is left out."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "path string, band int, row int, col int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("strict", "true").lower() == "true")


class _Rows(InputPartition):
    """Runs of rows (path, first, last): one of a large file, or those of several; small files are names below ``whole``, without rows."""

    def __init__(self, runs: list[tuple[str, int, int]], whole: str = "", names: list[str] | None = None):
        self.runs, self.whole, self.names = runs, whole, names or []


class _Reader(DataSourceReader):
    def __init__(self, folder: str, strict: bool):
        self.folder, self.strict = folder, strict
        self.low, self.high = {"row": 0, "col": 0, "band": 1}, {"row": _END, "col": _END, "band": _END}
        self.bands: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            whole = isinstance(value, int) and not isinstance(value, bool)
            if name not in self.low:
                yield f
            elif isinstance(f, EqualTo) and whole:
                self.low[name], self.high[name] = max(self.low[name], value), min(self.high[name], value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and whole:
                self.low[name] = max(self.low[name], value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and whole:
                self.high[name] = min(self.high[name], value - isinstance(f, LessThan))
            elif isinstance(f, In) and name == "band" and all(isinstance(v, int) for v in f.value):
                self.bands = set(f.value) & (self.bands if self.bands is not None else set(f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """From the headers of all files but small ones; one list of names and headers at a time is on the driver."""
        store, root = _located(self.folder) if ":" in self.folder else (pafs.LocalFileSystem(), self.folder)
        info = store.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else "file://"
        rasters = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and ".tif" in f.base_name.lower())
        del found
        out: list[InputPartition] = []
        base = os.path.commonpath([os.path.dirname(p) for p, _ in rasters]) if rasters else ""
        names = [p[len(base) :] for p, size in rasters if size is not None and size <= SMALL]
        each = max(FILES, -(-len(names) // TASKS))
        out += [_Rows([], scheme + base, names[k : k + each]) for k in range(0, len(names), each)]
        small, held = [], 0
        for path, size in rasters:
            if size is not None and size <= SMALL:
                continue
            path = scheme + path
            try:
                m = tiff.layout(_ranges(path))
            except Exception:
                if self.strict:
                    raise
                continue
            runs = self._runs(path, m)
            if len(runs) > 1:
                out += [_Rows([r]) for r in runs]
            elif runs:
                small, held = small + runs, held + (runs[0][2] - runs[0][1]) * m["width"] * m["bands"]
                if held >= PART or len(small) == FILES:
                    out.append(_Rows(small))
                    small, held = [], 0
        return [*out, _Rows(small)] if small else out

    def _runs(self, path: str, m: dict) -> list[tuple[str, int, int]]:
        """A file's rows in question, PART pixels at a time."""
        first, last = max(self.low["row"], 0), min(self.high["row"] + 1, m["height"])
        if first >= last or self.low["col"] >= m["width"] or self.low["band"] > m["bands"] or self.high["col"] < 0:
            return []
        step = m["piece"] * max(1, PART // (m["piece"] * m["width"] * m["bands"]))
        return [(path, max(at, first), min(at + step, last)) for at in range(first // step * step, last, step)]

    def _wanted(self, band: int) -> bool:
        return self.low["band"] <= band <= self.high["band"] and (self.bands is None or band in self.bands)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in self._batches(partition) if partition else ():  # none, where there is nothing to read
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _batches(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, first, last in partition.runs:
            yield from self._read(_ranges(path), path, first, last)
        for name in partition.names:
            path = partition.whole + name
            try:
                content = _ranges(path)(0, SMALL)
                runs = self._runs(path, tiff.layout(content))
            except Exception:
                if self.strict:
                    raise
                continue
            for _, first, last in runs:
                yield from self._read(content, path, first, last)

    def _read(self, part: tiff.Source, path: str, first: int, last: int) -> Iterator[pa.RecordBatch]:
        nodata = tiff.metadata(part)["nodata"]
        left = max(self.low["col"], 0)
        image = tiff.read(part, (first, left, last - first, max(self.high["col"] + 1 - left, 0)), self._wanted)
        wide = image.shape[2]
        rows = max(1, BATCH // max(1, wide))
        for band in range(1, len(image) + 1):
            if not wide or not self._wanted(band):
                continue
            for r in range(0, image.shape[1], rows):
                values = image[band - 1, r : r + rows].astype(np.float64)
                gone = np.isnan(values) if nodata is None else np.isnan(values) | (values == nodata)
                tall = len(values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * values.size, pa.string()),
                        pa.array(np.full(values.size, band, np.int32)),
                        pa.array(np.repeat(np.arange(tall, dtype=np.int32) + first + r, wide)),
                        pa.array(np.tile(np.arange(wide, dtype=np.int32) + left, tall)),
                        pa.array(values.ravel(), mask=gone.ravel()),
                    ],
                    schema=_SCHEMA,
                )
