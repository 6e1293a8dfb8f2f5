"""Raster files as DataFrames, and DataFrames as raster files."""

from __future__ import annotations

import math
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import tiff

#: Files of a remote store moved at a time when a job is committed.
MOVES = 16

_BLOCK = "path string, band int, row0 int, col0 int, height int, width int, data array<double>, error string"
_META = "path string, height int, width int, bands int, dtype string, nodata double, srid int, transform struct<a:double,b:double,c:double,d:double,e:double,f:double>, error string"


def files(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """(path, content) of all files below a folder; none where the folder is missing.

    Contents are read only where they are used.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    try:
        return reader.load(path).select("path", "content")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, content binary")


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    """The store and place of one of Spark's paths, which are not escaped."""
    return pafs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", path), safe="/:@"))


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, for reading at any place."""
    store, place = _located(path if ":" in path else os.path.abspath(path))
    return store.open_input_file(place)


def _ranges(path: str):
    """A function (start, size) to bytes over a file of any store that Arrow knows."""
    f = opened(path)
    return lambda start, size: f.read_at(size, start)


def metadata(spark: SparkSession, path: str, pattern: str = "*.tif*", ranged: bool = False) -> DataFrame:
    """One row a file; files that are no GeoTIFF have an error and no more.

    ``ranged`` fetches headers only, from stores that Arrow knows; else files come whole.
    """
    found = files(spark, path, pattern)
    return described(found.select("path") if ranged else found)


def described(found: DataFrame) -> DataFrame:
    """``metadata`` of (path, content), or of (path) alone by ranged reads."""
    ranged = len(found.columns) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, c in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1)):
                try:
                    rows.append({"path": p, "error": None, **tiff.metadata(_ranges(p) if ranged else c.as_py())})
                except Exception as e:  # noqa: BLE001  the error is the result
                    rows.append({"path": p, "error": repr(e)})
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    schema = _arrow(_META)
    return found.mapInArrow(run, _META)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def bounds(meta: DataFrame) -> DataFrame:
    """(path, minx, miny, maxx, maxy); NULL where the file could not be read."""
    t = F.col("transform")
    x1, y1 = t["c"] + F.col("width") * t["a"], t["f"] + F.col("height") * t["e"]
    return meta.select("path", F.least(t["c"], x1).alias("minx"), F.least(t["f"], y1).alias("miny"), F.greatest(t["c"], x1).alias("maxx"), F.greatest(t["f"], y1).alias("maxy"))


def _cut(path: str, image: np.ndarray, nodata: float | None, top: int, left: int, size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of an image whose corner is at (top, left), NaN and nodata as NULL."""
    image = image.astype(np.float64)
    for band in range(image.shape[0]):
        for r in range(0, image.shape[1], size):
            for k in range(0, image.shape[2], size):
                part = image[band, r : r + size, k : k + size]
                gone = np.isnan(part) if nodata is None else np.isnan(part) | (part == nodata)
                values = pa.array(part.ravel(), mask=gone.ravel())
                cols = [[path], [band + 1], [top + r], [left + k], [part.shape[0]], [part.shape[1]]]
                arrays = [pa.array(x, f.type) for x, f in zip(cols, schema)]
                whole = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*arrays, whole, pa.nulls(1, pa.string())], schema=schema)


def _broken(path: str, error: Exception, schema: pa.Schema) -> pa.RecordBatch:
    """The row of a file, or a part of one, that could not be read."""
    return pa.RecordBatch.from_pylist([{"path": path, "error": repr(error)}], schema=schema)


def blocks(spark: SparkSession, path: str, size: int = 256, pattern: str = "*.tif*", window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Blocks of size x size pixels, NaN and nodata as NULL; a file is read by one task.

    A file that cannot be read is one row with its error and no data.  With ``window`` (row, column, height, width) only the strips and tiles in it are unpacked.
    """
    return decoded(files(spark, path, pattern), size, window)


def decoded(found: DataFrame, size: int = 256, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``blocks`` of (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1)):
                data = c.as_py()
                top, left = (max(x, 0) for x in (window or (0, 0))[:2])
                try:
                    image, nodata = tiff.read(data, window), tiff.metadata(data)["nodata"]
                except Exception as e:  # noqa: BLE001  the error is the result
                    yield _broken(p, e, schema)
                    continue
                yield from _cut(p, image, nodata, top, left, size, schema)

    schema = _arrow(_BLOCK)
    return found.mapInArrow(run, _BLOCK)


def windows(spark: SparkSession, path: str, size: int = 256, pattern: str = "*.tif*", window: tuple[int, int, int, int] | None = None, rows: int | None = None) -> DataFrame:
    """``blocks`` for large rasters on stores that Arrow knows: bands of rows are tasks' own range reads.

    Headers are read first; then bands of ``rows`` pixel rows in the window are dealt out, and a
    task fetches only their strips and tiles.  Without ``rows`` a band is as high as whole pieces
    (strips or tiles) of the file, so that none is fetched twice; no file is held whole but one
    that is a single piece.  What cannot be read is a row with an error.
    """
    if rows and rows % size:
        raise ValueError(f"{rows} rows are no multiple of {size}")
    top, left, tall, wide = window or (0, 0, 2**31 - 1, 2**31 - 1)
    schema = _arrow(_BLOCK)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                try:
                    m = tiff.layout(_ranges(p))
                except Exception as e:  # noqa: BLE001  the error is the result
                    yield pa.RecordBatch.from_pylist([{"path": p, "error": repr(e)}], schema=band_schema)
                    continue
                # Blocks and pieces begin together every ``step`` rows.
                step = rows or math.lcm(size, m["piece"])
                first, last = max(top, 0), min(m["height"], top + tall)
                starts = sorted({first, *range(first // step * step + step, last, step)}) if first < last else []
                ends = [*starts[1:], last]
                yield pa.RecordBatch.from_pylist([{"path": p, "at": i, "last": j} for i, j in zip(starts, ends)], schema=band_schema)

    band_ddl = "path string, at long, last long, error string"
    band_schema = _arrow(band_ddl)
    dealt = files(spark, path, pattern).select("path").mapInArrow(bands, band_ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = None, None
        for b in batches:
            for p, at, end, error in zip(*(b.column(k).to_pylist() for k in range(4))):
                if error:
                    yield pa.RecordBatch.from_pylist([{"path": p, "error": error}], schema=schema)
                    continue
                try:
                    if p != known:
                        known, part = p, _ranges(p)
                    image, nodata = tiff.read(part, (at, left, end - at, wide)), tiff.metadata(part)["nodata"]
                except Exception as e:  # noqa: BLE001  the error is the result
                    known = None
                    yield _broken(p, e, schema)
                    continue
                yield from _cut(p, image, nodata, at, max(left, 0), size, schema)

    # A number of tasks, as the rows are too small for adaptive execution to see the work behind them.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "path", "at").sortWithinPartitions("path", "at").mapInArrow(run, _BLOCK)


def pixels(blocks_: DataFrame) -> DataFrame:
    """(path, band, row, col, value)."""
    out = blocks_.select("path", "band", "row0", "col0", "width", F.posexplode("data").alias("i", "value"))
    return out.select("path", "band", (F.col("row0") + F.floor(F.col("i") / F.col("width"))).cast("int").alias("row"), (F.col("col0") + F.col("i") % F.col("width")).cast("int").alias("col"), "value")


def encoded(
    tiles: DataFrame, transform: dict[str, float], name: str = "name", dtype: str = "f4", srid: int | None = None, nodata: float | None = None, data: Sequence[str] = ("data",)
) -> DataFrame:
    """(name, content): tiles (name, win_row, win_col, size, data) as GeoTIFF files with shifted transforms.

    Each column of ``data`` is a band.
    """
    from ..functions.geometry import window_transform

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, out = [], []
            for n, r, c, s, *bands in zip(*(b.column(k) for k in range(b.num_columns))):
                values = [[np.nan if v is None else v for v in d.as_py()] for d in bands]
                array = np.array(values, np.float64).astype(dtype).reshape(len(bands), s.as_py(), s.as_py())
                names.append(n.as_py())
                out.append(tiff.write(array, window_transform(transform, r.as_py(), c.as_py()), srid, nodata))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["name", "content"])

    return tiles.select(F.col(name).alias("name"), "win_row", "win_col", "size", *data).mapInArrow(run, "name string, content binary")


class FileSink(DataSource):
    """Writes (name, content) rows as files of a folder, all of a job's or none.

    ``df.write.format("gridloom_files").mode("append").save(folder)`` after
    ``spark.dataSource.register(FileSink)``, on any store that Arrow knows and all executors reach.
    Tasks write beside the folder's files; the driver moves what finished tasks report.  Then
    overwrite removes the files that were there; append replaces files of the same names, or, with
    ``option("existing", "number")``, leaves them and numbers the new ones: name-1, name-2...
    A job that fails leaves the folder as it was.
    """

    @classmethod
    def name(cls) -> str:
        return "gridloom_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FileWriter(self.options["path"], overwrite, self.options.get("existing", "replace"))


class _Staged(WriterCommitMessage):
    """A task's folder and the names of the files 0, 1, 2... in it."""

    def __init__(self, own: str, names: list[str]):
        self.own, self.names = own, names


class _FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool, existing: str):
        if existing not in ("replace", "number"):
            raise ValueError(f"existing files are replaced or numbered, not {existing}")
        self.folder, self.overwrite, self.existing = folder, overwrite, existing
        self.staging = f".staging-{uuid.uuid4().hex}"

    def _store(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.folder or self.folder.startswith("file:"):
            return _located(self.folder)
        return pafs.LocalFileSystem(), self.folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = self._store()
        own = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # a task that runs twice has two
        store.create_dir(own, recursive=True)
        staged: dict[str, str] = {}
        for b in iterator:
            for n, c in zip(b.column("name").to_pylist(), b.column("content")):
                name = n.rsplit("/", 1)[-1]
                at = staged.setdefault(name, f"{own}/{len(staged)}")
                with store.open_output_stream(at) as f:
                    f.write(c.as_py())
        return _Staged(own, list(staged))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        there = {f.base_name for f in store.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File}
        taken = set() if self.overwrite else set(there)
        made: dict[str, tuple[str, int]] = {}  # of files of one name, the last is left
        for m in messages:
            for k, name in enumerate(m.names if m else ()):
                to = name
                if self.existing == "number" and not self.overwrite:
                    stem, dot, end = name.partition(".")
                    n = 0
                    while to in taken:
                        n += 1
                        to = f"{stem}-{n}{dot}{end}"
                    taken.add(to)
                made[to] = m.own, k

        def move(to: str) -> None:
            own, k = made[to]
            if to in there and not isinstance(store, pafs.LocalFileSystem):
                store.delete_file(f"{root}/{to}")  # a local move replaces
            store.move(f"{own}/{k}", f"{root}/{to}")

        if isinstance(store, pafs.LocalFileSystem):
            for to in made:
                move(to)
        else:  # stores that answer slowly
            names = iter(made)
            with ThreadPoolExecutor(MOVES) as pool:
                while some := list(islice(names, 10_000)):
                    list(pool.map(move, some))
        if self.overwrite:
            for old in there - made.keys():
                store.delete_file(f"{root}/{old}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")
