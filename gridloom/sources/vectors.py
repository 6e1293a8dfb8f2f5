"""GeoPackage and shapefile layers as DataFrames, with attributes as a map and rings as arrays."""

from __future__ import annotations

import re
import sqlite3
import struct
from collections.abc import Iterator, Sequence
from contextlib import closing
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rasters import _arrow, files

_FEATURE = "path string, layer string, srid int, attributes map<string,string>, rings array<array<struct<x:double,y:double>>>, minx double, miny double, maxx double, maxy double"


def read_wkb(data: bytes, at: int = 0) -> tuple[list[list[tuple[float, float]]], int]:
    """Rings of a (multi)polygon and where it ends; extra dimensions are left out."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    dims = 2 + bool(code & 0x80000000 or code // 1000 % 10 in (1, 3)) + bool(code & 0x40000000 or code // 1000 % 10 in (2, 3))
    kind, at = (code & 0xFFFF) % 1000, at + 5 + 4 * bool(code & 0x20000000)
    n = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    rings: list[list[tuple[float, float]]] = []
    if kind == 6:
        for _ in range(n):
            more, at = read_wkb(data, at)
            rings += more
    elif kind == 3:
        for _ in range(n):
            m = struct.unpack_from(order + "I", data, at)[0]
            flat = struct.unpack_from(f"{order}{m * dims}d", data, at + 4)
            rings.append(list(zip(flat[::dims], flat[1::dims])))
            at += 4 + 8 * m * dims
    else:
        raise ValueError(f"geometry type {kind} is not a polygon")
    return rings, at


def write_wkb(rings: list[list[tuple[float, float]]]) -> bytes:
    """A polygon."""
    out = struct.pack("<BII", 1, 3, len(rings))
    for r in rings:
        out += struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    return out


def _feature(path: str, layer: str, srid: int | None, attributes: dict, rings: list) -> dict:
    xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
    box = dict(zip(("minx", "miny", "maxx", "maxy"), (min(xs), min(ys), max(xs), max(ys)))) if xs else {}
    return {"path": path, "layer": layer, "srid": srid, "attributes": [(k, None if v is None else str(v)) for k, v in attributes.items()], "rings": [[{"x": x, "y": y} for x, y in r] for r in rings], **box}


def _apart(box: tuple, minx: float, miny: float, maxx: float, maxy: float) -> bool:
    return minx > box[2] or box[0] > maxx or miny > box[3] or box[1] > maxy


def _database(path: str, content: bytes | None = None) -> sqlite3.Connection:
    """A GeoPackage in memory or, without content, where it lies: then only pages that are asked for are read."""
    if content is None:
        return sqlite3.connect(f"file:{quote(re.sub('^file:/+', '/', path))}?mode=ro&immutable=1", uri=True)
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def _geometries(db: sqlite3.Connection, layer: str | None) -> list[tuple]:
    every = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall()
    return [g for g in every if layer in (None, g[0])]


def _indexed(db: sqlite3.Connection, name: str, column: str, box: tuple | None) -> tuple[str, tuple] | None:
    """A subquery for the ids that the layer's R-tree gives for a box, if the file declares that it has one."""
    tree = f"rtree_{name}_{column}"
    try:
        stated = db.execute("SELECT count(*) FROM gpkg_extensions WHERE extension_name = 'gpkg_rtree_index' AND table_name = ? AND column_name = ?", (name, column)).fetchone()[0]
        if box is None or not stated:
            return None
        db.execute(f"SELECT id FROM {_quoted(tree)} LIMIT 1")
    except sqlite3.OperationalError:  # no extensions, no such tree, or SQLite without the module
        return None
    return f"SELECT id FROM {_quoted(tree)} WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?", (box[0], box[2], box[1], box[3])


def _key(db: sqlite3.Connection, name: str) -> str | None:
    """The column that is a table's row number; None for views."""
    kind = db.execute("SELECT type FROM sqlite_master WHERE name = ?", (name,)).fetchone()
    keys = [r[1] for r in db.execute(f"PRAGMA table_info({_quoted(name)})") if r[5] and (r[2] or "").upper() == "INTEGER"]
    return None if kind != ("table",) else _quoted(keys[0]) if len(keys) == 1 else "rowid"


def _gpkg_pieces(db: sqlite3.Connection, layer: str | None, box: tuple | None, most: int) -> Iterator[tuple]:
    """(layer, first, last) of ranges of some ``most`` row numbers, of those only that the R-tree gives."""
    for name, column, _ in _geometries(db, layer):
        key = _key(db, name)
        if key is None:
            yield name, None, None
            continue
        tree = _indexed(db, name, column, box)
        if tree:
            ends = [r[0] for r in db.execute(f"SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM ({tree[0]})) WHERE k % ? = 0 OR k = n ORDER BY id", (*tree[1], most))]
            yield from ((name, a + 1, b) for a, b in zip([-(1 << 63), *ends], ends))
            continue
        low, high = db.execute(f"SELECT min({key}), max({key}) FROM {_quoted(name)}").fetchone()
        if low is None:
            continue
        step = max(most, (high - low) // 4096 + 1)
        for first in range(low, high + 1, step):
            yield name, first, min(first + step - 1, high)


def _gpkg_rows(db: sqlite3.Connection, path: str, layer: str | None, box: tuple | None, columns: Sequence[str] | None, first: int | None = None, last: int | None = None) -> Iterator[dict]:
    for name, column, srid in _geometries(db, layer):
        quoted, key = _quoted(name), _key(db, name)
        there = [r[1] for r in db.execute(f"PRAGMA table_info({quoted})") if r[1] != column]
        wanted = there if columns is None else [c for c in there if c in columns]
        where, values = [], []
        tree = _indexed(db, name, column, box) if key else None
        if first is not None:
            where, values = [f"{key} BETWEEN ? AND ?"], [first, last]
        if tree:
            where, values = [*where, f"{key} IN ({tree[0]})"], [*values, *tree[1]]
        asked = f"SELECT {', '.join(_quoted(c) for c in [column, *wanted])} FROM {quoted}" + f" WHERE {' AND '.join(where)}" * bool(where)
        for blob, *found in db.execute(asked, values):
            held = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] if blob else 0
            if box and held:  # the header's bounds decide before the outline is decoded
                minx, maxx, miny, maxy = struct.unpack_from(("<" if blob[3] & 1 else ">") + "4d", blob, 8)
                if _apart(box, minx, miny, maxx, maxy):
                    continue
            rings = read_wkb(blob, 8 + held)[0] if blob and not blob[3] & 0x10 else []
            out = _feature(path, name, srid, dict(zip(wanted, found)), rings)
            if box is None or (rings and not _apart(box, out["minx"], out["miny"], out["maxx"], out["maxy"])):
                yield out


def _quoted(name: str) -> str:
    return '"{}"'.format(name.replace('"', '""'))


def gpkg(
    spark: SparkSession, path: str, layer: str | None = None, box: tuple[float, float, float, float] | None = None, columns: Sequence[str] | None = None, most: int = 50_000
) -> DataFrame:
    """Features of GeoPackages: of one layer or all, of a bounding box or all, with some attributes or all.

    Layer, columns and box are applied inside the file, before outlines are decoded.  Files on mounted
    folders are opened where they lie, dealt to tasks by some ``most`` row numbers, and read by pages:
    with a box and an R-tree, those of the features that it gives.  Files of other stores are fetched
    whole, one task each.
    """
    found = files(spark, path, "*.gpkg")
    if not mounted(spark, path):
        return features(found, layer, box, columns)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                with closing(_database(p)) as db:
                    rows = [(p, *x) for x in _gpkg_pieces(db, layer, box, most)]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "layer", "first", "last"])

    def rows_of(p: str, name: str, first: int | None, last: int | None) -> Iterator[dict]:
        with closing(_database(p)) as db:
            yield from _gpkg_rows(db, p, name, box, columns, first, last)

    pieces = found.select("path").mapInArrow(plan, "path string, layer string, first long, last long")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _read(pieces.repartition(tasks), rows_of)


def mounted(spark: SparkSession, path: str) -> bool:
    """Whether a path lies in a folder that all machines see as their own."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def features(found: DataFrame, layer: str | None = None, box: tuple[float, float, float, float] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """``gpkg`` of (path, content)."""
    return _read(found, lambda p, c: _gpkg_rows(_database(p, c), p, layer, box, columns))


def layers(spark: SparkSession, path: str) -> DataFrame:
    """(path, layer, srid) of GeoPackages, without reading features."""
    found = files(spark, path, "*.gpkg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, *content in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                with closing(_database(p, *content)) as db:
                    rows += [(p, name, srid) for name, _, srid in _geometries(db, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["path", "layer", "srid"])

    return (found.select("path") if mounted(spark, path) else found).mapInArrow(run, "path string, layer string, srid int")


def _read(content: DataFrame, rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for values in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                for row in rows_of(*values):
                    held.append(row)
                    if len(held) == 2000:
                        yield from pa.Table.from_pylist(held, schema).to_batches()
                        held = []
            yield from pa.Table.from_pylist(held, schema).to_batches()

    schema = _arrow(_FEATURE)
    return content.mapInArrow(run, _FEATURE)


def write_gpkg(features: list[dict], layer: str, srid: int = 4326) -> bytes:
    """A GeoPackage of one layer: rows of attributes with ``rings``."""
    return write_layers({layer: features}, srid)


def write_layers(layers_: dict[str, list[dict]], srid: int = 4326) -> bytes:
    """A GeoPackage of several layers, each with bounds in its outlines' headers and, if SQLite can, an R-tree."""
    db = sqlite3.connect(":memory:")
    db.executescript(
        "PRAGMA application_id = 1196444487;"
        "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT);"
        "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INTEGER);"
        "CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);"
    )
    authority = "EPSG" if srid < 65536 else "ESRI"
    db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined')", (f"{authority}:{srid}", srid, authority, srid))
    for layer, features in layers_.items():
        columns = [k for k in features[0] if k != "rings"] if features else []
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (layer, layer, srid))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srid))
        names = [_quoted(c) for c in ["fid", *columns, "geom"]]
        db.execute(f"CREATE TABLE {_quoted(layer)} ({', '.join([names[0] + ' INTEGER PRIMARY KEY NOT NULL', *names[1:]])})")
        tree = _make_tree(db, layer)
        for k, f in enumerate(features, 1):
            points = [p for r in f["rings"] for p in r]
            spans = [g(p[i] for p in points) for i in (0, 1) for g in (min, max)] if points else []
            head = b"GP\0" + bytes([1 | 2 * bool(spans) | 16 * (not spans)]) + struct.pack("<i", srid) + struct.pack(f"<{len(spans)}d", *spans)
            db.execute(f"INSERT INTO {_quoted(layer)} VALUES ({', '.join('?' * len(names))})", (k, *(f[c] for c in columns), head + write_wkb(f["rings"])))
            if tree and spans:
                db.execute(f"INSERT INTO {tree} VALUES (?, ?, ?, ?, ?)", (k, *spans))
        if tree:
            _keep_tree(db, layer, tree)
    db.commit()
    return bytes(db.serialize())


def _make_tree(db: sqlite3.Connection, layer: str) -> str | None:
    """The (quoted) name of a new R-tree of a layer, declared as an extension; None if SQLite has none."""
    tree = _quoted(f"rtree_{layer}_geom")
    try:
        db.execute(f"CREATE VIRTUAL TABLE {tree} USING rtree(id, minx, maxx, miny, maxy)")
    except sqlite3.OperationalError:
        return None
    db.execute("CREATE TABLE IF NOT EXISTS gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT, definition TEXT, scope TEXT)")
    db.execute("INSERT INTO gpkg_extensions VALUES (?, 'geom', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only')", (layer,))
    return tree


def _keep_tree(db: sqlite3.Connection, layer: str, tree: str) -> None:
    """Triggers by which other programs keep the R-tree; their functions are those programs' own."""
    add = f"INSERT OR REPLACE INTO {tree} SELECT NEW.fid, ST_MinX(NEW.geom), ST_MaxX(NEW.geom), ST_MinY(NEW.geom), ST_MaxY(NEW.geom) WHERE NEW.geom IS NOT NULL AND NOT ST_IsEmpty(NEW.geom);"
    remove = f"DELETE FROM {tree} WHERE id = OLD.fid;"
    for event, done in (("insert", add), ("update", remove + add), ("delete", remove)):
        db.execute(f"CREATE TRIGGER {_quoted(f'rtree_{layer}_geom_{event}')} AFTER {event.upper()} ON {_quoted(layer)} BEGIN {done} END")


def packed(df: DataFrame, file: str, layer: str, rings: str = "rings", srid: int = 4326, most: int = 100_000) -> DataFrame:
    """(name, content): the rows of each value of ``file`` as GeoPackages with a layer for each value of ``layer``.

    Rows of a file and layer are dealt to parts of ``most`` rows or so (by a count and a hash), named
    ``file.gpkg``, ``file-1.gpkg``..., so that no file grows with its rows; ``rasters.FileSink``
    writes them.  Other columns are attributes.  Rows without file or layer go to one named ``unnamed``.
    """
    plain = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unnamed")) for c in (file, layer)})
    sizes = plain.groupBy(file).agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    own = plain.join(sizes, file).withColumn("_part", F.pmod(F.xxhash64(*[c for c in plain.columns if c != rings], F.col(rings).cast("string")), F.col("_parts")))
    others = [c for c in df.columns if c not in (file, layer, rings)]
    sent = own.select(F.col(file).alias("_file"), "_part", F.col(layer).alias("_layer"), F.col(rings).alias("_rings"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def flush() -> pa.RecordBatch:
            name = f"{key[0]}{f'-{key[1]}' * bool(key[1])}.gpkg"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_layers(held, srid)], pa.binary())], names=["name", "content"])

        for b in batches:
            for row in b.to_pylist():
                if (row["_file"], row["_part"]) != key:
                    if held:
                        yield flush()
                    key, held = (row["_file"], row["_part"]), {}
                outline = [[(p["x"], p["y"]) for p in r] for r in row["_rings"] or []]
                held.setdefault(row["_layer"], []).append({**{c: row[c] for c in others}, "rings": outline})
        if held:
            yield flush()

    return sent.repartition("_file", "_part").sortWithinPartitions("_file", "_part", "_layer").mapInArrow(run, "name string, content binary")


def _shapes(data: bytes) -> list[list[list[tuple[float, float]]]]:
    out, at = [], 100
    while at + 8 <= len(data):
        size = struct.unpack_from(">I", data, at + 4)[0] * 2
        kind = struct.unpack_from("<I", data, at + 8)[0]
        rings = []
        if kind in (5, 15, 25):
            parts, n = struct.unpack_from("<2I", data, at + 44)
            ends = [*struct.unpack_from(f"<{parts}I", data, at + 52), n]
            flat = struct.unpack_from(f"<{2 * n}d", data, at + 52 + 4 * parts)
            points = list(zip(flat[::2], flat[1::2]))
            rings = [points[i:j] for i, j in zip(ends, ends[1:])]
        out.append(rings)
        at += 8 + size
    return out


def _table(data: bytes) -> list[dict]:
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
        at += 32
    rows = []
    for k in range(n):
        place, row = head + k * size + 1, {}
        for name, width in fields:
            row[name] = data[place : place + width].decode("utf-8", "replace").strip() or None
            place += width
        rows.append(row)
    return rows


# Names of coordinate systems in .prj files that carry no authority code.
_SYSTEMS = {"GCS_WGS_1984": 4326, "GCS_North_American_1983": 4269, "USA_Contiguous_Albers_Equal_Area_Conic": 102003}


def prj_code(text: str | None) -> int | None:
    """The code of a system in well-known text: its outermost authority, or a known name."""
    codes = re.findall(r'AUTHORITY\["[A-Z]+", ?"(\d+)"\]\]$', (text or "").strip())
    name = re.match(r'\s*\w+\["([^"]*)"', text or "")
    return int(codes[0]) if codes else _SYSTEMS.get(name[1]) if name else None


def _shapefile_rows(path: str, shp: bytes, dbf: bytes | None, prj: bytes | None) -> Iterator[dict]:
    shapes = _shapes(shp)
    layer, srid = path.rsplit("/", 1)[-1].removesuffix(".shp"), prj_code(prj.decode("latin-1") if prj else None)
    for rings, row in zip(shapes, _table(dbf) if dbf else [{}] * len(shapes)):
        yield _feature(path, layer, srid, row, rings)


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Features of shapefiles; the attribute table and the coordinate system beside each are joined by its name."""
    every = files(spark, path, "*.{shp,dbf,prj}").withColumn("stem", F.regexp_replace("path", r"\.(shp|dbf|prj)$", ""))
    met = every.where(F.col("path").endswith(".shp")).select("stem", "path", F.col("content").alias("shp"))
    for kind in ("dbf", "prj"):
        met = met.join(every.where(F.col("path").endswith(f".{kind}")).select("stem", F.col("content").alias(kind)), "stem", "left")
    return _read(met.select("path", "shp", "dbf", "prj"), _shapefile_rows)


def systems(spark: SparkSession, path: str) -> DataFrame:
    """(path, srid) of shapefiles' coordinate systems, read from their .prj files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [prj_code(c.as_py().decode("latin-1")) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.int32())], names=["path", "srid"])

    return files(spark, path, "*.prj").mapInArrow(run, "path string, srid int")
