"""Files written and read again."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import raster
from gridloom.sources import rasters, tables, tiff, vectors
from gridloom.streaming import tiles as stream

T = {"a": 30.0, "b": 0.0, "c": 1000.0, "d": 0.0, "e": -30.0, "f": 5000.0}


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["u1", "i2", "i4", "f4", "f8"]), st.integers(1, 3), st.integers(1, 9), st.integers(1, 9), st.booleans())
def test_tiff_round_trip(kind, bands, height, width, compress):
    image = (np.arange(bands * height * width) % 120).astype(kind).reshape(bands, height, width)
    data = tiff.write(image, T, 32611, -9999.0 if kind != "u1" else None, compress)
    assert np.array_equal(tiff.read(data), image)
    m = tiff.metadata(data)
    assert (m["height"], m["width"], m["bands"], m["dtype"], m["srid"], m["transform"]) == (height, width, bands, kind, 32611, T)


def test_raster_files(spark, tmp_path):
    image = np.arange(12.0 * 20).reshape(12, 20)
    image[3, 4] = np.nan
    px = spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(image)], "row int, col int, value double")
    cut = px.where("row < 10").withColumns({"win_row": (F.floor(F.col("row") / 10) * 10).cast("int"), "win_col": (F.floor(F.col("col") / 10) * 10).cast("int")})
    named = raster.to_tiles(cut, 10).withColumn("name", F.concat(F.lit("LULC_7_"), (F.col("win_col") / 10).cast("int"), F.lit(".tif")))
    spark.dataSource.register(rasters.FileSink)
    rasters.encoded(named, T, nodata=-1.0).write.format("gridloom_files").mode("append").save(str(tmp_path / "a"))
    (tmp_path / "a" / "broken.tif").write_bytes(b"no tiff")
    meta = rasters.metadata(spark, str(tmp_path))
    found = {r["path"].rsplit("/", 1)[-1]: r for r in meta.collect()}
    assert found["broken.tif"]["error"] and found["LULC_7_1.tif"]["transform"]["c"] == 1300.0
    boxes = {r["path"].rsplit("/", 1)[-1]: r for r in rasters.bounds(meta).collect()}
    assert boxes["broken.tif"]["minx"] is None and (boxes["LULC_7_1.tif"]["minx"], boxes["LULC_7_1.tif"]["maxy"]) == (1300.0, 5000.0)
    read = rasters.pixels(rasters.blocks(spark, str(tmp_path), 4, "LULC*.tif"))
    got = {(r["row"], r["col"] + (10 if r["path"].endswith("_1.tif") else 0)): r["value"] for r in read.collect()}
    assert len(got) == 200 and got[3, 4] is None and all(v == image[k] for k, v in got.items() if v is not None)


def features():
    square = lambda x: [[(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]]
    return [{"NAME": f"n{i}", "pop": i, "rings": square(float(i))} for i in range(5)]


def test_geopackage(spark, tmp_path):
    (tmp_path / "x.gpkg").write_bytes(vectors.write_gpkg(features(), "CA"))
    df = vectors.gpkg(spark, str(tmp_path), "CA")
    assert df.count() == 5 and vectors.gpkg(spark, str(tmp_path), "NV").count() == 0
    assert [tuple(r)[1:] for r in vectors.layers(spark, str(tmp_path)).collect()] == [("CA", 4326)]
    some = vectors.gpkg(spark, str(tmp_path), box=(1.5, 0.2, 2.5, 0.4)).orderBy("minx").collect()
    assert [r["attributes"]["NAME"] for r in some] == ["n1", "n2"] and some[0]["srid"] == 4326
    assert [tuple(p) for p in some[0]["rings"][0]] == features()[1]["rings"][0]


def shapefile_bytes(rows):
    body = b""
    for k, f in enumerate(rows, 1):
        p = f["rings"][0]
        content = struct.pack("<I4d2I", 5, 0, 0, 0, 0, 1, len(p)) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *q) for q in p)
        body += struct.pack(">2I", k, len(content) // 2) + content
    table = struct.pack("<B3BIHH20x", 3, 1, 1, 1, len(rows), 32 + 32 + 1, 11) + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14 + b"\r"
    return b"\0" * 100 + body, table + b"".join(b" " + f["NAME"].encode().ljust(10) for f in rows)


def test_shapefile(spark, tmp_path):
    shp, dbf = shapefile_bytes(features())
    (tmp_path / "m.shp").write_bytes(shp)
    (tmp_path / "m.dbf").write_bytes(dbf)
    rows = vectors.shapefile(spark, str(tmp_path)).orderBy("minx").collect()
    assert [r["attributes"]["NAME"] for r in rows] == [f["NAME"] for f in features()] and rows[4]["maxx"] == 5.0


def test_wkb_with_heights():
    ring = struct.pack("<I", 4) + struct.pack("<12d", 0, 0, 9, 1, 0, 9, 1, 1, 9, 0, 0, 9)
    assert vectors.read_wkb(struct.pack("<BII", 1, 1003, 1) + ring)[0] == [[(0, 0), (1, 0), (1, 1), (0, 0)]]
    with pytest.raises(ValueError):
        vectors.read_wkb(struct.pack("<BII", 1, 1, 0))


def test_tables(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "CA.csv").write_text('n,ID,Centroid,Footprint2D,Height\n0,1,1/2,0/0_0/3_3/3_3/0,10\n1,2,x/2,0/0_1,5\n')
    rows = tables.buildings(spark, str(tmp_path / "b")).collect()
    assert len(rows) == 1 and rows[0]["state"] == "CA" and rows[0]["lat"] == 1.0 and len(rows[0]["geometry"]) == 5
    (tmp_path / "l").mkdir()
    for name, values in (("0.001", "3\n2.5\n1\n"), ("0.1", "9\n8")):
        (tmp_path / "l" / f"{name}.csv").write_text(values)
    got = sorted(map(tuple, tables.losses(spark, str(tmp_path / "l")).collect()))
    assert got == [("0.001", 0, 3.0), ("0.001", 1, 2.5), ("0.001", 2, 1.0), ("0.1", 0, 9.0), ("0.1", 1, 8.0)]
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert made == [1]


def test_arriving_tiles(spark, tmp_path):
    into = tmp_path / "in"
    into.mkdir()
    for k in range(3):
        (into / f"t{k}.tif").write_bytes(tiff.write(np.full((1, 4, 4), float(k), np.float32), T))
    for _ in range(2):  # the second run finds nothing new
        stream.ingest(spark, str(into), str(tmp_path / "out"), str(tmp_path / "state"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["name"], r["mean"]) for r in out.collect()) == [(f"t{k}", float(k)) for k in range(3)]


def test_half_written_results_are_made_again(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = str(tmp_path / "kept")
    assert [tables.cached(spark, path, make).count() for _ in range(2)] == [3, 3] and len(made) == 1
    (tmp_path / "kept" / "_SUCCESS").unlink()
    assert tables.cached(spark, path, make).count() == 3 and len(made) == 2
    tables.save_csv(spark.range(2), str(tmp_path / "plain"), header=False)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "plain")).collect()) == ["0", "1"]


def lzw(data):
    """Packs with codes of 9 to 12 bits."""
    bits, table, width, now = [], {bytes([i]): i for i in range(256)}, 9, b""
    emit = lambda code: bits.append(format(code, f"0{width}b"))
    emit(256)
    n = 258
    for i in range(len(data)):
        more = now + data[i : i + 1]
        if more in table:
            now = more
            continue
        emit(table[now])
        table[more], n, now = n, n + 1, data[i : i + 1]
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4094:
            emit(256)
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
    if now:
        emit(table[now])
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    emit(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 9), st.integers(1, 20_000), st.integers(1, 256))
def test_lzw(seed, size, letters):
    data = np.random.default_rng(seed).integers(0, letters, size).astype(np.uint8).tobytes()
    assert tiff.unpack_lzw(lzw(data)) == data


def bigtiff(image, tile, packing=1, predictor=1, order="<"):
    """A tiled BigTIFF of (bands, height, width) with samples together."""
    bands, height, width = image.shape
    kind = image.dtype
    whole = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile, bands), kind)
    whole[:height, :width] = image.transpose(1, 2, 0)
    parts = []
    for r in range(0, height, tile):
        for c in range(0, width, tile):
            block = whole[r : r + tile, c : c + tile]
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((tile, 1, bands), kind))
            raw = block.astype(kind.newbyteorder(order)).tobytes()
            if predictor == 3:
                planes = np.ascontiguousarray(block.astype(f">f{kind.itemsize}")).view(np.uint8).reshape(tile, tile * bands, kind.itemsize).transpose(0, 2, 1).reshape(tile, -1)
                before = np.concatenate([np.zeros((tile, bands), np.uint8), planes[:, :-bands]], 1)
                raw = (planes - before).tobytes()
            parts.append(lzw(raw) if packing == 5 else zlib.compress(raw) if packing == 8 else raw)
    at, starts = 16, []
    for p in parts:
        starts.append(at)
        at += len(p)
    n = {"u": 1, "i": 2, "f": 3}[kind.kind]
    fields = [(256, "I", (width,)), (257, "I", (height,)), (258, "H", (kind.itemsize * 8,) * bands), (259, "H", (packing,)), (277, "H", (bands,)), (284, "H", (1,)), (317, "H", (predictor,)), (322, "I", (tile,)), (323, "I", (tile,)), (324, "Q", tuple(starts)), (325, "Q", tuple(map(len, parts))), (339, "H", (n,) * bands)]
    base, entries, extra = at + 8 + 20 * len(fields) + 8, b"", b""
    for tag, c, values in fields:
        raw = struct.pack(f"{order}{len(values)}{c}", *values)
        entries += struct.pack(order + "HHQ", tag, {"H": 3, "I": 4, "Q": 16}[c], len(values))
        if len(raw) > 8:
            entries += struct.pack(order + "Q", base + len(extra))
            extra += raw
        else:
            entries += raw.ljust(8, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HHHQ", 43, 8, 0, at)
    return head + b"".join(parts) + struct.pack(order + "Q", len(fields)) + entries + b"\0" * 8 + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packing", [1, 5, 8])
@pytest.mark.parametrize("kind,predictor", [("u1", 1), ("u1", 2), ("i2", 2), ("f4", 3), ("f8", 3)])
@pytest.mark.parametrize("bands", [1, 3])
def test_tiled_windows(order, packing, kind, predictor, bands):
    image = np.random.default_rng(1).integers(0, 100, (bands, 21, 35)).astype(kind)
    data = bigtiff(image, 16, packing, predictor, order)
    assert np.array_equal(tiff.read(data), image)
    asked = []
    part = lambda a, n: asked.append(n) or data[a : a + n]
    assert np.array_equal(tiff.read(part, (17, 3, 9, 10)), image[:, 17:26, 3:13])
    assert sum(asked) < len(data) * 0.7 or packing != 1
    assert tiff.read(data, (30, 0, 5, 5)).shape == (bands, 0, 5)


def test_large_codes():
    data = tiff.write(np.zeros((1, 2, 2), "f4"), T, 102003)
    assert tiff.metadata(data)["srid"] == 102003


def test_ranged_windows(spark, tmp_path):
    image = np.arange(50.0 * 40).reshape(1, 50, 40)
    (tmp_path / "a b.tif").write_bytes(bigtiff(image, 16, 8))
    (tmp_path / "c.tif").write_bytes(tiff.write(image, T, 32611, 7.0))
    whole = {tuple(r) for r in rasters.pixels(rasters.blocks(spark, str(tmp_path), 8)).collect()}
    assert len(whole) == 4000 and {tuple(r) for r in rasters.pixels(rasters.windows(spark, str(tmp_path), 8)).collect()} == whole
    some = {r for r in whole if 5 <= r[2] < 31 and 3 <= r[3] < 12}
    for read in (rasters.blocks(spark, str(tmp_path), 8, window=(5, 3, 26, 9)), rasters.windows(spark, str(tmp_path), 8, window=(5, 3, 26, 9))):
        assert {tuple(r) for r in rasters.pixels(read).collect()} == some
    ranged = rasters.metadata(spark, str(tmp_path), ranged=True).orderBy("path").collect()
    assert ranged == rasters.metadata(spark, str(tmp_path)).orderBy("path").collect() and [r["height"] for r in ranged] == [50, 50]
    assert rasters.metadata(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        rasters.windows(spark, str(tmp_path), 8, rows=12)


def test_layered_geopackages(spark, tmp_path):
    rows = [(f"f{i % 2}", f"L{i % 3}", i, [[(float(i), 0.0), (i + 1.0, 0.0), (float(i), 1.0)]]) for i in range(60)] + [(None, None, 99, None)]
    df = spark.createDataFrame(rows, "file string, layer string, id int, rings array<array<struct<x:double,y:double>>>")
    spark.dataSource.register(rasters.FileSink)
    vectors.packed(df, "file", "layer", most=10).write.format("gridloom_files").mode("append").save(str(tmp_path / "g"))
    back = vectors.gpkg(spark, str(tmp_path))
    assert sorted(int(r["attributes"]["id"]) for r in back.collect()) == sorted(r[2] for r in rows)
    assert {r["attributes"]["id"] for r in vectors.gpkg(spark, str(tmp_path), "L1", (3.5, 0, 9.5, 1)).collect()} == {"4", "7"}
    assert vectors.gpkg(spark, str(tmp_path), columns=[]).first()["attributes"] == {}
    assert len(list((tmp_path / "g").glob("f0*.gpkg"))) > 1


def test_systems(spark, tmp_path):
    shp, dbf = shapefile_bytes(features())
    (tmp_path / "m.shp").write_bytes(shp)
    (tmp_path / "m.dbf").write_bytes(dbf)
    (tmp_path / "m.prj").write_text('PROJCS["USA_Contiguous_Albers_Equal_Area_Conic",GEOGCS["x",AUTHORITY["EPSG","4269"]],UNIT["m",1]]')
    assert {r["srid"] for r in vectors.shapefile(spark, str(tmp_path)).collect()} == {102003}
    assert [r["srid"] for r in vectors.systems(spark, str(tmp_path)).collect()] == [102003]
    assert vectors.prj_code('GEOGCS["x",UNIT["d",0.1],AUTHORITY["EPSG","4326"]]') == 4326
    assert vectors.prj_code('GEOGCS["unknown"]') is None and vectors.prj_code(None) is None
