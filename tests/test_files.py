"""Pushed filters, bands of whole strips, broken files, and a sink that writes all or nothing."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from gridloom.sources import geotiff, rasters, tiff

T = {"a": 30.0, "b": 0.0, "c": 500.0, "d": 0.0, "e": -30.0, "f": 900.0}


@pytest.fixture
def image():
    return np.arange(2 * 300 * 400, dtype="f8").reshape(2, 300, 400)


def counting(monkeypatch, module):
    """Bytes that ``module`` fetches, by range."""
    asked = []
    real = module._ranges

    def ranges(path):
        part = real(path)

        def fetch(start, size):
            asked.append((start, size))
            return part(start, size)

        return fetch

    monkeypatch.setattr(module, "_ranges", ranges)
    return asked


def test_write_makes_strips(image):
    data = tiff.write(image, T, compress=False)
    assert tiff.layout(data)["piece"] == 20 and np.array_equal(tiff.read(data), image)
    asked = []
    part = lambda a, n: asked.append(n) or data[a : a + n]
    assert np.array_equal(tiff.read(part, (100, 0, 20, 400))[1], image[1, 100:120]) and sum(asked) < len(data) / 10
    only = tiff.read(data, (0, 0, 5, 5), lambda b: b == 2)
    assert not only[0].any() and np.array_equal(only[1], image[1, :5, :5])


def test_filters_reach_the_strips(tmp_path, image, monkeypatch):
    (tmp_path / "a.tif").write_bytes(tiff.write(image, T, compress=False))
    (tmp_path / "note.txt").write_text("no raster")
    monkeypatch.setattr(geotiff, "PART", 20 * 400 * 2 * 3)
    reader = geotiff.GeoTiff({"path": str(tmp_path)}).reader(None)
    kept = list(reader.pushFilters([GreaterThanOrEqual(("row",), 100), LessThan(("row",), 141), EqualTo(("band",), 2), In(("band",), (1, 2)), LessThan(("col",), 7), StringContains(("path",), "a"), EqualTo(("value",), 3.0)]))
    assert [type(f) for f in kept] == [StringContains, EqualTo]
    asked = counting(monkeypatch, geotiff)
    parts = reader.partitions()
    assert [r[1:] for p in parts for r in p.runs] == [(100, 120), (120, 141)]
    asked.clear()
    got = pa.Table.from_batches([b for p in parts for b in reader.read(p)])
    rows, cols = got["row"].to_numpy(), got["col"].to_numpy()
    assert got.num_rows == 41 * 7 and set(got["band"].to_pylist()) == {2}
    assert (got["value"].to_numpy() == image[1, rows, cols]).all()
    strips = [a for a in asked if a[1] > 20_000]
    # Three strips of the second band, each once; the rest are headers.
    assert len(strips) == 3 and len(set(strips)) == 3 and sum(n for _, n in strips) == 3 * 20 * 400 * 8


def test_format_geotiff(spark, tmp_path, image):
    small = image[:, :37, :23].copy()
    small[0, 3, 4] = np.nan
    small[1, 5, 6] = -1
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a b.tif").write_bytes(tiff.write(small, T, nodata=-1.0))
    (tmp_path / "c.TIF").write_bytes(tiff.write(small[:1], T))
    geotiff.register(spark)
    df = spark.read.format("geotiff").load(str(tmp_path))
    assert df.count() == 3 * 37 * 23 and df.where("value IS NULL").select("band", "row", "col").distinct().count() == 2
    some = geotiff.where(spark, str(tmp_path), "row BETWEEN 10 AND 12 AND col IN (4, 9) AND band = 2")
    assert sorted((r["row"], r["col"], r["value"]) for r in some.collect()) == sorted((r, c, small[1, r, c]) for r in (10, 11, 12) for c in (4, 9))
    assert geotiff.where(spark, str(tmp_path), "row > 36 OR col = 0").count() == 3 * 37 and geotiff.where(spark, str(tmp_path), "row > 100").count() == 0
    assert some.where("value > 0").count() == some.count() == 6
    assert spark.read.format("geotiff").load(str(tmp_path / "c.TIF")).agg(F.sum("value")).first()[0] == np.nansum(small[0])
    (tmp_path / "broken.tif").write_bytes(b"II*\0nothing")
    assert spark.read.format("geotiff").option("strict", "false").load(str(tmp_path)).count() == 3 * 37 * 23
    with pytest.raises(Exception, match="."):
        spark.read.format("geotiff").load(str(tmp_path)).count()


def test_windows_unpack_each_strip_once(spark, tmp_path, image, monkeypatch):
    (tmp_path / "a.tif").write_bytes(tiff.write(image[:1], T))
    read = rasters.windows(spark, str(tmp_path), 16).where("error IS NULL")
    starts = {r["row0"] for r in read.select("row0").distinct().collect()}
    # Strips of 20 rows and blocks of 16 begin together every 80 rows.
    assert starts == {b + k for b in (0, 80, 160, 240) for k in range(0, 80, 16) if b + k < 300}
    assert {tuple(r)[2:] for r in rasters.pixels(read).where("row < 3").collect()} == {(r, c, image[0, r, c]) for r in range(3) for c in range(400)}
    cut = rasters.pixels(rasters.windows(spark, str(tmp_path), 16, window=(75, 3, 30, 2)))
    assert sorted((r["row"], r["col"]) for r in cut.collect()) == [(r, c) for r in range(75, 105) for c in (3, 4)]


def test_broken_files_are_rows_with_an_error(spark, tmp_path, image):
    good = tiff.write(image[:, :20, :20], T)
    (tmp_path / "good.tif").write_bytes(good)
    (tmp_path / "short.tif").write_bytes(b"II*\0" + good[4:40])
    (tmp_path / "text.tif").write_text("nothing")
    packed = bytearray(good)
    packed[8:40] = b"\0" * 32
    (tmp_path / "packed.tif").write_bytes(bytes(packed))
    for read in (rasters.blocks(spark, str(tmp_path), 8), rasters.windows(spark, str(tmp_path), 8)):
        wrong = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in read.where("error IS NOT NULL").collect()}
        assert set(wrong) == {"short.tif", "text.tif", "packed.tif"} and all(wrong.values())
        assert rasters.pixels(read).count() == 2 * 20 * 20


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def rows(spark, *pairs):
    return spark.createDataFrame([(n, c.encode()) for n, c in pairs], "name string, content binary")


def test_sink_overwrites_appends_and_numbers(spark, tmp_path):
    spark.dataSource.register(rasters.FileSink)
    to = tmp_path / "out"
    save = lambda df, mode, **options: df.write.format("gridloom_files").options(**options).mode(mode).save(str(to))
    save(rows(spark, ("a.tif", "1"), ("b.tif", "2")).repartition(2), "append")
    assert names(to) == ["a.tif", "b.tif"]
    save(rows(spark, ("b.tif", "3"), ("c.tif", "4")), "append")
    assert names(to) == ["a.tif", "b.tif", "c.tif"] and (to / "b.tif").read_text() == "3"
    for n in (5, 6):
        save(rows(spark, ("b.tif", str(n)), ("d.x.tif", str(n))), "append", existing="number")
    assert names(to) == ["a.tif", "b-1.tif", "b-2.tif", "b.tif", "c.tif", "d-1.x.tif", "d.x.tif"]
    assert [(to / f"b{k}.tif").read_text() for k in ("", "-1", "-2")] == ["3", "5", "6"]
    save(rows(spark, ("z.tif", "7")), "overwrite")
    assert names(to) == ["z.tif"]
    save(rows(spark).limit(0), "overwrite")
    assert names(to) == []
    with pytest.raises(Exception, match="replaced or numbered"):
        save(rows(spark, ("a", "1")), "append", existing="what")


def test_sink_leaves_nothing_of_a_job_that_fails(spark, tmp_path):
    spark.dataSource.register(rasters.FileSink)
    to = tmp_path / "out"
    rows(spark, ("a.tif", "1")).write.format("gridloom_files").mode("append").save(str(to))
    bad = rows(spark, ("b.tif", "2"), ("c.tif", "3")).repartition(2, "name").withColumn("content", F.when(F.col("name") == "c.tif", F.raise_error("stop").cast("binary")).otherwise(F.col("content")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="stop"):
            bad.write.format("gridloom_files").mode(mode).save(str(to))
        assert names(to) == ["a.tif"] and (to / "a.tif").read_text() == "1"


def test_layers_are_appended(spark, tmp_path):
    from gridloom.sources import vectors

    spark.dataSource.register(rasters.FileSink)
    made = lambda ids: vectors.packed(spark.createDataFrame([("f", "L", i, [[(float(i), 0.0), (i + 1.0, 0.0), (float(i), 1.0)]]) for i in ids], "file string, layer string, id int, rings array<array<struct<x:double,y:double>>>"), "file", "layer")
    for ids in (range(5), range(5, 9), range(9, 11)):
        made(ids).write.format("gridloom_files").option("existing", "number").mode("append").save(str(tmp_path / "g"))
    assert names(tmp_path / "g") == ["f-1.gpkg", "f-2.gpkg", "f.gpkg"]
    assert sorted(int(r["attributes"]["id"]) for r in vectors.gpkg(spark, str(tmp_path), "L").collect()) == list(range(11))


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from gridloom.sources import tables

    texts = {"a.csv": "".join(f"{i}.5\n" for i in range(2_000)), "b.csv": "7\r\n\r\n8\r\n\r\n \r\n", "c.csv": "", "d.csv": "\n\n", "e.csv": "1\n2", "f.txt": "no"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = [("a", i, i + 0.5) for i in range(2_000)] + [("b", 0, 7.0), ("b", 1, None), ("b", 2, 8.0), ("e", 0, 1.0), ("e", 1, 2.0)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        found = tables.losses(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path / "a.csv")).select("_metadata.file_block_start").distinct().count() > 10
        assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_small_files_are_read_by_tasks_alone(tmp_path, image, monkeypatch):
    for k in range(7):
        (tmp_path / f"{k}.tif").write_bytes(tiff.write(image[:, : 5 + k, :9].copy(), T))
    monkeypatch.setattr(geotiff, "FILES", 3)
    reader = geotiff.GeoTiff({"path": str(tmp_path)}).reader(None)
    list(reader.pushFilters([GreaterThanOrEqual(("row",), 9), EqualTo(("band",), 2), LessThan(("col",), 4)]))
    asked = counting(monkeypatch, geotiff)
    parts = reader.partitions()
    assert not asked and [len(p.names) for p in parts] == [3, 3, 1]
    batches = [list(reader.read(p)) for p in parts]
    # One fetch a file, and one batch for all files of a task.
    assert len(asked) == 7 and [len(b) for b in batches] == [0, 1, 1]
    got = pa.Table.from_batches([b for own in batches for b in own])
    assert got.num_rows == (1 + 2) * 4 and (got["value"].to_numpy() == image[1, got["row"].to_numpy(), got["col"].to_numpy()]).all()
    monkeypatch.setattr(geotiff, "TASKS", 1)
    assert [len(p.names) for p in reader.partitions()] == [7]
