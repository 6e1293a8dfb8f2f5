"""GeoPackages read where they lie: pieces, R-trees, pages, and files that have none of them."""

import random
import sqlite3
from contextlib import closing

import pytest

from gridloom.sources import vectors

BOX = (10.25, 20.25, 14.5, 23.0)


def squares(n, side=100):
    return [{"name": f"s{i}", "rings": [[(x, y), (x + 0.5, y), (x + 0.5, y + 0.5), (x, y + 0.5), (x, y)]]} for i in range(n) for x, y in [(float(i % side), float(i // side))]]


def met(n, side=100):
    return sorted(f"s{i}" for i in range(n) if i % side <= BOX[2] and i % side + 0.5 >= BOX[0] and i // side <= BOX[3] and i // side + 0.5 >= BOX[1])


def names(rows):
    return sorted(dict(r["attributes"])["name"] for r in rows)


@pytest.fixture(scope="module")
def content():
    shuffled = squares(5000)
    random.Random(0).shuffle(shuffled)
    return vectors.write_layers({"a": shuffled, "b b": squares(30), "none": [], "empty": [{"name": "e", "rings": []}]})


def changed(content, path, *statements):
    with closing(sqlite3.connect(":memory:")) as db:
        db.deserialize(content)
        db.executescript(";".join(statements))
        path.write_bytes(db.serialize())


def test_pieces_hold_every_feature_once(spark, content, tmp_path):
    (tmp_path / "x y#1.gpkg").write_bytes(content)
    for most in (1, 7, 5000):
        whole = vectors.gpkg(spark, str(tmp_path), "a" if most > 1 else "b b", most=most)
        assert names(whole.collect()) == sorted(r["name"] for r in squares(5000 if most > 1 else 30))
    assert vectors.gpkg(spark, str(tmp_path)).count() == 5031
    assert names(vectors.gpkg(spark, str(tmp_path), "a", BOX, most=3).collect()) == met(5000)
    assert vectors.gpkg(spark, str(tmp_path), box=(500, 500, 501, 501)).count() == 0
    assert sorted(r["layer"] for r in vectors.layers(spark, str(tmp_path)).collect()) == ["a", "b b", "empty", "none"]


def test_pieces_follow_the_tree(content, tmp_path):
    (tmp_path / "x.gpkg").write_bytes(content)
    with closing(vectors._database(str(tmp_path / "x.gpkg"))) as db:
        pieces = list(vectors._gpkg_pieces(db, "a", BOX, 6))
        assert len(pieces) == -(-len(met(5000)) // 6)
        got = [r for _, first, last in pieces for r in vectors._gpkg_rows(db, "", "a", BOX, None, first, last)]
        assert names(got) == met(5000)
        assert len(list(vectors._gpkg_pieces(db, "a", None, 1000))) == 5 and not list(vectors._gpkg_pieces(db, "none", None, 1000))


def test_pages_that_are_read(tmp_path):
    """Bytes that the process asks the system for."""
    path = tmp_path / "x.gpkg"
    path.write_bytes(vectors.write_gpkg(squares(40_000, 200), "a"))

    def taken(box):
        start = int(open("/proc/self/io").readline().split()[1])
        with closing(vectors._database(str(path))) as db:
            rows = [r for piece in vectors._gpkg_pieces(db, "a", box, 1000) for r in vectors._gpkg_rows(db, "", piece[0], box, None, *piece[1:])]
        return len(rows), int(open("/proc/self/io").readline().split()[1]) - start

    whole, size = taken(None), path.stat().st_size
    few = taken(BOX)
    assert whole[0] == 40_000 and few[0] == len(met(40_000, 200))
    assert few[1] < size / 20 < whole[1]


@pytest.mark.parametrize(
    "change",
    [
        ["DROP TABLE gpkg_extensions"],
        ["DROP TABLE rtree_a_geom"],
        ["DELETE FROM gpkg_extensions"],
        ["CREATE TABLE t AS SELECT * FROM a", "DROP TABLE a", "CREATE VIEW a AS SELECT * FROM t"],
        ["CREATE TABLE t AS SELECT * FROM a", "DROP TABLE a", "CREATE TABLE a AS SELECT * FROM t"],
    ],
)
def test_files_without_tree_or_key(spark, content, tmp_path, change):
    changed(content, tmp_path / "x.gpkg", *change)
    assert names(vectors.gpkg(spark, str(tmp_path), "a", BOX, most=700).collect()) == met(5000)
    assert vectors.gpkg(spark, str(tmp_path), "a", most=700).count() == 5000


def test_row_numbers_far_apart(spark, content, tmp_path):
    changed(content, tmp_path / "x.gpkg", "DELETE FROM gpkg_extensions", "DROP TRIGGER rtree_a_geom_update", "UPDATE a SET fid = fid * 1000000000000 - 4000000000000")
    assert names(vectors.gpkg(spark, str(tmp_path), "a", most=2).collect()) == sorted(r["name"] for r in squares(5000))


def test_triggers_keep_the_tree(content, tmp_path):
    with closing(sqlite3.connect(":memory:")) as db:
        db.deserialize(content)
        for k, name in enumerate(("ST_MinX", "ST_MaxX", "ST_MinY", "ST_MaxY")):
            db.create_function(name, 1, lambda blob, k=k: [p[k // 2] for r in vectors.read_wkb(blob, 40)[0] for p in r][0] if blob else None)
        db.create_function("ST_IsEmpty", 1, lambda blob: blob[3] >> 4 & 1)
        count = lambda: db.execute("SELECT count(*) FROM rtree_a_geom").fetchone()[0]
        db.execute("DELETE FROM a WHERE fid <= 10")
        assert count() == 4990
        db.execute("INSERT INTO a SELECT fid + 100000, name, geom FROM a WHERE fid BETWEEN 11 AND 15")
        assert count() == 4995
        db.execute("UPDATE a SET geom = NULL WHERE fid > 100000")
        assert count() == 4990
