"""Jobs from the command line."""

from gridloom.plans import fixtures, jobs


def test_jobs(spark, sf_dir, tmp_path):
    fixtures.pixels(spark, sf_dir).write.parquet(str(tmp_path / "px"))
    fixtures.existing_boxes(spark, sf_dir).write.parquet(str(tmp_path / "boxes"))
    fixtures.buildings(spark, sf_dir).write.parquet(str(tmp_path / "buildings"))
    shape = ["--height", str(fixtures.height(spark, sf_dir)), "--width", "100", "--size", "3"]
    calls = {
        "test-tiles": ["test-tiles", "1000", "5", "--pixels", str(tmp_path / "px"), "--existing", str(tmp_path / "boxes"), *shape],
        "training-tiles": ["training-tiles", "7", "40", "--held-out", "8", "--pixels", str(tmp_path / "px"), *shape],
        "taylor": ["taylor", "--buildings", str(tmp_path / "buildings"), "--sizes", "100,250"],
    }
    rows = {}
    for name, call in calls.items():
        for _ in range(2):
            jobs.run(spark, jobs.arguments([*call, "--out", str(tmp_path / name)]))
        rows[name] = spark.read.parquet(str(tmp_path / name)).count()
    assert rows == {"test-tiles": 5, "training-tiles": 40, "taylor": 3}
