"""Jobs for spark-submit: ``jobs.py NAME ...``; each reads Parquet, runs one pipeline and writes Parquet.

    jobs.py test-tiles SEED COUNT --pixels P --existing E --height H --width W --out O
    jobs.py training-tiles SEED COUNT --held-out K --pixels P --height H --width W --out O
    jobs.py taylor --buildings B --sizes 50,100,200 --out O
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from gridloom.plans import pipelines
from gridloom.session import ship
from gridloom.sources import tables


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    """Parsed command line."""
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = top.add_subparsers(dest="job", required=True)
    for name in ("test-tiles", "training-tiles"):
        job = jobs.add_parser(name)
        job.add_argument("seed", type=int)
        job.add_argument("count", type=int)
        for option in ("--pixels", "--out"):
            job.add_argument(option, required=True)
        for option in ("--height", "--width"):
            job.add_argument(option, type=int, required=True)
        job.add_argument("--size", type=int, default=256)
        if name == "test-tiles":
            job.add_argument("--existing", required=True)
        else:
            job.add_argument("--held-out", type=int, default=0)
    taylor = jobs.add_parser("taylor")
    taylor.add_argument("--buildings", required=True)
    taylor.add_argument("--sizes", default=",".join(map(str, [50, *range(100, 30_000, 100)])))
    taylor.add_argument("--out", required=True)
    return top.parse_args(argv)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    """Run one job; what is there already is kept, so a rerun after success does nothing."""
    ship(spark)
    if a.job == "taylor":
        make = lambda: pipelines.taylor(spark.read.parquet(a.buildings), [float(s) for s in a.sizes.split(",")])
    elif a.job == "test-tiles":
        make = lambda: pipelines.test_tiles(spark.read.parquet(a.pixels), spark.read.parquet(a.existing), a.size, a.count, a.height, a.width, a.seed)
    else:
        make = lambda: pipelines.training_tiles(spark.read.parquet(a.pixels), a.height, a.width, a.size, a.count, a.held_out, a.seed)
    tables.cached(spark, a.out, make)


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), arguments())
