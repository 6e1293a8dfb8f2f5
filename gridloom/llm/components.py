"""Connected components of an edge table by alternating star contraction.

Each round replaces every node's larger neighbours' links by links to its smallest
neighbour, then does the same for the smaller ones, until nothing changes: the edges are then
stars around each component's smallest node.  Rounds are written to the shared folder, so
that a lost executor costs one round.  A node with very many links is only ever aggregated
(map-side) or joined, never collected.

Defined cases: loops and repeated edges change nothing; null ends are left out; no edges give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that (a, b) links; component is the smallest node."""
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = materialise(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Ends of ``large`` are already (larger, smaller): small stars need one direction only.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
        e = materialise(small.where(F.col("a") != F.col("b")).distinct(), "edges")
