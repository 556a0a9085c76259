"""Connected components of a large sparse graph by alternating large-star and small-star rounds.

Each round is two aggregates and two joins over the edges, all of which combine map-side or split under AQE, so
neither a hub nor a long chain meets in one task.  Rounds end when the edges are stars; every round is written to the
shared folder and the one before it deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a, b.  Returns (node, root) for each node with an edge to a smaller one: root is
    the smallest node of its component.  Self-loops and repeated edges are ignored."""
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        then = materialize(small, "edges")
        told = then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(now)
        now = then
        if told == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = told
