"""Connected components over edge tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (node, component), component the smallest node reachable.

    Each round is a few shuffles over the edges; every round's edges are written to the shared checkpoint folder,
    so neither the plan nor what a lost executor costs grows with the rounds. Nodes without an edge don't appear.
    """

    def stars(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now points from the larger node to the smaller
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        return small.where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    now = checkpoint(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct())
    was = mark(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        now = checkpoint(stars(now))
        if (new := mark(now)) == was:
            break
        was = new
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
