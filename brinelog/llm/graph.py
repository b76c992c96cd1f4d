"""Connected components on Spark, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its smallest node. No edges give no rows.

    Alternating large and small stars: every round links each node's larger neighbours, then its smaller ones, to the
    least node it knows, until nothing changes; rounds grow with the logarithm of a component's size. Each round is written.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
        now = stored(small, "edges")
        new = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = new
