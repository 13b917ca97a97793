"""Connected components over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialise, scratch


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every node of ``edges`` (a, b: long) with the smallest node
    of its component. Alternates large-star and small-star steps, each a
    minimum per node, formed map-side, and a join of the edges with it, until
    the edges no longer change. The minima are broadcast while they are few;
    beyond that the edges of a node are dealt over many partitions by their
    other end, so no task gathers the neighbours of a hub.

    A loop on a node says nothing; null ends are not allowed; without edges
    between different nodes there are no rows."""
    spark = edges.sparkSession
    with scratch(spark) as keep:
        now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
        state = None
        while True:
            both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
            low = materialise(both.groupBy("u").agg(F.min("v").alias("m")))
            large = join_small(both, low, ["u"], ["v"]).where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()
            large = materialise(large)
            low = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
            small = join_small(large, low, ["a"], ["b"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
            now = materialise(small)
            before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
            if state == before:
                break
        return keep(materialise(now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())))
