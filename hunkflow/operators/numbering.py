"""Consecutive numbers over a whole table, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.tables import stored


def numbered(rows: DataFrame, order: list[str], name: str = "number", start: int = 0) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of the columns ``order``, which
    should tell rows apart. Rows are cut into ranges and written; a number is
    the place in its range plus the rows of the ranges before it, one small row
    per range."""
    part = "_range"
    cut = stored(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = cut.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select(part, (F.sum("_n").over(W.orderBy(part)) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy(part).orderBy(*order)) - 1 + start
    return cut.withColumn("_place", place).join(F.broadcast(before), part).withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop(part, "_place", "_before")
