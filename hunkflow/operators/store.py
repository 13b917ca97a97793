"""Changes to keyed tables, written as new versions of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with the same keys and are added otherwise."""
    return table.join(rows.select(keys).distinct(), keys, "left_anti").unionByName(rows)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are new are added; the others change nothing."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(keys), keys, "left_anti"))


def update(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(~F.coalesce(condition, F.lit(False)))


def latest(changes: DataFrame, keys: list[str], order: str, op: str = "op", removed: str = "removed") -> DataFrame:
    """The state that a log of changes leads to: the last change of each key,
    without the keys whose last change removes them."""
    others = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_c"))
    return last.select(*keys, "_c.*").where(F.col(op) != removed)
