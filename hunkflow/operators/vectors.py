"""Arithmetic on float arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def quantise(v: Column) -> tuple[Column, Column]:
    """8-bit codes and the scale that turns them back."""
    scale = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127
    return F.transform(v, lambda x: F.when(scale > 0, F.round(x / scale)).otherwise(0).cast("byte")), scale
