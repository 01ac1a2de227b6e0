"""Vectors as array<double> columns.

A norm that a lambda needs is taken as a column of its own, so that it is computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 when either norm is 0."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def masked(v: Column, mask: Column) -> Column:
    return F.zip_with(v, mask, lambda x, m: x * m)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def valid(v: Column, dim: int) -> Column:
    """Right length, no null and only finite components."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def with_unit(df: DataFrame, col: str, out: str, floor: float = 1e-12) -> DataFrame:
    """Adds ``out``: ``col`` divided by its norm, ``floor`` at least."""
    return df.withColumn("__norm", F.greatest(norm(F.col(col)), F.lit(floor))).withColumn(out, F.transform(F.col(col), lambda x: x / F.col("__norm"))).drop("__norm")


def exploded(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """One row per component: ``keep``, pos (from 0), x."""
    return df.select(*keep, F.posexplode(col).alias("pos", "x"))


def assembled(df: DataFrame, value: str, out: str, *keys: str) -> DataFrame:
    """Components back to arrays: ``keys`` and ``out``."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("__rows"))
    return rows.select(*keys, F.transform("__rows", lambda r: r[value]).alias(out))


def mean_vector(df: DataFrame, col: str, out: str, *keys: str) -> DataFrame:
    """Component-wise mean by keys; components are averaged before any array is built."""
    return assembled(exploded(df, col, *keys).groupBy(*keys, "pos").agg(F.avg("x").alias("m")), "m", out, *keys)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once for all its uses."""
    return F.element_at(F.transform(F.array(value), then), 1)


def unit(v: Column, floor: float = 1e-12) -> Column:
    """The vector over its norm, ``floor`` at least."""
    return let(F.greatest(norm(v), F.lit(floor)), lambda n: F.transform(v, lambda x: x / n))
