"""Numbers for the rows of a whole table in order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written


def numbered(rows: DataFrame, *order: str | Column, out: str = "at") -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... by ``order``.

    Rows are dealt by range and written with the number of their range, so every reader sees the same ranges; only the
    counts of the ranges, one row each, are summed in one window.  ``order`` should be unique: ties are numbered in any order.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before") - 1
    return ranged.join(F.broadcast(offsets), "__range").withColumn(out, at.cast("long")).drop("__range", "__before")


def consecutive(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """Each row but the first, with ``before_<column>`` of the row before it in the whole table's order."""
    placed = written(numbered(rows, order), "numbered")
    before = placed.select((F.col("at") + 1).alias("at"), *(F.col(c).alias(f"before_{c}") for c in columns))
    return placed.join(before, "at").drop("at")
