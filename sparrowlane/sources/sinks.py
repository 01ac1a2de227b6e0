"""Sinks: append-only JSON lines, CSV with one header per file, JSON artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import log_snippet


def log_lines(events: DataFrame, path: str, started: str = "ts", *texts: str) -> None:
    """Append events as JSON lines, text columns sanitised, with the seconds since the first event of the batch."""
    first = F.broadcast(events.agg(F.min(started).alias("__first")))
    seconds = (F.unix_micros(F.col(started).cast("timestamp")) - F.unix_micros(F.col("__first").cast("timestamp"))) / 1e6
    rows = events.crossJoin(first).withColumn("elapsed_seconds", seconds).drop("__first")
    for c in texts:
        rows = rows.withColumn(c, log_snippet(F.col(c)))
    rows.write.mode("append").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Append rows; every file has its header, so a reader with ``header`` sees it never as data."""
    rows.write.mode("append").option("header", True).csv(path)


def write_artifact(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", False).json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """``json``: each row as one JSON text, for read APIs."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
