"""The event log: reading lines, filters, listings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import numbered


def parsed_lines(lines: DataFrame, schema: str, col: str = "value") -> DataFrame:
    """``event`` of each line that is not blank; a malformed line is an error with its text."""
    rows = lines.where(F.trim(col) != "").select(F.col(col), F.from_json(col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("event"))
    good = F.when(F.expr(f"try_parse_json({col})").isNull(), F.raise_error(F.concat(F.lit("malformed event: "), F.substring(col, 1, 80)))).otherwise(F.lit(True))
    return rows.where(good).select("event")


def first_malformed(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """File and line number (from 1) of the first line of a JSONL log that is neither blank nor JSON.

    Lines of a file keep their order in the ids that a scan gives them, so a number is a count of smaller ids.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"))
    bad = lines.where((F.trim("value") != "") & F.expr("try_parse_json(value)").isNull()).agg(F.min(F.struct("id", "file")).alias("b")).first()["b"]
    if bad is None:
        return None
    return bad["file"], lines.where((F.col("file") == bad["file"]) & (F.col("id") <= bad["id"])).count()


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of a log; blank lines are skipped, the first malformed line is an error with its number."""
    found = first_malformed(spark, path)
    if found is not None:
        raise ValueError(f"malformed event in line {found[1]} of {found[0]}")
    return parsed_lines(spark.read.text(path), schema).select("event.*")


def recent(events: DataFrame, limit: int, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """The latest events; a missing time sorts as 0, zero or a negative limit gives none."""
    return events.orderBy(F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0)).desc(), id_col).limit(max(0, limit))


def nearest_place(n: Column, share: float) -> Column:
    """The place (from 1) of the nearest-rank percentile among ``n`` sorted values: round-half-even((n - 1) * share)."""
    return F.rint((n - 1) * F.lit(share)).cast("int") + 1


def summary(events: DataFrame, counts: dict[str, Column], names: dict[str, Column], latency: Column, ts: Column) -> DataFrame:
    """``section, name, value``: totals, histograms, latency mean, p50 and p95 (nearest rank), and the time range in microseconds.

    ``counts`` are conditions to count, ``names`` arrays whose elements are counted by section.  One pass and one shuffle
    of counts; the percentiles are rows of the globally numbered latencies, so no task sorts them all.
    """
    named = lambda k: lambda x: F.struct(F.lit(k).alias("section"), x.alias("name"))
    sections = [F.transform(c, named(k)) for k, c in names.items()]
    flags = F.array(F.struct(F.lit("count").alias("section"), F.lit("total").alias("name")), *(F.struct(F.lit("count").alias("section"), F.when(c, F.lit(k)).alias("name")) for k, c in counts.items()))
    found = events.select(F.inline(F.concat(flags, *sections)))
    found = found.where("name is not null").groupBy("section", "name").agg(F.count("*").cast("double").alias("value"))
    placed = numbered(events.select(latency.alias("l"), ts.alias("ts")).where("l is not null"), "l", "ts")
    n = F.broadcast(placed.agg(F.count("*").alias("n")))
    at = lambda p: F.max(F.when(F.col("at") == nearest_place(F.col("n"), p) - 1, F.col("l")))
    wide = placed.crossJoin(n).agg(F.avg("l").alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.min("ts").cast("double").alias("earliest"), F.max("ts").cast("double").alias("latest"))
    rest = wide.select(F.inline(F.array(*(F.struct(F.lit("latency" if k in ("mean", "p50", "p95") else "time").alias("section"), F.lit(k).alias("name"), F.col(k).alias("value")) for k in ("mean", "p50", "p95", "earliest", "latest")))))
    return found.unionByName(rest)


def histogram(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``keys, value, n``."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
