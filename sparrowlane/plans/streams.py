"""Queries that run streams over the tables, one pass over what is there, and give what their SQL gives in batch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import training as L
from ..registry import query
from ..session import new_path, written
from ..streaming import rollups
from . import base as B
from .base import r6, sql
from .base import r6_sql as R
from .learning import RANK, online_candidates


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The table as a stream of files, whether it is a folder or one file."""
    path = f"{d}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _finished(started) -> None:
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()


@query("STREAM-1", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1 + 1000)::BIGINT AS point_id FROM events")
def running_ids(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches of events are numbered on from 1000."""
    path = new_path(spark, "ingest")
    _finished(rollups.running_ids(_stream(spark, d, "events"), new_path(spark, "state"), path, 1000))
    return spark.read.parquet(path).select("event_id", "point_id")


@query("STREAM-2", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS total FROM events) SELECT user_id, any_value(total) AS total, count(*) AS kept, min(event_id) AS oldest, CASE WHEN any_value(total) >= 50 THEN 0 ELSE count(*) END AS \"left\" FROM n WHERE r <= 1000 GROUP BY user_id")
def capped_log(spark: SparkSession, d: str) -> DataFrame:
    """The newest thousand entries of each user as keyed state; fifty make a training cycle, which clears the log."""
    path = new_path(spark, "log")
    _finished(rollups.upsert_batches(rollups.bounded_log(_stream(spark, d, "events"), "user_id", "long", 1000, 50), lambda df, _: df, new_path(spark, "state"), path, "update"))
    return rollups.latest(spark, path, "key").select(F.col("key").alias("user_id"), "total", "kept", "oldest", "left")


@query("STREAM-5", f"SELECT event_type, count(*) AS n, {R('avg(value)')} AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 256 GROUP BY event_type")
def bounded_history(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "history")
    _finished(rollups.upsert_batches(rollups.bounded_log(_stream(spark, d, "events"), "event_type", "string", 256), lambda df, _: df, new_path(spark, "state"), path, "update"))
    return rollups.latest(spark, path, "key").select(F.col("key").alias("event_type"), F.col("kept").alias("n"), r6("mean").alias("mean"))


@query("STREAM-6", sql(B.TO_SCOUT, "SELECT query_id, vec_id, CASE WHEN rank - 1 < 25 THEN 'positive' ELSE 'negative' END AS side FROM scout"))
def online_halves(spark: SparkSession, d: str) -> DataFrame:
    """The halves of each scout list of four or more, the better one positive."""
    hits = B.scout(spark, d)
    n = hits.groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 4")
    return hits.join(n, "query_id").select("query_id", "vec_id", F.when(F.col("rank") - 1 < F.floor(F.col("n") / 2), "positive").otherwise("negative").alias("side"))


EVERY, MARGIN, ONLINE_RATE = 3, 0.3, 0.1


def online_step(adapter: L.LowRank, q: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[L.LowRank, float]:
    """A gradient step on the triplet margin of the means, similarities taken before normalisation; and the loss before it."""
    m = adapter.matrix
    p, n = good.mean(axis=0), bad.mean(axis=0)
    loss = max(0.0, MARGIN - float((q @ m) @ (p @ m)) + float((q @ m) @ (n @ m)))
    if loss == 0.0:
        return adapter, loss
    difference = n - p
    g = np.outer(q, difference @ m) + np.outer(difference, q @ m)  # of q M M' (n - p)
    return L.LowRank(adapter.u - ONLINE_RATE * g @ adapter.v, adapter.v - ONLINE_RATE * g.T @ adapter.u), loss


@query("STREAM-6-UPDATES")
def online_updates(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: gradient steps.  Every third query of a stream of scout lists updates the adapter; the test repeats them in numpy.

    A step needs one query's list; the lists of a micro-batch come to the driver one after another.
    """
    rows = online_candidates(B.scout(spark, d))
    lists = rows.groupBy("query_id").agg(F.any_value("q").alias("q"), *(F.collect_list(F.when(F.col("positive") == on, F.col("v"))).alias(k) for k, on in (("good", True), ("bad", False))))
    lists = written(lists, "lists")
    folder = lists.inputFiles()[0].rpartition("/")[0]
    stream = spark.readStream.schema(lists.schema).parquet(folder)
    dim = rows.select(F.size("v")).first()[0]
    state = {"adapter": L.LowRank.seeded(dim, RANK), "seen": 0, "out": []}

    def update(df: DataFrame, number: int) -> None:
        for row in df.orderBy("query_id").toLocalIterator():
            if state["seen"] % EVERY == 0:
                state["adapter"], loss = online_step(state["adapter"], np.array(row["q"]), np.array(row["good"]), np.array(row["bad"]))
                state["out"].append((row["query_id"], len(state["out"]), round(loss, 9), round(float(np.linalg.norm(state["adapter"].matrix - np.eye(dim))), 9)))
            state["seen"] += 1

    _finished(stream.writeStream.foreachBatch(update).option("checkpointLocation", new_path(spark, "state")).trigger(availableNow=True).start())
    return spark.createDataFrame(state["out"], "query_id long, update int, loss double, moved double")


@query("STREAM-7", "SELECT count(DISTINCT text) AS texts, count(*) AS requests FROM conversations")
def distinct_requests(spark: SparkSession, d: str) -> DataFrame:
    """What an unbounded cache of detections would hold: the distinct texts of the requests."""
    return B.table(spark, d, "conversations").agg(F.countDistinct("text").alias("texts"), F.count("*").alias("requests"))


BUCKETS, CACHED = 4, 8


@query("STREAM-7-CACHE")
def detection_cache(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: a stateful cache that lets go of its older half when it is full; the test compares with a plain loop."""
    stream = _stream(spark, d, "conversations")
    text = F.coalesce("text", F.lit(""))
    rows = stream.select(F.pmod(F.xxhash64(text), F.lit(BUCKETS)).cast("int").alias("bucket"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("at"), F.xxhash64(text, F.lit(1)).alias("hash"))
    path = new_path(spark, "cache")
    _finished(rollups.upsert_batches(rollups.text_cache(rows, CACHED), lambda df, _: df, new_path(spark, "state"), path, "update"))
    return rollups.latest(spark, path, "bucket")


@query("STREAM-8", "SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def live_tail(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "tail")
    _finished(rollups.tail(_stream(spark, d, "events"), "1 DAY", new_path(spark, "state"), path))
    rows = spark.read.option("basePath", path).parquet(path)
    last = F.broadcast(rows.agg(F.max("batch").alias("batch")))
    return rows.join(last, "batch").select("event_id", "event_type")
