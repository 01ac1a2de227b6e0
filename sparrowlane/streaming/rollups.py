"""Windows over the event log that run on batches and on streams, and stateful operators of streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """``ts`` as a timestamp (tables hold it without zone), with a watermark on streams."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if events.isStreaming else out


def tumbling(events: DataFrame, length: str, delay: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of each window."""
    rows = timed(events, delay).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def adaptive_thresholds(events: DataFrame, key: str = "user_id", value: str = "value", width: int = 100, least: int = 20, percentile: float = 75.0, start: float = 0.0004, bounds: tuple[float, float] = (1e-4, 1e-2)) -> DataFrame:
    """``key, n, threshold`` after each micro-batch: the state of a key is its last ``width`` values and its threshold."""
    import numpy as np

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        values, threshold, n = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], start, 0)
        for pdf in batches:
            for v in pdf.sort_values(["ts", "event_id"])[value]:
                values = [*values, float(v)][-width:]
                n += 1
                if len(values) >= least:
                    new = min(max(float(np.percentile(values, percentile)), bounds[0]), bounds[1])
                    threshold = new if abs(new - threshold) > 1e-6 else threshold
        state.update((values, threshold, n))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "threshold": [threshold]})

    grouped = events.select(key, value, "ts", "event_id").groupBy(key)
    return grouped.applyInPandasWithState(step, "key long, n long, threshold double", "values array<double>, threshold double, n long", "update", "NoTimeout")


def upsert_batches(stream: DataFrame, merge, checkpoint: str, path: str, mode: str = "append"):
    """Start a stream that hands each micro-batch with its number to ``merge`` and appends the result to ``path``.

    A batch that is tried again writes the same folder again, so no row is stored twice.
    """

    def write(df: DataFrame, number: int) -> None:
        merge(df, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_ids(stream: DataFrame, checkpoint: str, path: str, start: int = 0):
    """Start an ingest that numbers the rows of micro-batches on from ``start``; a batch that is tried again gets the same ids."""
    from ..operators.ordering import numbered

    def place(df: DataFrame, number: int) -> DataFrame:
        spark = df.sparkSession
        before = 0
        if number:
            before = spark.read.schema(df.schema).option("basePath", path).parquet(*(f"{path}/batch={k}" for k in range(number))).count()
        return numbered(df, "ts", "event_id").withColumn("point_id", F.col("at") + start + before).drop("at")

    return upsert_batches(stream, place, checkpoint, path)


def bounded_log(events: DataFrame, key: str, key_type: str, most: int, clear_at: int | None = None) -> DataFrame:
    """``key, total, kept, oldest, mean, left`` after each micro-batch: a key's state is its newest ``most`` entries.

    Newest by time and id, whatever the order of arrival.  A key that has had ``clear_at`` entries has gone through a
    training cycle: nothing is left in its log.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, total = (list(zip(*state.get[:3], strict=True)), state.get[3]) if state.exists else ([], 0)
        for pdf in batches:
            total += len(pdf)
            held = sorted([*held, *zip(pdf["us"].tolist(), pdf["event_id"].tolist(), pdf["value"].tolist(), strict=True)])[-most:]
        kept = len(held)
        out = pd.DataFrame({"key": [k[0]], "total": [total], "kept": [kept], "oldest": [min(e[1] for e in held)], "mean": [sum(e[2] for e in held) / kept], "left": [0 if clear_at is not None and total >= clear_at else kept]})
        if clear_at is not None and total >= clear_at:
            held = []
        state.update((*([list(c) for c in zip(*held, strict=True)] if held else [[], [], []]), total))
        yield out

    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.col("value").cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {key_type}, total long, kept long, oldest long, mean double, left long", "us array<long>, ids array<long>, amounts array<double>, total long", "update", "NoTimeout")


def text_cache(rows: DataFrame, most: int) -> DataFrame:
    """``bucket, requests, hits, evictions, held``: caches of at most ``most`` texts, one for each bucket of texts.

    A cache that is full lets go of its older half before it takes another text.  ``rows`` has bucket, at (the order within
    a bucket) and hash.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, requests, hits, evictions = (dict.fromkeys(state.get[0]), *state.get[1:]) if state.exists else ({}, 0, 0, 0)
        whole = pd.concat(list(batches)).sort_values("at")
        for h in whole["hash"].tolist():
            requests += 1
            if h in held:
                hits += 1
                continue
            if len(held) >= most:
                for old in list(held)[: most // 2]:
                    del held[old]
                evictions += 1
            held[h] = None
        state.update((list(held), requests, hits, evictions))
        yield pd.DataFrame({"bucket": [k[0]], "requests": [requests], "hits": [hits], "evictions": [evictions], "held": [len(held)]})

    return rows.groupBy("bucket").applyInPandasWithState(step, "bucket int, requests long, hits long, evictions long, held long", "texts array<long>, requests long, hits long, evictions long", "update", "NoTimeout")


def tail(stream: DataFrame, length: str, checkpoint: str, path: str):
    """Start a stream that keeps the rows of the last ``length`` before the latest of all; each batch's table replaces the one before."""

    def keep(df: DataFrame, number: int) -> DataFrame:
        spark = df.sparkSession
        both = df.unionByName(spark.read.schema(df.schema).parquet(f"{path}/batch={number - 1}")) if number else df
        last = F.broadcast(both.agg(F.max("ts").alias("__last")))
        return both.crossJoin(last).where(F.col("ts") >= F.col("__last") - F.expr(f"INTERVAL {length}")).drop("__last")

    return upsert_batches(stream, keep, checkpoint, path)


def latest(spark, path: str, key: str) -> DataFrame:
    """The last row that a stream of :func:`upsert_batches` has written for each key."""
    rows = spark.read.option("basePath", path).parquet(path)
    newest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [key, "batch"]).drop("batch")
