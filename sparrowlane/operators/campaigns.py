"""Campaigns over windows of queries: a window is a key, finished windows are kept, and a run goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoints import Checkpoints
from .ordering import numbered


def windows_of(queries: DataFrame, order: str, size: int, offset: int = 0, most: int | None = None, exact: bool = False) -> DataFrame:
    """``queries`` with their window: ``size`` in each by order, from the ``offset``-th on, ``most`` queries at most.

    ``exact`` makes it an error if there are fewer than ``most``.
    """
    placed = numbered(queries, order).where(F.col("at") >= offset)
    if most is not None:
        placed = placed.where(F.col("at") < offset + most)
        if exact and (found := placed.count()) != most:
            raise ValueError(f"asked for {most} queries from {offset} on, found {found}")
    return placed.withColumn("window", F.floor((F.col("at") - offset) / size)).drop("at")


def resumed(windows: DataFrame, evaluate: Callable[[DataFrame], DataFrame], store: Checkpoints, most: int | None = None) -> DataFrame:
    """Results of all windows that are done after this run, of which ``most`` may be new.

    ``evaluate`` gets the queries of all open windows at once and returns rows with their ``window``.  Each run is a
    version of the store, written whole or not at all, so a run that is cut off is repeated and nothing is counted twice.
    """
    spark = windows.sparkSession
    done = store.names()
    results = [store.restore(name) for name in done]
    open_ = windows
    if results:
        seen = results[0].select("window")
        for r in results[1:]:
            seen = seen.unionByName(r.select("window"))
        open_ = windows.join(seen.distinct(), "window", "left_anti")
    numbers = open_.select("window").distinct()
    if most is not None:
        numbers = numbers.orderBy("window").limit(most)  # the windows of this run
    if not numbers.isEmpty():
        name = f"run-{len(done):06d}"
        store.create(evaluate(open_.join(F.broadcast(numbers), "window", "left_semi")), name)
        results.append(store.restore(name))
    out = results[0] if results else spark.createDataFrame([], "window long")
    for r in results[1:]:
        out = out.unionByName(r)
    return out
