"""Windows and ordered folds over series that have a key and an order.

A fold passes over a key's rows in order and holds its state alone, however long the series is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window, WindowSpec

from ..session import workers_can_import


def last_rows(n: int, key: str = "key", seq: str = "seq") -> WindowSpec:
    """The current row and the ``n - 1`` before it."""
    return Window.partitionBy(key).orderBy(seq).rowsBetween(-(n - 1), 0)


def adaptive_threshold(value: Column, window: WindowSpec, percentile: float = 0.75, least: int = 20, bounds: tuple[float, float] = (1e-4, 1e-2)) -> Column:
    """The clamped percentile of the window, null until it has ``least`` values."""
    clamped = F.least(F.greatest(F.percentile(value, F.lit(percentile)).over(window), F.lit(bounds[0])), F.lit(bounds[1]))
    return F.when(F.count(value).over(window) >= least, clamped)


def folded(df: DataFrame, start: Callable[[], object], step: Callable[[object, float | None], object], result: Callable[[object], tuple], schema: str, value: str, key: str = "key", seq: str = "seq") -> DataFrame:
    """``key`` and the columns of ``schema``: ``result`` of the state after ``step`` took the key's values in order.

    Rows are sorted within tasks and the state is carried over batches; no key's series is ever held.
    """
    workers_can_import(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    out = pa.schema([pa.field(f.name, {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64()}[f.dataType.simpleString()]) for f in StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, begun = None, None, False
        for batch in batches:
            keys, done = batch.column("key").to_pylist(), []
            for k, v in zip(keys, batch.column("value").to_pylist(), strict=True):
                if not begun or k != held:
                    if begun:
                        done.append((held, *result(state)))
                    held, state, begun = k, start(), True
                state = step(state, v)
            if done:
                yield rows_of(done, batch.schema.field("key").type)
            kept = batch.schema.field("key").type
        if begun:
            yield rows_of([(held, *result(state))], kept)

    def rows_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, f.type) for c, f in zip(columns[1:], out, strict=True))], ["key", *out.names])

    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), F.col(seq).alias("seq"))
    rows = rows.repartition("key").sortWithinPartitions("key", "seq").select("key", "value")
    return rows.mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def dead_band(df: DataFrame, value: str, start: float, band: float = 1e-6, key: str = "key", seq: str = "seq") -> DataFrame:
    """``key, threshold``: the last value of a fold that moves only by more than ``band``; nulls are passed over."""
    step = lambda s, x: s if x is None or abs(x - s) <= band else x
    return folded(df, lambda: start, step, lambda s: (s,), "threshold double", value, key, seq)


def margins(df: DataFrame, gap: str, base: float = 0.3, low: float = 0.05, high: float = 1.0, rate: float = 0.1, key: str = "key", seq: str = "seq") -> DataFrame:
    """``key, margin``: moving average towards base / (1 + gap), or ``high`` for gaps that are not positive, clamped at each step."""

    def step(s: float, g: float | None) -> float:
        return min(max((1 - rate) * s + rate * (base / (1 + g) if g is not None and g > 0 else high), low), high)

    return folded(df, lambda: base, step, lambda s: (s,), "margin double", gap, key, seq)


def kalman_rate(loss: Column, window: WindowSpec, base: float = 0.001, noise: float = 0.01, bounds: tuple[float, float] = (1e-6, 0.1)) -> Column:
    """base * Q / (Q + var), clamped; the first step keeps the base."""
    rate = base * (noise / (noise + F.var_pop(loss).over(window) + 1e-10))
    return F.when(F.count(loss).over(window) < 2, F.lit(base)).otherwise(F.least(F.greatest(rate, F.lit(bounds[0])), F.lit(bounds[1])))


def early_stops(df: DataFrame, loss: str, patience: int = 5, relative: float = 0.01, least: int = 3, key: str = "key", seq: str = "seq") -> DataFrame:
    """``key, epochs, stopped_at``: the first epoch (from 1, finite losses only) that stops training, or null."""

    def step(s: tuple, x: float | None) -> tuple:
        epochs, epoch, best, without, stop = s
        epochs += 1
        if x is None or not math.isfinite(x):
            return epochs, epoch, best, without, stop
        epoch += 1
        if epoch == 1 or (x < best and (best - x) / (abs(best) + 1e-12) >= relative):
            best, without = x, 0
        else:
            without += 1
        if stop is None and epoch >= least and without >= patience:
            stop = epoch
        return epochs, epoch, best, without, stop

    return folded(df, lambda: (0, 0, math.inf, 0, None), step, lambda s: (s[0], s[4]), "epochs int, stopped_at int", loss, key, seq)


def adaptive_weights(df: DataFrame, loss: str, initial: float = 0.5, patience: int = 5, up: float = 1.1, down: float = 0.9, least: float = 0.01, key: str = "key", seq: str = "seq") -> DataFrame:
    """``key, weight``: a teacher's weight after a series of losses.

    Each new best loss multiplies the weight by ``down``, each run of ``patience`` losses without one by ``up``; it never
    falls under ``least``, and a missing loss changes nothing else.
    """

    def step(s: tuple, x: float | None) -> tuple:
        weight, best, without = s
        if x is not None and x < best:
            weight, best, without = weight * down, x, 0
        elif x is not None:
            without += 1
            if without >= patience:
                weight, without = weight * up, 0
        return max(weight, least), best, without

    return folded(df, lambda: (initial, math.inf, 0), step, lambda s: (s[0],), "weight double", loss, key, seq)


def schedule(step: Column, kind: str, initial: float = 1.0, final: float = 0.1, total: int = 100, warmup: int = 0, every: int = 20, gamma: float = 0.5, least: float = 0.01) -> Column:
    """Weight at a step (from 1): constant, linear_decay, cosine_annealing or step_decay, after a linear warm-up."""
    effective = step - warmup
    progress = F.least(effective / max(total - warmup, 1), F.lit(1.0))
    forms = {
        "constant": F.lit(initial),
        "linear_decay": initial + (final - initial) * progress,
        "cosine_annealing": final + 0.5 * (initial - final) * (1 + F.cos(F.pi() * progress)),
        "step_decay": initial * F.pow(F.lit(gamma), F.floor(effective / max(every, 1))),
    }
    late = F.greatest(forms[kind], F.lit(least))
    return F.when(step <= warmup, initial * (step / warmup)).otherwise(late) if warmup else late
