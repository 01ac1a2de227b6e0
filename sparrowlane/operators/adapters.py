"""Adapters that move vectors: forward passes over Arrow batches with weights of a model, targets and fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V


def rule_matrix(rows: int, columns: int, seed: int) -> np.ndarray:
    """Small weights by a rule, the same in SQL: ((31 i + 17 j + seed) mod 23 - 11) / 40."""
    i, j = np.indices((rows, columns))
    return ((31 * i + 17 * j + seed) % 23 - 11) / 40.0


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def projection(weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: x @ weights.T


def mlp(w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """normalize(x + W2 relu(W1 x + b1) + b2)"""
    return lambda x: _unit(x + np.maximum(x @ w1.T + b1, 0) @ w2.T + b2)


def low_rank(u: np.ndarray, v: np.ndarray, bias: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """normalize(x + (x U) V' + b)"""
    return lambda x: _unit(x + (x @ u) @ v.T + bias)


def orthogonal(p: np.ndarray, scale: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Cayley: W = (I + A)^-1 (I - A) of the skew part A = P - P', then a scale per dimension and unit length."""
    a, one = p - p.T, np.eye(len(p))
    w = np.linalg.solve(one + a, one - a)
    return lambda x: _unit((x @ w.T) * scale)


KINDS = {"projection": projection, "mlp": mlp, "low_rank": low_rank, "orthogonal": orthogonal}


def create(kind: str, *weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The forward pass of an adapter kind."""
    if kind not in KINDS:
        raise ValueError(f"unknown adapter: {kind}")
    return KINDS[kind](*weights)


def applied(df: DataFrame, forward: Callable[[np.ndarray], np.ndarray], vec_col: str, out: str, *keep: str) -> DataFrame:
    """``keep`` and ``out``: the forward pass of each vector, a batch at a time."""
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = forward(batch.column(vec_col).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                bounds = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(bounds, pa.array(y.ravel()))], [*keep, out])

    return df.select(*dict.fromkeys((*keep, vec_col))).mapInArrow(run, f"{fields}, {out} array<double>")


def bounded(x: Column, y: Column, low: float = 0.01, high: float = 0.5) -> Column:
    """x plus the correction y - x with its norm forced into [low, high]; corrections of about zero stay."""
    factor = lambda n: F.when((n < low) & (n > 1e-10), low / n).when(n > high, high / n).otherwise(1.0)
    return V.let(factor(V.norm(V.subtract(y, x))), lambda f: F.zip_with(x, y, lambda a, b: a + (b - a) * f))


def homeostatic_target(v: Column, noise: Column, push: float = 0.1) -> Column:
    """v pushed away from the mean noise and made a unit; zero vectors fall back to v's unit, or the first axis."""
    first = F.transform(v, lambda _, i: F.when(i == 0, 1.0).otherwise(0.0))
    still = F.when(V.norm(v) < 1e-10, first).otherwise(V.unit(v))
    moved = lambda d: V.let(F.zip_with(v, noise, lambda x, y: x + (x - y) / d * push), lambda t: F.when(V.norm(t) < 1e-10, still).otherwise(V.unit(t)))
    return V.let(V.norm(V.subtract(v, noise)), lambda d: F.when(d < 1e-10, still).otherwise(moved(d)))


def blend(student: Column, teacher: Column, share: float) -> Column:
    """normalize((1 - share) student + share teacher); the student as it is for share 0 or other sizes."""
    if not share:
        return student
    mixed = F.zip_with(student, teacher, lambda s, t: (1 - share) * s + share * t)
    return F.when(F.size(student) != F.size(teacher), student).otherwise(V.unit(mixed, 1e-9))


def fit_standardised(rows: DataFrame, features: list[str], target: str, rate: float = 0.08, epochs: int = 300, l2: float = 0.01, most_rows: int = 100_000) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights of standardised features, bias, and the means and deviations: class-balanced, L2, plain gradient steps.

    The rows are aggregates, one for each combination of a few keys; more than ``most_rows`` are refused.
    """
    if rows.count() > most_rows:
        raise ValueError("aggregate the rows first")
    data = np.array([tuple(r) for r in rows.select(*features, target).collect()], float).reshape(-1, len(features) + 1)
    x, y = data[:, :-1], data[:, -1]
    if not len(x):
        return np.zeros(len(features)), 0.0, np.zeros(len(features)), np.ones(len(features))
    centre, scale = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    x = (x - centre) / scale
    share = np.where(y > 0, len(y) / max(1.0, 2 * y.sum()), len(y) / max(1.0, 2 * (1 - y).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        error = share * (1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y)
        w -= rate * (x.T @ error / len(y) + l2 * w)
        b -= rate * error.mean()
    return w, float(b), centre, scale


def fit_logistic(rows: DataFrame, features: list[str], target: str, **options) -> tuple[np.ndarray, float]:
    """The weights and bias of :func:`fit_standardised`."""
    return fit_standardised(rows, features, target, **options)[:2]
