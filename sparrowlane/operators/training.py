"""Training of adapters on whole tables.

The squared error of a linear residual adapter y = x M, M = I + U V', depends on the rows through three moments alone:
X'X, X'T and the sum of squares of T.  They are summed in one pass over the rows; all epochs of gradient descent then work
on matrices of the vectors' dimension, exactly as if each epoch had read every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..session import workers_can_import
from .adapters import applied
from .blocks import matrix_of


@dataclass
class Moments:
    """X'X, X'T, sum of squares of T and number of rows."""

    xx: np.ndarray
    xt: np.ndarray
    tt: float
    n: int

    def loss(self, m: np.ndarray) -> float:
        """Mean squared error of x M against t, over rows and dimensions."""
        return float((np.sum(m * (self.xx @ m)) - 2 * np.sum(m * self.xt) + self.tt) / max(1, self.n * len(m)))

    def gradient(self, m: np.ndarray) -> np.ndarray:
        return 2 * (self.xx @ m - self.xt) / max(1, self.n * len(m))


def moments(rows: DataFrame, x: str = "v", t: str = "t", group: str | None = None) -> dict[object, Moments]:
    """The moments of the pairs ``x, t``, by ``group`` if one is named; a task sends sums, never rows."""
    workers_can_import(rows.sparkSession)
    key = F.col(group).cast("string") if group else F.lit("").cast("string")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = matrix_of(batch.column("x")), matrix_of(batch.column("t"))
            keys = np.array(batch.column("key").to_pylist(), object)
            for k in set(keys.tolist()):
                own = keys == k
                p, q = a[own], b[own]
                flat = np.concatenate([(p.T @ p).ravel(), (p.T @ q).ravel(), [np.sum(q * q), len(p)]])
                held[k] = held[k] + flat if k in held else flat
        for k, flat in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(flat)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["key", "pos", "value"])

    sums = rows.select(key.alias("key"), F.col(x).alias("x"), F.col(t).alias("t")).mapInArrow(summed, "key string, pos int, value double")
    found = sums.groupBy("key", "pos").agg(F.sum("value").alias("value")).orderBy("key", "pos").collect()  # two matrices for each group
    out: dict[object, Moments] = {}
    flats: dict[str, list[float]] = {}
    for r in found:
        flats.setdefault(r["key"], []).append(r["value"])
    for k, flat in flats.items():
        d = int(round(((len(flat) - 2) / 2) ** 0.5))
        values = np.array(flat)
        out[k if group else None] = Moments(values[: d * d].reshape(d, d), values[d * d : 2 * d * d].reshape(d, d), float(values[-2]), int(values[-1]))
    return out


@dataclass
class LowRank:
    """x + (x U) V', and the losses before each step of its training."""

    u: np.ndarray
    v: np.ndarray
    losses: list[float] = field(default_factory=list)

    @classmethod
    def seeded(cls, dim: int, rank: int, seed: int = 42) -> LowRank:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.01, (dim, rank)), rng.normal(0, 0.01, (dim, rank)))

    @property
    def matrix(self) -> np.ndarray:
        return np.eye(len(self.u)) + self.u @ self.v.T

    def trained(self, m: Moments, epochs: int, rate: float) -> LowRank:
        """Gradient steps on the mean squared error; a row counts ``dim`` times, as its components do."""
        u, v, losses = self.u.copy(), self.v.copy(), list(self.losses)
        step = rate * len(u)
        for _ in range(epochs):
            now = LowRank(u, v).matrix
            losses.append(m.loss(now))
            g = m.gradient(now)
            u, v = u - step * g @ v, v - step * g.T @ u
        return LowRank(u, v, losses)

    def apply(self, rows: DataFrame, vec_col: str, out: str, *keep: str) -> DataFrame:
        matrix = self.matrix
        return applied(rows, lambda x: unit_rows(x @ matrix), vec_col, out, *keep)


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def noisy(rows: DataFrame, vec_col: str, weight: str, base: float, most: float, id_col: str) -> DataFrame:
    """``vec_col`` with seeded noise, scaled by ``weight`` over its maximum, and made a unit; the seed is each row's id and position."""
    top = F.broadcast(rows.agg(F.max(weight).alias("__top")))
    scale = F.least(F.when(F.col("__top") > 0, F.col(weight) / F.col("__top")).otherwise(F.lit(0.0)) * base, F.lit(most))
    spread = lambda x, i: x + F.col("__scale") * ((F.pmod(F.xxhash64(F.col(id_col), i), F.lit(2001)) / 1000.0) - 1.0)
    out = rows.crossJoin(top).withColumn("__scale", scale).withColumn(vec_col, F.transform(vec_col, spread))
    return V.with_unit(out, vec_col, "__unit").withColumn(vec_col, F.col("__unit")).drop("__unit", "__scale", "__top")


def collapse_targets(log: DataFrame, least: int) -> DataFrame:
    """``vec_id, entries, noise``: rows logged ``least`` times or more, with the mean of the centres logged for them."""
    sizes = log.groupBy("vec_id").agg(F.count("*").alias("entries")).where(F.col("entries") >= least)
    return sizes.join(V.mean_vector(log.join(sizes.select("vec_id"), "vec_id", "left_semi"), "centre", "noise", "vec_id"), "vec_id")


def with_targets(rows: DataFrame, mode: str, homeostatic, teacher, share: float = 0.5) -> DataFrame:
    """Adds ``t``: the homeostatic target (baseline), the teacher's vector (offline), or their blend (hybrid)."""
    if mode not in ("baseline", "offline", "hybrid"):
        raise ValueError(f"unknown training mode: {mode}")
    if mode == "baseline":
        return rows.withColumn("t", homeostatic)
    if mode == "offline":
        return V.with_unit(rows.withColumn("__teacher", teacher), "__teacher", "t").drop("__teacher")
    mixed = rows.withColumn("__mix", F.zip_with(homeostatic, teacher, lambda a, b: (1 - share) * a + share * b))
    return V.with_unit(mixed, "__mix", "t").drop("__mix")


# ---------------------------------------------------------------- evolution

def perturbation(shape: tuple[int, int], seed: int, member: int, sigma: float, antithetic: bool) -> np.ndarray:
    """The member's step; with antithetic sampling members 2k and 2k + 1 have opposite ones."""
    rng = np.random.default_rng(seed + (member // 2 if antithetic else member))
    sign = -1.0 if antithetic and member % 2 else 1.0
    return sign * sigma * rng.normal(size=shape)


def shaped(fitness: np.ndarray, kind: str) -> np.ndarray:
    """Fitness by zscore, centred rank (in [-0.5, 0.5]) or linear rank (summing to zero); equal values share nothing but their order."""
    n = len(fitness)
    if kind == "zscore":
        return (fitness - fitness.mean()) / fitness.std() if fitness.std() > 1e-12 else np.zeros(n)
    ranks = np.empty(n)
    ranks[np.argsort(fitness, kind="stable")] = np.arange(n)
    if kind == "centered_rank":
        return ranks / max(1, n - 1) - 0.5
    if kind == "linear_rank":
        weights = ranks + 1
        return weights / weights.sum() - 1.0 / n
    raise ValueError(f"unknown shaping: {kind}")


@dataclass
class Generation:
    """One step: scores of the members, the best of them, the elite so far and whether the step was taken back."""

    number: int
    mean: float
    best: float
    fitness: float
    elite: float
    rolled_back: bool


def evolve(parameters: np.ndarray, score: Callable[[np.ndarray, list[np.ndarray]], np.ndarray], generations: int, members: int = 16, sigma: float = 0.05, rate: float = 0.1, seed: int = 42, shaping: str = "zscore", antithetic: bool = True, elites: int = 3, rollback: bool = True) -> tuple[np.ndarray, list[Generation]]:
    """Evolution strategy over a parameter matrix.

    ``score(parameters, steps)`` gives the fitness of the parameters plus each step, and last that of the parameters
    themselves; it is one distributed query for a whole population.  An archive keeps the ``elites`` best parameters seen;
    a step that falls under the best of them is taken back to it.
    """
    archive: list[tuple[float, np.ndarray]] = []
    history = []
    for g in range(generations):
        steps = [perturbation(parameters.shape, seed + 1000 * g, i, sigma, antithetic) for i in range(members)]
        found = score(parameters, steps)
        fitness, own = found[:-1], float(found[-1])
        archive = sorted([*archive, (own, parameters.copy()), (float(fitness.max()), parameters + steps[int(fitness.argmax())])], key=lambda e: -e[0])[:elites]
        weights = shaped(fitness, shaping)
        moved = parameters + rate / (members * sigma) * sum(w * s for w, s in zip(weights, steps, strict=True))
        (after,) = score(moved, [])
        back = rollback and float(after) < archive[0][0]
        parameters = archive[0][1].copy() if back else moved
        history.append(Generation(g, float(fitness.mean()), float(fitness.max()), float(after), archive[0][0], bool(back)))
    return parameters, history


def population_means(rows: DataFrame, evaluate: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], candidates: list[np.ndarray], columns: list[str]) -> np.ndarray:
    """The mean over all rows of what ``evaluate`` gives for each candidate: members times one pass, summed where the rows are.

    ``evaluate(batch, candidate)`` returns one value for each unit that it finds in the batch.
    """
    workers_can_import(rows.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(candidates)), np.zeros(len(candidates), np.int64)
        for batch in batches:
            if batch.num_rows:
                for i, c in enumerate(candidates):
                    values = evaluate(batch, c)
                    total[i] += float(values.sum())
                    n[i] += len(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(candidates), dtype=np.int32)), pa.array(total), pa.array(n)], ["member", "total", "n"])

    found = rows.select(*columns).mapInArrow(sums, "member int, total double, n long").groupBy("member").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = np.zeros(len(candidates))
    for r in found:
        out[r["member"]] = r["total"] / max(1, r["n"])
    return out


# ---------------------------------------------------------------- masks

def fit_mask_predictor(features: np.ndarray, masks: np.ndarray, hidden: int = 16, epochs: int = 200, rate: float = 0.5, seed: int = 42) -> tuple[Callable[[np.ndarray], np.ndarray], list[float]]:
    """Linear, ReLU, linear, sigmoid on the features of a neighbourhood, by gradient steps on the binary cross-entropy."""
    rng = np.random.default_rng(seed)
    centre, scale = features.mean(axis=0), np.where(features.std(axis=0) > 0, features.std(axis=0), 1)
    x = (features - centre) / scale
    w1, w2 = rng.normal(0, 0.1, (x.shape[1], hidden)), rng.normal(0, 0.1, (hidden, masks.shape[1]))
    b1, b2, losses = np.zeros(hidden), np.zeros(masks.shape[1]), []
    for _ in range(epochs):
        h = np.maximum(x @ w1 + b1, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40)))
        losses.append(float(-np.mean(masks * np.log(p + 1e-12) + (1 - masks) * np.log(1 - p + 1e-12))))
        error = (p - masks) / len(x)
        back = (error @ w2.T) * (h > 0)
        w2, b2 = w2 - rate * h.T @ error, b2 - rate * error.sum(axis=0)
        w1, b1 = w1 - rate * x.T @ back, b1 - rate * back.sum(axis=0)
    return lambda f: 1 / (1 + np.exp(-np.clip(np.maximum((f - centre) / scale @ w1 + b1, 0) @ w2 + b2, -40, 40))), losses
