"""Similarity graphs: bonds over all pairs counted in blocks, clusters, decomposition trees.

No pair becomes a row: vectors lie in blocks, a task holds one block, half of the others pass by it, and it returns counts
and sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import workers_can_import
from .blocks import Blocks, packed, unit

BLOCK_BYTES = 4 << 20
CELLS = 1 << 20  # pairs that a task looks at together
BONDS = ("none", "vdw", "hydrogen", "covalent")


def bond(similarity: Column, thresholds: tuple[float, float, float] = (0.4, 0.7, 0.9)) -> Column:
    """covalent, hydrogen, vdw or none by rising thresholds."""
    low, mid, high = thresholds
    if not 0 < low < mid < high:
        raise ValueError("thresholds must be positive and rising")
    return F.when(similarity >= high, "covalent").when(similarity >= mid, "hydrogen").when(similarity >= low, "vdw").otherwise("none")


def _summed(same: np.ndarray, sim: np.ndarray, post: np.ndarray, thresholds: tuple[float, float, float]) -> list[tuple]:
    """label (-1 for different ones), codes before and after, pairs, total, squares, low and high of flat arrays of pairs."""
    before, after = (np.searchsorted(thresholds, s, side="right") for s in (sim, post))
    labels, code = np.unique(same, return_inverse=True)
    cell = (code.ravel() * 4 + before) * 4 + after
    n = np.bincount(cell, minlength=16 * len(labels))
    total, squares = np.bincount(cell, sim, len(n)), np.bincount(cell, sim * sim, len(n))
    low, high = np.full(len(n), np.inf), np.full(len(n), -np.inf)
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.insert(cell[order][1:] != cell[order][:-1], 0, True))
    low[cell[order][starts]], high[cell[order][starts]] = np.minimum.reduceat(sim[order], starts), np.maximum.reduceat(sim[order], starts)
    return [(int(labels[c // 16]), int(c // 4 % 4), int(c % 4), int(n[c]), float(total[c]), float(squares[c]), float(low[c]), float(high[c])) for c in np.flatnonzero(n).tolist()]


def pair_counts(df: DataFrame, before: str, after: str, label: str, thresholds: tuple[float, float, float] = (0.4, 0.7, 0.9), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Over unordered pairs of rows: ``label`` (of both, null if they differ), bond, bond_after, pairs, total, squares, low, high.

    ``before`` and ``after`` are vector columns (they may be one); sums are of the similarities of ``before``.  Rows are
    dealt by their place in the table, so copies of a vector are in all blocks.  Of n blocks in a ring each meets the next
    n / 2, so every two blocks meet once and all tasks have the same work; nothing is shuffled but the counts.
    """
    spark = df.sparkSession
    workers_can_import(spark)
    width = F.size(before)
    rows = df.select(F.concat(F.array(F.coalesce(F.col(label).cast("double"), F.lit(-1.0))), before, after).alias("v"), F.monotonically_increasing_id().alias("id"))
    blocks = packed(rows, "id", "v", block_bytes)
    split = df.agg(F.max(width)).first()[0]
    n = len(blocks.files)
    if not n:
        return spark.createDataFrame([], "label long, bond string, bond_after string, pairs long, total double, squares double, low double, high double")
    one = lambda i: Blocks((blocks.files[i],), 0, blocks.bytes)

    def sides(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return m[:, 0].astype(np.int64), unit(m[:, 1 : 1 + split]), unit(m[:, 1 + split :])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in (a for batch in batches for a in batch.column("id").to_pylist()):
            found: list[tuple] = []
            ((_, own),) = one(a)
            labels, x, y = sides(own)
            for b in [a, *((a + k) % n for k in range(1, n // 2 + 1) if 2 * k < n or a < (a + k) % n)]:
                ((_, other),) = one(b)
                others, u, v = sides(other)
                step = max(1, CELLS // max(1, len(others)))
                for at in range(0, len(x), step):
                    take = slice(at, at + step)
                    sim, post = np.clip(x[take] @ u.T, -1, 1), np.clip(y[take] @ v.T, -1, 1)
                    same = np.where((labels[take, None] == others[None]) & (labels[take, None] >= 0), labels[take, None], -1)
                    if a == b:
                        keep = np.arange(at, at + len(sim))[:, None] < np.arange(len(others))[None]
                        sim, post, same = sim[keep], post[keep], same[keep]
                    if sim.size:
                        found += _summed(same.ravel(), sim.ravel(), post.ravel(), thresholds)
                if len(found) > 1000:
                    yield _counts(found)
                    found = []
            if found:
                yield _counts(found)

    found = spark.range(0, n, 1, min(n, 100_000)).mapInArrow(count, "label long, bond string, bond_after string, pairs long, total double, squares double, low double, high double")
    sums = [F.sum(c).alias(c) for c in ("pairs", "total", "squares")]
    return found.groupBy("label", "bond", "bond_after").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))


def _counts(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True))
    names = ["label", "bond", "bond_after", "pairs", "total", "squares", "low", "high"]
    return pa.RecordBatch.from_arrays([pa.array([None if k < 0 else k for k in columns[0]], pa.int64()), *(pa.array([BONDS[k] for k in c]) for c in columns[1:3]), *(pa.array(c) for c in columns[3:])], names)


def decomposition_tree(queries: DataFrame, id_col: str, text_col: str, max_depth: int = 3, least: int = 20) -> DataFrame:
    """``root, node, parent, depth, text, is_leaf``: one DataFrame step per depth; node is the path of halves (1 or 2)."""
    level = queries.select(F.col(id_col).alias("root"), F.lit("0").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.col(text_col).alias("text"))
    out = None
    for depth in range(max_depth + 1):
        parts = T.split_conjunction(F.col("text"))
        leaf = F.lit(True) if depth == max_depth else T.is_atomic(F.col("text"), least) | (F.size(parts) < 2)
        marked = level.withColumn("is_leaf", leaf)
        out = marked if out is None else out.unionByName(marked)
        children = marked.where(~F.col("is_leaf")).select("root", "node", F.posexplode(parts).alias("half", "part"))
        level = children.select("root", F.concat("node", F.lit("."), (F.col("half") + 1).cast("string")).alias("node"), F.col("node").alias("parent"), F.lit(depth + 1).alias("depth"), F.col("part").alias("text"))
    return out


def variance_median_partition(df: DataFrame, clusters: int, id_col: str, vec_col: str) -> DataFrame:
    """``id, cluster``: halves by the median of the dimension of most variance, level by level; at most log2(clusters) levels."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.lit("").alias("cell"))
    budget, done = {"": clusters}, False
    while not done:
        splits = {c: n for c, n in budget.items() if n > 1}
        done = not splits
        if done:
            break
        stats = rows.where(F.col("cell").isin(*splits)).select("cell", F.posexplode("v").alias("pos", "x")).groupBy("cell", "pos").agg(F.var_pop("x").alias("var"), F.median("x").alias("cut"))
        best = stats.groupBy("cell").agg(F.max_by(F.struct("pos", "cut"), F.struct("var", -F.col("pos"))).alias("b")).select("cell", "b.pos", "b.cut")
        # at most one row for each wanted cluster
        rows = rows.join(F.broadcast(best), "cell", "left")
        side = F.when(F.col("pos").isNull(), "").when(F.element_at("v", (F.col("pos") + 1).cast("int")) <= F.col("cut"), "0").otherwise("1")
        rows = rows.select("id", "v", F.concat("cell", side).alias("cell"))
        budget = {c: n for c, n in budget.items() if n <= 1} | {k: m for c, n in splits.items() for k, m in ((c + "0", n // 2), (c + "1", n - n // 2))}
    return rows.select("id", F.col("cell").alias("cluster"))
