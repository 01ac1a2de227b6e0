"""Exact cosine search of a query set against all rows, in blocks of queries against shards of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import workers_can_import
from .blocks import Blocks, matrix_of, packed, row_shards, unit

SHARD_BYTES = 8 << 20  # of vectors that a task holds
CELLS = 1 << 21  # scores that it makes at a time
DIGITS = 12  # of a score; equal vectors get equal scores whatever block they are in


def ranked(df: DataFrame, k: int | None, keys: list[str], *order) -> DataFrame:
    """Adds ``rank`` (from 1) by keys, and keeps the first ``k``; Spark limits each task's groups before the shuffle."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def _steps(queries: np.ndarray, rows: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, rows))
    for at in range(0, len(queries), step):
        yield slice(at, at + step)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's ``k`` largest, by falling score and rising column; columns are in id order."""
    k = min(k, scores.shape[1])
    kth = np.partition(scores, -k, axis=1)[:, -k, None]
    row, column = np.nonzero(scores >= kth)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], column[rank < k]


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "v", query_col: str = "query_id", query_vec: str = "q", own: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, rank, id, score`` and ``keep`` of the rows: best rows by cosine (0 for a zero norm), ties to the smaller id.

    The rows are read once, whatever the number of queries; blocks of these pass by the shards that tasks hold.  ``own``
    false leaves out rows that have the query's own id.
    """
    spark = corpus.sparkSession
    workers_can_import(spark)
    types = {c: corpus.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    query_type = queries.schema[query_col].dataType.simpleString()
    blocks = packed(queries, query_col, query_vec)
    most = k if own else k + 1
    fields = "".join(f", `{c}` {types[c]}" for c in keep)
    if not blocks.vectors:
        return spark.createDataFrame([], f"query_id {query_type}, `{id_col}` {types[id_col]}, score double{fields}, rank int")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_shards(batches, "v", SHARD_BYTES):
            rows = rows.take(pc.sort_indices(rows.column("id")))
            vectors = unit(matrix_of(rows.column("v"))).T
            for ids, asked in blocks:
                asked = unit(asked)
                for part in _steps(asked, rows.num_rows):
                    scores = np.round(asked[part] @ vectors, DIGITS)
                    row, column = _best(scores, most)
                    taken = rows.take(pa.array(column))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + part.start)), taken.column("id"), pa.array(scores[row, column]), *(taken.column(c) for c in keep)], ["query_id", id_col, "score", *keep])

    rows = corpus.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *keep)
    found = rows.mapInArrow(search, f"query_id {query_type}, `{id_col}` {types[id_col]}, score double{fields}")
    if not own:
        found = found.where(~F.col("query_id").eqNullSafe(F.col(id_col)))
    return ranked(found, k, ["query_id"], F.col("score").desc(), id_col)


def score_statistics(corpus: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "v", query_col: str = "query_id", query_vec: str = "q") -> DataFrame:
    """``query_id, docs, mean, best`` of the cosines of each query with all rows; no pair becomes a row."""
    workers_can_import(corpus.sparkSession)
    blocks = packed(queries, query_col, query_vec)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_shards(batches, "v", SHARD_BYTES):
            vectors = unit(matrix_of(rows.column("v"))).T
            for ids, asked in blocks:
                asked = unit(asked)
                for part in _steps(asked, rows.num_rows):
                    scores = asked[part] @ vectors
                    yield pa.RecordBatch.from_arrays([ids.slice(part.start, len(scores)), pa.array(np.full(len(scores), rows.num_rows)), pa.array(scores.sum(axis=1)), pa.array(scores.max(axis=1))], ["query_id", "docs", "total", "best"])

    rows = corpus.select(F.col(vec_col).cast("array<double>").alias("v"))
    found = rows.mapInArrow(sums, f"query_id {queries.schema[query_col].dataType.simpleString()}, docs long, total double, best double")
    return found.groupBy("query_id").agg(F.sum("docs").alias("docs"), (F.sum("total") / F.sum("docs")).alias("mean"), F.max("best").alias("best"))


def route_scores(rows: DataFrame, routes: DataFrame, id_col: str = "vec_id", vec_col: str = "v", label: str = "label", route_col: str = "query_id", route_vec: str = "q", temperature: float = 0.07) -> DataFrame:
    """For each row, over all routes: ``id, label, route, score`` of the best (ties to the smaller), ``own, other`` and ``log_sum``.

    own is the score of the route named by ``label``, other the best of the rest, both null where there is none; log_sum
    is the logarithm of the sum of exp(score / temperature).  Blocks of routes pass by the rows; nothing is shuffled.
    """
    workers_can_import(rows.sparkSession)
    blocks = packed(routes.orderBy(route_col), route_col, route_vec)
    id_type = rows.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in row_shards(batches, "v", SHARD_BYTES):
            n = held.num_rows
            vectors = unit(matrix_of(held.column("v")))
            labels = pc.fill_null(held.column("label"), -(1 << 62)).to_numpy()
            best, route = np.full(n, -np.inf), np.zeros(n, np.int64)
            own, other, total = np.full(n, np.nan), np.full(n, -np.inf), np.zeros(n)
            for ids, matrix in blocks:
                names = ids.to_numpy(zero_copy_only=False)
                order = np.argsort(names)  # the first of equal scores is that of the smallest name
                names, targets = names[order], unit(matrix)[order].T
                for part in _steps(vectors, len(names)):
                    s = np.round(vectors[part] @ targets, DIGITS)
                    at = s.argmax(axis=1)
                    top, name = s[np.arange(len(s)), at], names[at]
                    better = (top > best[part]) | ((top == best[part]) & (name < route[part]))
                    best[part], route[part] = np.where(better, top, best[part]), np.where(better, name, route[part])
                    same = names[None] == labels[part, None]
                    has = same.any(axis=1)
                    own[part] = np.where(has, np.where(same, s, -np.inf).max(axis=1), own[part])
                    other[part] = np.maximum(other[part], np.where(same, -np.inf, s).max(axis=1))
                    total[part] += np.exp((s - 1) / temperature).sum(axis=1)
            nothing = ~np.isfinite(best)
            values = [pa.array(route, mask=nothing), pa.array(best, mask=nothing), pa.array(own, mask=np.isnan(own)), pa.array(other, mask=~np.isfinite(other)), pa.array(np.log(np.where(nothing, 1, total)) + 1 / temperature, mask=nothing)]
            yield pa.RecordBatch.from_arrays([held.column("id"), held.column("label"), *values], ["id", "label", "route", "score", "own", "other", "log_sum"])

    found = rows.select(F.col(id_col).alias("id"), F.col(label).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return found.mapInArrow(scored, f"id {id_type}, label long, route long, score double, own double, other double, log_sum double")


def similar_pairs(rows: DataFrame, least: float, id_col: str, vec_col: str) -> DataFrame:
    """``a, b, similarity`` of the pairs of rows with a < b and a cosine of ``least`` or more; only these leave a task."""
    workers_can_import(rows.sparkSession)
    blocks = packed(rows, id_col, vec_col)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in row_shards(batches, "v", SHARD_BYTES):
            own, vectors = held.column("id").to_numpy(), unit(matrix_of(held.column("v"))).T
            for ids, matrix in blocks:
                names, asked = ids.to_numpy(zero_copy_only=False), unit(matrix)
                for part in _steps(asked, len(own)):
                    scores = np.round(asked[part] @ vectors, DIGITS)
                    row, column = np.nonzero((scores >= least) & (names[part, None] < own[None]))
                    yield pa.RecordBatch.from_arrays([pa.array(names[part][row]), pa.array(own[column]), pa.array(scores[row, column])], ["a", "b", "similarity"])

    found = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return found.mapInArrow(linked, "a long, b long, similarity double")


def sharded_top_k(corpus: DataFrame, queries: DataFrame, k: int, shard: str, id_col: str = "vec_id", vec_col: str = "v") -> DataFrame:
    """Two phases: every shard scans all its rows for its best ``k``, then the host merges; ``query_id, rank, id, shard, score``.

    ``shard`` is a column of the rows.  Each shard's list is exact, so the merged one is.
    """
    scanned = _by_shard(corpus, packed(queries, "query_id", "q"), k, shard, id_col, vec_col, queries.schema["query_id"].dataType.simpleString())
    local = ranked(scanned, k, ["query_id", shard], F.col("score").desc(), id_col).drop("rank")
    return ranked(local, k, ["query_id"], F.col("score").desc(), id_col)


def _by_shard(corpus: DataFrame, blocks: Blocks, k: int, shard: str, id_col: str, vec_col: str, query_type: str) -> DataFrame:
    """The best ``k`` of each shard's rows in a task, for every query."""
    id_type, shard_type = (corpus.schema[c].dataType.simpleString() for c in (id_col, shard))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_shards(batches, "v", SHARD_BYTES):
            rows = rows.take(pc.sort_indices(rows.column("id")))
            for drive in rows.column("shard").unique():
                own = rows.filter(pc.equal(rows.column("shard"), drive))
                vectors = unit(matrix_of(own.column("v"))).T
                for ids, asked in blocks:
                    asked = unit(asked)
                    for part in _steps(asked, own.num_rows):
                        scores = np.round(asked[part] @ vectors, DIGITS)
                        row, column = _best(scores, k)
                        taken = own.take(pa.array(column))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + part.start)), taken.column("id"), taken.column("shard"), pa.array(scores[row, column])], ["query_id", id_col, shard, "score"])

    rows = corpus.select(F.col(id_col).alias("id"), F.col(shard).alias("shard"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(search, f"query_id {query_type}, `{id_col}` {id_type}, `{shard}` {shard_type}, score double")
