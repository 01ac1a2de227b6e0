"""Exact top-k inner product search, block at a time.

Vectors of integers are dealt by hash into shards of bounded bytes.  In a shard they are put in an order that brings like
vectors together and cut into blocks of consecutive rows.  Each block keeps the largest and smallest value of every
dimension and a forward index: the block's vectors as one matrix.  For a query, the sum over the dimensions of the
larger product with the two extremes bounds every score of the block.  A query visits its blocks by falling bound and
stops when the bound is below its k-th score; a bound equal to it is still scored, since a smaller id may win the tie.
Visits come in rounds of 1, 2, 4, ... blocks, so that all queries that meet a block in a round share one matrix product.

The table is shuffled once, whatever the number of queries: a task holds a shard, and packed batches of queries, written
to the shared folder, pass by it one at a time.  One shard in ``SAMPLE`` is searched first; its k-th scores bound those
of the whole table from below and go along with the queries to the other shards, which therefore give few rows each.  The
best k of all shards follow.

Vectors that are null, empty or hold a null or non-finite component, and rows with a null id, take no part.  Vectors are
compared only with those of the same length.  Rows that repeat an id are candidates each for other queries, none for
their own id's; a row repeated more than k times cannot fill more than k places, so k of its copies are dealt.  A repeated
query is searched once, by its largest vector.  Ties go to the smaller id.  Scores must fit 64 bits.  An empty table or
query set gives no rows.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import open_fs
from . import common

SHARD_BYTES = 16 << 20  # of a shard's vectors as 64-bit numbers
BATCH_QUERIES = 1024
BLOCK_ROWS = 128
SAMPLE = 64
HELD_CANDIDATES = 1 << 19
NO_LEAST = -(1 << 63)


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as doubles, null where the vector takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite & (F.size(vector) > 0), F.transform(doubles, lambda x: F.floor(x * scale)))


def _reordered(matrix: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """An order that puts like vectors together: by the dimension of the largest value, then of the second, then id."""
    size = np.abs(matrix)
    lead = np.argsort(-size, axis=1, kind="stable")[:, :2]
    sign = np.take_along_axis(matrix, lead, axis=1) < 0
    keys = lead * 2 + sign
    return np.lexsort((ids, keys[:, -1], keys[:, 0]))


class Shard:
    """Blocks of one shard with bounds and forward indexes."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, block_rows: int = BLOCK_ROWS):
        order = _reordered(matrix, ids)
        self.ids, matrix = ids[order], matrix[order]
        starts = np.arange(0, len(ids), block_rows)
        self.high, self.low = np.maximum.reduceat(matrix, starts), np.minimum.reduceat(matrix, starts)
        self.blocks = [(self.ids[s : s + block_rows], matrix[s : s + block_rows]) for s in starts]
        self.most = int(np.abs(matrix).max(initial=0))
        self.scored = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of query, id and score of each query's best k, best first; none under the query's ``least`` score."""
        # sums below 2^53 are exact in doubles, whose matrix products are fast
        exact = queries.shape[1] * self.most * int(np.abs(queries).max(initial=0)) < 1 << 53
        number = np.float64 if exact else np.int64
        q, high, low = queries.astype(number), self.high.astype(number), self.low.astype(number)
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        place = np.empty(bounds.shape, np.int32)
        np.put_along_axis(place, np.argsort(-bounds, axis=1, kind="stable"), np.arange(len(self.blocks), dtype=np.int32)[None], 1)
        if not hasattr(self, "forward") or self.forward[0].dtype != number:
            self.forward = [np.ascontiguousarray(m.T.astype(number)) for _, m in self.blocks]
        kth = np.full(len(q), -np.inf if exact else np.iinfo(np.int64).min, number)
        if least is not None:
            kth = np.maximum(kth, least.astype(number))
        kth_id = np.full(len(q), np.iinfo(np.int64).max)
        best, held, waiting = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, number)), [], 0

        def merged(parts: list) -> tuple[np.ndarray, ...]:
            row, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids, -scores, row))
            row, ids, scores = row[order], ids[order], scores[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            last = rank == k - 1
            kth[row[last]], kth_id[row[last]] = scores[last], ids[last]
            return row[rank < k], ids[rank < k], scores[rank < k]

        start, width = 0, 1
        while start < len(self.blocks):
            wanted = (place >= start) & (place < start + width) & (bounds >= kth[:, None])
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows = np.flatnonzero(wanted[:, b] & (bounds[:, b] >= kth))
                self.scored += len(rows)
                ids, scores = self.blocks[b][0], q[rows] @ self.forward[b]
                floor = kth[rows, None]
                good = ((scores > floor) | ((scores == floor) & (ids[None] < kth_id[rows, None]))) & (ids[None] != query_ids[rows, None])
                r, c = np.nonzero(good)
                held.append((rows[r], ids[c], scores[r, c]))
                waiting += len(r)
                if waiting > HELD_CANDIDATES:
                    best, held, waiting = merged([best, *held]), [], 0
            if held:
                best, held, waiting = merged([best, *held]), [], 0
            start, width = start + width, 2 * width
        return best[0], best[1], best[2].astype(np.int64)


def _small(matrix: np.ndarray) -> np.ndarray:
    """In the narrowest of the signed types that hold all values."""
    for kind in (np.int16, np.int32):
        if not matrix.size or (matrix.min() >= np.iinfo(kind).min and matrix.max() <= np.iinfo(kind).max):
            return matrix.astype(kind)
    return matrix


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """``dim, part, ids, matrix, kind, least`` with one row for each part of the rows ``id, v, least``."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        matrix, least = _small(flat), table.column("least").to_numpy()
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "ids": [table.column("id").to_numpy().tobytes()], "matrix": [matrix.tobytes()], "kind": [matrix.dtype.str], "least": [least.tobytes()]})

    dealt = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(parts)).alias("part"), "id", "v", "least")
    return dealt.groupBy("dim", "part").applyInArrow(pack, "dim int, part long, ids binary, matrix binary, kind string, least binary")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["matrix"], row["kind"]).reshape(-1, row["dim"]).astype(np.int64), np.frombuffer(row["least"], np.int64)


def _search(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of the batches ``asked`` (written rows of :func:`_packed`) in each shard."""
    files = asked.inputFiles()

    @common.lean
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                ids, matrix, _ = _unpacked(row)
                shard = Shard(ids, matrix)
                for path in files:
                    fs, inner = open_fs(path)
                    with fs.open_input_file(inner) as source:
                        for one in pq.ParquetFile(source).iter_batches(batch_size=1):
                            (ask,) = one.to_pylist()
                            if ask["dim"] != row["dim"]:
                                continue
                            query_ids, queries, least = _unpacked(ask)
                            number, found, scores = shard.search(query_ids, queries, k, least)
                            if len(number):
                                yield pa.RecordBatch.from_arrays([pa.array(query_ids[number]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])

    return shards.mapInArrow(searched, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best rows of ``vectors``; columns ``id_col`` and array<bigint> ``vector_col`` in both."""
    spark = vectors.sparkSession
    common.workers_can_import(spark)
    usable = F.col(id_col).isNotNull() & (F.size(vector_col) > 0)
    id_and_vector = F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")
    # a third of all rows may be one row: copies are counted before they are dealt
    rows = vectors.where(usable).select(*id_and_vector).groupBy("id", "v").agg(F.count("*").alias("n"))
    rows = rows.select("id", "v", F.explode(F.array_repeat(F.lit(NO_LEAST), F.least("n", F.lit(k)).cast("int"))).alias("least"))
    asked = queries.where(usable).groupBy(id_and_vector[0]).agg(F.max(vector_col).alias("v"))
    asked = common.written(asked, "queries")
    size = vectors.where(usable).agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("dim")).first()
    count = asked.count()
    if not size["n"] or not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = max(1, -(-size["n"] * size["dim"] * 8 // shard_bytes))
    batches = max(1, -(-count // BATCH_QUERIES))
    first = -(-shards // SAMPLE)

    packed = common.written(_packed(rows, shards), "shards")
    ask = common.written(_packed(asked.withColumn("least", F.lit(NO_LEAST)), batches), "asked")
    found = common.written(_best(_search(packed.where(F.col("part") < first).repartition(first, "part"), ask, k), k), "found")
    if shards == first:
        return found.select("query_id", "rank", "vec_id", "score")
    kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    bounded = asked.join(kth, "id", "left").select("id", "v", F.coalesce("least", F.lit(NO_LEAST)).alias("least"))
    ask = common.written(_packed(bounded, batches), "asked")
    rest = _search(packed.where(F.col("part") >= first).repartition(shards - first, "part"), ask, k)
    return _best(found.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
