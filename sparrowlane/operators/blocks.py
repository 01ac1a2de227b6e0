"""Vectors as files of packed blocks in the shared folder, which tasks stream past the rows that they hold.

A block is one Arrow file of ids and vectors.  Every task attempt writes files of its own names and only those of
successful attempts are listed, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path, open_fs, workers_can_import

BLOCK_BYTES = 4 << 20
CACHED_BYTES = 32 << 20


@dataclass(frozen=True)
class Blocks:
    """The files of a packed table; ``vectors`` in all."""

    files: tuple[str, ...]
    vectors: int
    bytes: int

    def __iter__(self) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Ids and matrix of each block; small tables are read once in a worker."""
        read = _cached if self.bytes <= CACHED_BYTES else _read
        for path in self.files:
            yield read(path)


def _read(path: str) -> tuple[pa.Array, np.ndarray]:
    fs, inner = open_fs(path)
    with fs.open_input_file(inner) as source:
        table = pa.ipc.open_file(source).read_all().combine_chunks()
    ids = table.column("id").chunk(0)
    return ids, table.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


_cached = functools.lru_cache(maxsize=16)(_read)


def matrix_of(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows over their norms; zero rows stay."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def row_shards(batches: Iterator[pa.RecordBatch], vec_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of about ``most`` bytes of vectors."""
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            width = max(8, 8 * len(batch.column(vec_col)[at]))
            part = batch.slice(at, max(1, (most - size) // width))
            at += part.num_rows
            held.append(part)
            size += part.num_rows * width
            if size + width > most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packed(df: DataFrame, id_col: str, vec_col: str, most: int = BLOCK_BYTES) -> Blocks:
    """Write ``df`` as blocks; null ids are left out."""
    spark = df.sparkSession
    workers_can_import(spark)
    folder = new_path(spark, "blocks")
    fs, inner = open_fs(folder)
    fs.create_dir(inner)
    scheme = folder[: folder.index("/", folder.index("://") + 3)] if "://" in folder else ""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_fs(folder)
        for rows in row_shards(batches, "v", most):
            name = f"{inner}/{uuid.uuid4().hex}.arrow"
            with store.open_output_stream(name) as out, pa.ipc.new_file(out, rows.schema) as file:
                file.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([scheme + name]), pa.array([rows.num_rows], pa.int64()), pa.array([rows.nbytes], pa.int64())], ["path", "n", "bytes"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    found = rows.mapInArrow(write, "path string, n long, bytes long").collect()  # one row for each block of megabytes
    return Blocks(tuple(sorted(r["path"] for r in found)), sum(r["n"] for r in found), sum(r["bytes"] for r in found))
