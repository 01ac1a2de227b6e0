"""What the operators share: the shared folder, written intermediates and vectorised text kernels.

Words are the maximal runs of characters outside ``\\x20\\x09-\\x0D`` and are known by 64-bit hashes.  All kernels take
Arrow string arrays (nulls count as empty) and work on slices of bounded bytes, so a batch of very long texts needs no
more memory than a batch of short ones.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, workers_can_import, written

__all__ = ["new_path", "workers_can_import", "written"]

SLICE_BYTES = 2 << 20  # kernels hold some 20 times as much for word lists, hashes and gathers
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- shared folder

def delete(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove the files of frames from :func:`written` that no later plan reads."""
    fs_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for df in frames for f in df.inputFiles()}:
        p = fs_of(path)
        p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within the block a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of(df: DataFrame) -> Column:
    """All columns as one struct ``row``, beside which an operator's own columns cannot clash with theirs."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias("row")


def mapped_rows(df: DataFrame, keep: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` through a function of Arrow batches that returns rows of the same columns; columns go by place, so names are free."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(keep, plain.schema).toDF(*df.columns)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased; other letters as they are."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


# ---------------------------------------------------------------- Arrow helpers

def give_back() -> None:
    """Hand free memory back to the system: a worker is used again by later stages and must not keep what one needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function of Arrow batches that gives its free memory back when it ends."""

    @functools.wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            give_back()

    return run


def slices(batch: pa.RecordBatch, column: str | int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most`` bytes of ``column``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(array: pa.Array) -> pa.Array:
    """Null texts as empty ones, without an offset into a larger buffer."""
    out = pc.fill_null(array, "")
    return pa.concat_arrays([out]) if out.offset else out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX_1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX_2
    return h ^ (h >> np.uint64(31))


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit xxh3 of each string; equal strings are hashed once."""
    coded = values.dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and offsets: text i has words ``offsets[i]`` to ``offsets[i + 1]``."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    empty = pc.equal(pc.binary_length(flat), 0)
    if pc.any(empty).as_py():
        keep = pc.invert(empty)
        flat = flat.filter(keep)
        offsets = np.concatenate(([0], np.cumsum(keep.to_numpy(zero_copy_only=False))))[offsets]
    return flat, offsets


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the offsets of :func:`split_words`; ``lower``: A-Z lower-cased first."""
    flat, offsets = split_words(pc.ascii_lower(texts) if lower else texts)
    return hash_strings(flat), offsets


def rolling_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of ``n`` words of the whole array, windows across texts included."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    last = len(words) - n + 1
    out = words[:last].copy()
    for k in range(1, n):
        out *= MULTIPLIER
        out += words[k : k + last]
    return mix(out)


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``n``-word shingles.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    words, offsets = word_hashes(texts)
    windows = rolling_hash(words, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(windows[a : b - n + 1])
            fresh = np.empty(len(s), bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            out.append(s[fresh])
        elif b > a:
            out.append(rolling_hash(words[a:b], b - a) ^ mix(np.array([b - a], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
