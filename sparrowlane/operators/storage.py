"""Simulated storage: device latencies, block graphs, virtual disk reads."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the simulated devices
#: name, fetch microseconds, branch microseconds, queue depth, gigaflops
DEVICES = [("rp2040", 500.0, 10.0, 2, 0.01), ("consumer_nvme", 100.0, 1.0, 16, 1.0), ("smartssd", 50.0, 2.0, 64, 60.0), ("dpu_storage", 25.0, 2.0, 128, 200.0)]
SECTOR, RESULT_LBA = 512, 100


def devices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEVICES, "device string, fetch_us double, branch_us double, max_queue long, gflops double")


def latency_us(fetch: Column, branch: Column, most: Column, depth: Column) -> Column:
    """branch + queued fetches, those over the queue depth at twice the time."""
    return branch + F.least(depth, most) * fetch + F.greatest(depth - most, F.lit(0)) * fetch * 2


def pack_block(matrix: np.ndarray, following: int) -> bytes:
    """A block: the matrix as half floats, then the offset of the next block (0: none)."""
    return matrix.astype("<f2").tobytes() + struct.pack("<Q", following)


def run_blocks(image: bytes, x: np.ndarray, size: int, start: int = 0) -> tuple[np.ndarray, int]:
    """Follow the blocks of an image: products with ReLU between them but not after the last; result and number of blocks."""
    width, at, seen = size * size * 2, start, 0
    while True:
        if at < 0 or at + width + 8 > len(image):
            raise ValueError("a block lies outside the image")
        x = x @ np.frombuffer(image, "<f2", size * size, at).reshape(size, size).astype(np.float32)
        seen += 1
        (at,) = struct.unpack_from("<Q", image, at + width)
        if not at:
            return x, seen
        x = np.maximum(x, 0)


def read_range(offset: Column, size: Column, total: int, payload: str) -> Column:
    """What a read of a zero-filled disk gives as hex: one sector at ``RESULT_LBA`` holds the payload, reads are clamped to the disk."""
    first = F.lit(SECTOR * RESULT_LBA)
    begin, end = F.least(offset, F.lit(total)), F.least(offset + size, F.lit(total))
    low, high = F.greatest(begin, first), F.least(end, first + SECTOR)
    sector = F.rpad(F.hex(F.lit(payload)), 2 * SECTOR, "0")
    overlap = F.when(low < high, F.substring(sector, (2 * (low - first) + 1).cast("int"), (2 * (high - low)).cast("int"))).otherwise("")
    before = F.repeat(F.lit("00"), F.greatest(F.when(low < high, low - begin).otherwise(end - begin), F.lit(0)).cast("int"))
    after = F.repeat(F.lit("00"), F.when(low < high, end - high).otherwise(F.lit(0)).cast("int"))
    return F.concat(before, overlap, after)
