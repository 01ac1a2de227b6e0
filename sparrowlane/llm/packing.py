"""Best-fit packing of token sequences by the sum-of-squares rule.

Every document becomes its token ids and an end id; only documents longer than a sequence are cut, into full pieces and a
rest.  A piece goes where the sum over all residual gaps of the squared number of open bins with that gap becomes
smallest: into an open bin of some gap, or into a new one (ties: the smaller gap, so best fit decides).  Pieces are
taken longest first, which leaves the small ones to fill the gaps.

The rule needs the number of open bins per gap only, so a packer's state is bounded by the capacity and its open bins.
Pieces are dealt by hash to groups of about ``group_pieces``; each group is packed by itself and gives away at most the
last few bins' rests, so the groups run on any number of executors.  The tokens are encoded once, into a written table of
piece lengths; a lost executor repeats one group.

Null texts count as empty: their end id is packed alone.  Ids may be null or repeated: each row is packed.  A very long
text is read whole and gives as many pieces as it needs.  Pieces of equal length are taken by hash, id and number, so a
repeated task packs alike.  An empty table gives no rows.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .segments import MEMO_BYTES, hf_memo

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 8192


class SumOfSquares:
    """Bins of one capacity, filled by the sum-of-squares rule."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)  # open bins by gap; a full bin is not open
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def choose(self, size: int) -> int:
        """The gap to place ``size`` into; the capacity itself stands for a new bin."""
        c, n = self.capacity, self.open
        left = n[: c - size + 1]  # by gap - size
        cost = 2 * left.astype(np.int64) + 1
        cost[0] = 0  # the bin closes
        old = cost[:-1] - 2 * n[size:c] + 1
        new = int(cost[c - size])
        fits = np.flatnonzero(n[size:c] > 0)
        if len(fits):
            best = int(fits[np.argmin(old[fits])])
            if old[best] <= new:
                return size + best
        return c

    def place(self, size: int) -> tuple[int, int]:
        """Bin number and offset of a new piece."""
        gap = self.choose(size)
        if gap == self.capacity:
            number = self.made
            self.made += 1
        else:
            number = self.bins[gap].pop()
            self.open[gap] -= 1
        if gap > size:
            self.bins[gap - size].append(number)
            self.open[gap - size] += 1
        return number, self.capacity - gap


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length, longest placed first."""
    packer = SumOfSquares(capacity)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        number[i], offset[i] = packer.place(int(lengths[i]))
    return number, offset


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32 of each piece of each row's encoded text, and ``deal`` to group by."""
    common.workers_can_import(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    @common.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = hf_memo(tokenizer_path, memo_bytes)
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = common.texts_of(part.column("text"))
                if not pc.any(pc.match_substring(texts, "<|")).as_py():
                    texts = pc.ascii_lower(texts)  # the tokenizer lower-cases too, but not special tokens: fewer segments
                ids, offsets = memo.ids(texts)
                row, number, length, crc = [], [], [], []
                for i in range(part.num_rows):
                    own = ids[offsets[i] : offsets[i + 1]].tobytes() + end
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        piece = own[at : at + 4 * capacity]
                        row.append(i)
                        number.append(k)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                number = np.array(number, np.int64)
                columns = [part.column("id").take(pa.array(row, pa.int64())), pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.xxhash64("id", "piece", "ids_crc32").alias("deal"))


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to the written rows of :func:`pieces`."""
    id_type = cut.schema[id_col].dataType.simpleString()
    rows = cut.count()
    groups = max(1, -(-rows // group_pieces))
    kept = [id_col, "piece", "start", "length", "ids_crc32"]

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        # a fixed order whatever the shuffle delivers: a repeated task packs alike
        table = table.sort_by([("length", "descending"), ("deal", "ascending"), (id_col, "ascending"), ("piece", "ascending")])
        number, offset = pack_lengths(table.column("length").to_numpy(), capacity)
        return table.select(kept).append_column("sequence_id", pa.array(number + (key[0].as_py() << 40))).append_column("offset", pa.array(offset))

    grouped = cut.withColumn("group", F.pmod(F.col("deal"), F.lit(groups)).cast("long")).groupBy("group")
    return grouped.applyInArrow(packed, f"{id_col} {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.

    ``memo_bytes`` trades a worker's memory for encoding time; it has no part in the result.
    """
    cut = common.written(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, memo_bytes), "pieces")
    return pack(cut, capacity, group_pieces, id_col)
