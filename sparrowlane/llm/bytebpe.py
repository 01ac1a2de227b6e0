"""Byte-level BPE encoding and decoding with a file of ranks.

The tokenizers library encodes; its BPE model is built from the ranks: bytes stand as printable characters (the usual
byte-to-character rule) and the merges are all splits of a token into two tokens, in the order of the token's rank.  A
whole match that is a token is taken at once, as rank-file encoders do.  Decoding goes by a table of each id's bytes, so
tokens that end inside a character are put together before the bytes are read as UTF-8.

Null texts count as empty (no ids), null lists of ids decode to nothing; document ids may be null; repeated rows are
encoded each.  A very long text is cut at safe places and encoded whole.  An empty table gives no rows.  Other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .segments import SegmentMemo, packed_ids


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1, else one from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(0x100 + rest.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: lines of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        shown = byte_characters()
        as_text = {token: "".join(shown[b] for b in token) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            splits = [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
            merges += [(as_text[a], as_text[b]) for a, b in sorted(splits, key=lambda x: (ranks[x[0]], ranks[x[1]]))]
        self.tokenizer = Tokenizer(models.BPE(vocab={as_text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.decimal = [str(i) for i in range(len(self.table))]
        self.memo = SegmentMemo(self._ids)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [packed_ids(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(self, texts: pa.Array) -> Iterator[list[int]]:
        """The ids of each text."""
        ids, offsets = self.memo.ids(texts)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yield ids[a:b].tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids; characters that tokens split are whole again."""
        return b"".join([self.table[i] for i in ids])

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Start and end character of each token; a token with part of a character covers the whole character."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char_at = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.table[i]) for i in ids]) if ids else np.empty(0, np.int64)
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
        return [(int(char_at[a]), int(char_at[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ids array<int>, starts and ends array<int> (characters) of each row's whole text."""
    common.workers_can_import(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    @common.lean
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = common.texts_of(part.column("text"))
                ids = list(bpe.encode_batch(texts))
                spans = [bpe.offsets(t, i) for t, i in zip(texts.to_pylist(), ids, strict=True)]
                columns = [ids, [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans]]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], ["id", "ids", "starts", "ends"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encoded, f"id {id_type}, ids array<int>, starts array<int>, ends array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, decoded (binary) and text (UTF-8; bytes that are none become U+FFFD) of each row's ids."""
    common.workers_can_import(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    @common.lean
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            raw = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], ["id", "decoded", "text"])

    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(decoded, f"id {id_type}, decoded binary, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256 and decoded_sha256: encodes each whole text, then decodes its ids."""
    common.workers_can_import(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    @common.lean
    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for part in common.slices(batch, "text"):
                n, of_ids, of_bytes = [], [], []
                for ids in bpe.encode_batch(common.texts_of(part.column("text"))):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join([bpe.decimal[i] for i in ids]).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(digested, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
