"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe places (see ``segments``), so one very long text is spread over many small encodings; the library
gets batches of about equal bytes.  No column but the id and the counts leaves the function and nothing is shuffled.

Null texts count as empty (0 tokens); a null id stays null; repeated rows are counted each; an empty table gives none.
Very long texts are counted whole.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .segments import byte_batches, hf_memo


@lru_cache(maxsize=2)
def _sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_texts(texts: pa.Array, path: str) -> np.ndarray:
    """The number of tokens of each text, by tokenizers for ``.json`` and by sentencepiece for ``.model``.

    Pieces of sentencepiece reach over spaces, so its texts are encoded whole, a batch of about equal bytes at a time.
    """
    if path.endswith(".model"):
        encode = _sentencepiece(path).encode
        return np.array([len(x) for batch in byte_batches(texts.to_pylist()) for x in encode(batch, num_threads=1)], np.int64)
    return hf_memo(path).counts(texts)


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of each row's whole text."""
    common.workers_can_import(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    @common.lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = common.texts_of(part.column("text"))
                counts = pa.array(count_texts(texts, tokenizer_path), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), pc.cast(pc.binary_length(texts), pa.int64()), counts], ["id", "n_bytes", "n_tokens"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(counted, f"id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
