"""The corpus pipeline: toxicity, line frequency, near duplicates, packing; each stage works on what the one before kept.

Each stage takes null, empty and very long texts, repeated rows, empty tables and columns of any names; what becomes of them
is said there and in the operators.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlane.llm import bbit, common, linefreq, packing, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the lexicon is learned from the labelled ones among ``docs``.

    Null and empty texts stay unless the curve says otherwise; repeated rows are judged each; other columns pass through.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, common.read_table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-frequency rules keep, rid of the removed lines; n_chars follows the text.

    Null texts and texts without words go (the base rules fail them); repeated rows are judged each; other columns pass
    through, and a table without n_chars gets none.
    """
    cleaned = linefreq.cleaned(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id; rows that repeat id and text stay once."""
    return bbit.without_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece of a document, with its sequence and place; null texts have their end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Tokenising, packing and a learned lexicon have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again.  An empty table gives no rows."""
    docs = common.read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{name}")
    return docs
