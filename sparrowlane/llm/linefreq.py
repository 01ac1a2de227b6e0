"""Cross-document line frequency: remove lines that too many documents of a host share, reject depleted documents.

A line is normalised (A-Z lower-cased, white space squeezed) and hashed.  Its frequency is the number of distinct
documents (ids) of a host that hold it.  A line in more than ``most_documents`` documents of a host, however large the
host is, is removed from all of them.  A document is rejected if fewer than ``least_words`` words remain, or if more than
``most_removed`` of its words went.  ``most_share`` asks besides for a share of the host's documents; ``equal_texts_once``
counts documents of equal text once, and ``keep_first`` leaves a line in the first document (smallest id) and its copies;
all three are off.

Counting goes by (host, text) first, then by (host, line), both summed before the shuffle, so neither a hot host nor a hot
line nor a large group of copies gathers in one task.  Frequent lines are joined back by key; adaptive execution splits a
hot one.  All statistics come from all documents.

Texts that are null or have no words have no lines; they fail the base rules.  A null host is a host of its own.  Very
long texts are read whole.  Rows that repeat id, host and text are one document; rows that repeat an id alone are judged
by their own text and host.  An empty table gives no rows.  Other columns pass through :func:`cleaned` as they are, in a
struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Limits:
    """Base rules and the limits of line frequency."""

    base_words: int = 20
    repeat_percent: int = 30
    most_documents: int = 20
    least_words: int = 20  # as the base rule asks of a whole text
    most_removed: float = 0.8
    most_share: float = 0.0  # a share weakens the verdict as the host grows
    equal_texts_once: bool = False
    keep_first: bool = False


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = at - at[0]
    hashes, offsets = common.word_hashes(texts, lower=False)
    n_words = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), n_words)
    # windows of words found twice or more in the same text, and the words in them
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) >= WINDOW:
        windows = common.rolling_hash(hashes, WINDOW)
        inside = np.flatnonzero(doc[: len(windows)] == doc[WINDOW - 1 :])
        keys = common.mix(windows[inside] + doc[inside].astype(np.uint64) * common.MULTIPLIER)
        order = np.argsort(keys)
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        repeated = inside[order[np.append(same, False) | np.insert(same, 0, False)]]
        np.add.at(covered, repeated, 1)
        np.add.at(covered, repeated + WINDOW, -1)
    repeat_words = _per_text(np.cumsum(covered)[:-1] > 0, offsets) if len(hashes) else np.zeros(len(texts), np.int64)
    return {
        "n_words": n_words,
        "word_chars": _per_text(~_WHITE[raw] & ((raw & 0xC0) != 0x80), at),
        "n_symbols": _per_text(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)), at),
        "n_dup_lines": _duplicate_lines(texts),
        "n_repeat_words": repeat_words,
    }


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of the text."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    worded = pc.match_substring_regex(lines, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False)
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = doc[worded] * (len(lines) + 1) + codes[worded]
    total = np.bincount(doc[worded], minlength=len(texts))
    distinct = np.bincount(np.unique(keys) // (len(lines) + 1), minlength=len(texts))
    return (total - distinct).astype(np.int64)


def line_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line with a word: number of its text, hash of the normalised line, number of words; and in text order."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    hashes, offsets = common.word_hashes(lines)
    n = np.diff(offsets)
    worded = np.flatnonzero(n)
    if not len(worded):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    position = (np.arange(len(hashes)) - np.repeat(offsets[:-1], n)).astype(np.uint64)
    # words are weighted by their place, so that order counts
    weighed = common.mix(hashes + (position + np.uint64(1)) * common.MULTIPLIER)
    sums = np.add.reduceat(weighed, offsets[worded])
    return doc[worded], common.mix(sums + n[worded].astype(np.uint64)), n[worded]


def analysed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Written rows: id, host, text hash, base statistics, and the distinct line hashes with their words in all."""
    common.workers_can_import(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @common.lean
    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                texts = common.texts_of(part.column("text"))
                found = text_statistics(texts)
                doc, lines, words = line_hashes(texts)
                order = np.lexsort((lines, doc))
                doc, lines, words = doc[order], lines[order].view(np.int64), words[order]
                fresh = np.insert((doc[1:] != doc[:-1]) | (lines[1:] != lines[:-1]), 0, True)[: len(doc)]
                first = np.flatnonzero(fresh)
                summed = np.add.reduceat(words, first) if len(first) else words
                bounds = pa.array(np.searchsorted(doc[first], np.arange(part.num_rows + 1)).astype(np.int32))
                columns = [part.column("id"), part.column("host"), part.column("text_hash"), *(pa.array(found[c], pa.int64()) for c in counts)]
                columns += [pa.ListArray.from_arrays(bounds, pa.array(lines[first])), pa.ListArray.from_arrays(bounds, pa.array(summed.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "host", "text_hash", *counts, "lines", "line_words"])

    schema = f"id {id_type}, host string, text_hash long, {', '.join(c + ' long' for c in counts)}, lines array<long>, line_words array<long>"
    rows = docs.select(F.col(id_col).alias("id"), _host(F.col(host_col)).alias("host"), _text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return common.written(rows.mapInArrow(analyse, schema), "lines")


def _host(host: Column) -> Column:
    """A null host must meet itself in joins, and no other host."""
    return F.when(host.isNull(), "-").otherwise(F.concat(F.lit("+"), host.cast("string")))


def _text_hash(text: Column) -> Column:
    """Equal texts by 64 bits; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """The distinct texts of each host with their lines, smallest id and number of documents; ``rows`` from :func:`analysed`."""
    texts = rows.groupBy("host", "text_hash").agg(F.min("id").alias("id"), F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    copies = rows.select("host", "text_hash", "id").distinct().groupBy("host", "text_hash").agg(F.count("*").alias("copies"))
    return common.written(texts.join(copies, ["host", "text_hash"]), "texts")


def frequent_lines(texts: DataFrame, limits: Limits) -> DataFrame:
    """``host, line, first_id`` of the lines over the limits; ``texts`` from :func:`distinct_texts`."""
    n = F.lit(1) if limits.equal_texts_once else F.col("copies")
    texts = texts.withColumn("n", n.cast("long"))
    lines = texts.select("host", "id", "n", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.sum("n").alias("documents"), F.min("id").alias("first_id"))
    lines = lines.where(F.col("documents") > limits.most_documents)
    if limits.most_share:
        totals = texts.groupBy("host").agg(F.sum("n").alias("host_documents"))
        lines = lines.join(totals, "host").where(F.col("documents") > limits.most_share * F.col("host_documents"))
    return lines.select("host", "line", "first_id")


def judged(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:  # noqa: B008
    """A row per document: ``id_col``, the base statistics, base_failed, removed_words, kept, and ``removed``: its removed line hashes."""
    rows = analysed(docs, id_col, text_col, host_col)
    texts = distinct_texts(rows)
    frequent = common.written(frequent_lines(texts, limits), "frequent")
    held = texts.select("host", "text_hash", "id", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("host", "text_hash", "id", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    removed = held.join(frequent, ["host", "line"])
    if limits.keep_first:
        removed = removed.where(~F.col("id").eqNullSafe(F.col("first_id")))
    removed = common.written(removed.groupBy("host", "text_hash").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed")), "removed")
    common.delete(docs.sparkSession, texts, frequent)
    out = rows.join(removed, ["host", "text_hash"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < limits.base_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    rest = F.col("n_words") - F.col("removed_words")
    out = out.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (rest >= limits.least_words) & (F.col("removed_words") <= limits.most_removed * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", kept.alias("kept"), "removed")


def without_lines(text: str, removed: set[int]) -> str:
    """The text without the lines whose hashes are given."""
    lines = text.split("\n")
    doc, hashes, _ = line_hashes(pa.array(lines))
    gone = {d for d, h in zip(doc.tolist(), hashes.view(np.int64).tolist(), strict=True) if h in removed}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone)


def cleaned(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that are kept, with all their columns and the texts rid of the removed lines."""
    common.workers_can_import(docs.sparkSession)
    verdicts = judged(docs, limits, id_col, text_col, host_col).where("kept")
    # a verdict belongs to a text of a host, so rows of one id are told apart
    verdicts = verdicts.groupBy("host", "text_hash").agg(F.first("removed").alias("removed"))
    keyed = docs.select(common.row_of(docs), _host(F.col(host_col)).alias("host"), _text_hash(F.col(text_col)).alias("text_hash"))
    joined = keyed.join(verdicts, ["host", "text_hash"]).select("row", "removed")
    place = docs.columns.index(text_col)

    @common.lean
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            names = [f.name for f in row.type]
            flat = pa.RecordBatch.from_arrays([*row.flatten(), batch.column("removed")], [str(i) for i in range(len(names) + 1)])
            for part in common.slices(flat, place):
                columns, text = part.columns[:-1], part.column(place)
                new = [without_lines(t, set(r)) if t and r else t for t, r in zip(text.to_pylist(), part.columns[-1].to_pylist(), strict=True)]
                columns[place] = pa.array(new, text.type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(clean, docs.schema)
