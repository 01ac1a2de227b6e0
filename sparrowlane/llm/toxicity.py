"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded texts.

Folding: lower case, look-alike letters of other scripts and full-width forms become Latin ones, digits and signs that
stand for letters become letters in words that have letters, and ``l`` and ``i`` count as one letter since the digit 1
stands for both.  Everything else but letters and digits becomes a space, invisible characters go.

The lexicon is learned from labelled rows: words and word beginnings (which catch compounds and inflections) that toxic
texts have far more often than others, by the likelihood ratio; a beginning stands for all longer entries under it.  A
weight is the logarithm of the ratio of the two rates.  Copies and near copies of a labelled text teach once: of texts of
one label with the same smallest five-word shingle hash one stays, so words of one group of copies are no entries.  An
entry must be in ``least_texts`` of the toxic texts that stay, whatever their number, so more labels bring more entries.
Exception phrases are an entry with a word before or after it that only clean texts have; an entry inside one does not
count.  A text's sum of weights, per 100 words and as it is (long texts may be toxic in a few places), goes through a
logistic curve fitted on the same rows.

The fit reads at most ``most_rows`` labelled rows (chosen by hash of the id: a documented bound); their texts are found by
a broadcast of these ids.  Entries are counted and chosen in Spark; the lexicon and two numbers for each of the bounded
rows reach the driver.  A lexicon of more than ``most_entries`` is an error, nothing is dropped from it.  Scoring reads
every whole text once and shuffles nothing; its time is linear in the text.

Null and empty texts have no matches and get the curve's score of 0.  Rows with a null id or label teach nothing; of
repeated label rows the larger label counts; a document that occurs twice teaches once and is scored in each row.  With no
labelled row of both kinds the lexicon is empty and scores are 0.  An empty table gives no rows.  Other columns are passed
on or left out as they are, and their names cannot clash: only the id, text and label columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROWS = 16_384
MOST_ENTRIES = 200_000
LEAST_RATIO = 20.0  # likelihood ratio of an entry
LEAST_TEXTS = 6  # toxic texts that have it, copies counted once
LEAST_RATE = 20.0  # times as frequent in toxic as in clean texts
SAME_TEXTS = 0.95
PREFIXES = range(4, 13)
COUNTED_KEYS = 200_000  # that a task holds before it hands on its sums
THRESHOLD = 0.7

# fixed values: letters of other scripts that look like Latin ones
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "i", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "γ": "y", "ϲ": "c", "ϳ": "j", "ı": "i", "ɑ": "a", "ɡ": "g", "ƅ": "b", "ʏ": "y", "ꜱ": "s", "օ": "o",
}
# fixed values: digits and signs that stand for letters
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i"}
INVISIBLE = "­​‌‍⁠﻿"


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(k): v for k, v in HOMOGLYPHS.items()}
    out |= {0xFF01 + k: chr(0x21 + k).lower() for k in range(94)}
    out |= {ord(c): None for c in INVISIBLE}
    out[ord("l")] = SUBSTITUTES["l"]
    return out


_FOLD = _table()
_SUBSTITUTE = {ord(k): v for k, v in SUBSTITUTES.items()}
_PART = re.compile(r"[^\W_]+(?:[@$]+[^\W_]+)*")
_SIGN = re.compile(r"[0-9@$]")
_LETTERED = re.compile(r"[^\W\d_]")


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    text = text.lower().translate(_FOLD)
    words = _PART.findall(text)
    if _SIGN.search(text):
        words = [x.translate(_SUBSTITUTE) if _SIGN.search(x) and _LETTERED.search(x) else x for x in words]
    return words


@dataclass
class Lexicon:
    """Entries are folded words, with ``*`` at the end for word beginnings; exceptions are folded phrases."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    bias: float = -30.0
    slopes: tuple[float, float] = (0.0, 0.0)

    def automaton(self):
        """Aho-Corasick over entries and exceptions, each from a word's start."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            key = " " + (entry[:-1] if entry.endswith("*") else entry + " ")
            out.add_word(key, (len(key), weight))
        for phrase in self.exceptions:
            out.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(out):
            out.make_automaton()
        return out

    def hits(self, words: list[str], automaton) -> list[tuple[int, int, float]]:
        """Start, end and weight of the entries in the folded text; at one start only the heaviest counts."""
        if not len(automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(" " + " ".join(words) + " "):
            start = end + 1 - length
            if weight is None:
                spared.append((start, end))
            elif start not in best or weight > best[start][1]:
                best[start] = (end, weight)
        # spans by start, and the farthest end of those that begin no later than a hit: one pass over both
        spared.sort()
        out, at, reach = [], 0, -1
        for s, (e, w) in sorted(best.items()):
            while at < len(spared) and spared[at][0] <= s:
                reach = max(reach, spared[at][1])
                at += 1
            if e > reach:
                out.append((s, e, w))
        return out

    def features(self, words: list[str], automaton) -> tuple[float, float]:
        """log(1 + x) of the summed weights per 100 words, and of their sum."""
        total = sum(w for _, _, w in self.hits(words, automaton))
        return math.log1p(100.0 * total / max(1, len(words))), math.log1p(total)

    def score(self, features: tuple[float, float]) -> float:
        z = self.bias + self.slopes[0] * features[0] + self.slopes[1] * features[1]
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _patterns(words: list[str]) -> set[str]:
    distinct = set(words)
    return distinct | {w[:k] + "*" for w in distinct for k in PREFIXES if len(w) > k}


def likelihood_ratio(t: np.ndarray, f: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """G-squared of the presence of an entry in ``t`` of ``toxic`` and ``f`` of ``clean`` texts; 0 if clean texts have it more often."""
    n, share = t + f, toxic / (toxic + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 2 * (np.where(t > 0, t * np.log(t / (n * share)), 0) + np.where(f > 0, f * np.log(f / (n * (1 - share))), 0))
    return np.where(t / toxic > f / clean, out, 0.0)


def _counted(sample: DataFrame, keys_of) -> DataFrame:
    """``key, toxic, clean``: in how many texts of either label each key is; summed in bounded tables before the shuffle."""

    def flushed(found: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(found[0].keys() | found[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[0][k] for k in keys], pa.int64()), pa.array([found[1][k] for k in keys], pa.int64())], ["key", "toxic", "clean"])

    @common.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                found[1 - label].update(keys_of(fold(text.as_py() or "")))
                if len(found[0]) + len(found[1]) > COUNTED_KEYS:
                    yield flushed(found)
                    found = (Counter(), Counter())
        yield flushed(found)

    out = sample.mapInArrow(count, "key string, toxic long, clean long")
    return out.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _collected(rows: DataFrame, most: int) -> list:
    """The rows, of which there may be ``most``."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} entries: ask for more texts or a higher ratio, or allow more entries")
    return found


def _choose(rows: list, toxic: int, clean: int, least_ratio: float = LEAST_RATIO, least_rate: float = LEAST_RATE) -> dict[str, float]:
    """Weights of the entries over the least ratio.

    A beginning replaces everything under it, unless one longer entry under it has nearly all of its toxic texts: then
    the longer one says it better.
    """
    if not rows:
        return {}
    t, f = (np.array([r[k] for r in rows], float) for k in ("toxic", "clean"))
    ratio = likelihood_ratio(t, f, toxic, clean)
    weight = np.log((t + 0.5) / (toxic + 1)) - np.log((f + 0.5) / (clean + 1))
    # an entry that clean texts have too must at least be many times as frequent in toxic ones
    good = np.flatnonzero((ratio >= least_ratio) & (weight >= math.log(least_rate)))
    texts = {rows[i]["key"]: t[i] for i in good}
    beginnings = lambda key: [key[:k] + "*" for k in PREFIXES if k < len(key.rstrip("*"))]
    said_better = {p for key, n in texts.items() for p in beginnings(key) if n >= SAME_TEXTS * texts.get(p, math.inf)}
    chosen: dict[str, float] = {}
    for i in sorted(good, key=lambda i: (len(rows[i]["key"].rstrip("*")), rows[i]["key"])):
        key = rows[i]["key"]
        if key not in said_better and not any(p in chosen for p in beginnings(key)):
            chosen[key] = float(weight[i])
    return chosen


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float]]:
    """Bias and slopes of a logistic curve of two features, lightly regularised; by Newton's steps."""
    design, theta = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (p - y) + 0.01 * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), (float(theta[1]), float(theta[2]))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Written ``text, toxic`` of at most ``most_rows`` labelled documents, near copies of one label once."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    # at most ``most_rows`` ids and labels
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    @common.lean
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                least = [int(s[0]) - (1 << 63) if len(s) else 0 for s in common.shingle_sets(common.texts_of(part.column("text")))]
                yield pa.RecordBatch.from_arrays([part.column("text"), part.column("toxic"), pa.array(least, pa.int64())], ["text", "toxic", "kin"])

    rows = joined.select("text", "toxic").mapInArrow(grouped, "text string, toxic int, kin long")
    # the smallest text of each group, so a repeated task chooses alike
    return common.written(rows.groupBy("toxic", "kin").agg(F.min("text").alias("text")).select("text", "toxic"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_entries: int = MOST_ENTRIES, least_texts: int = LEAST_TEXTS, least_ratio: float = LEAST_RATIO, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learn entries, weights, exceptions and curve from the documents that ``labels`` names."""
    common.workers_can_import(docs.sparkSession)
    sample = training_rows(docs, labels, most_rows, id_col, text_col, label_col)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        common.delete(sample.sparkSession, sample)
        return Lexicon()
    counts = _counted(sample, _patterns).where((F.col("toxic") >= least_texts) & ((F.col("clean") + 0.5) * LEAST_RATE * (toxic + 1) <= (F.col("toxic") + 0.5) * (clean + 1) * (1 + 1e-9)))
    lexicon = Lexicon(_choose(_collected(counts, most_entries), toxic, clean, least_ratio))
    automaton = lexicon.automaton()

    def phrases(words: list[str]) -> set[str]:
        starts = {}
        at = 0
        for i, w in enumerate(words):
            starts[at] = i
            at += len(w) + 1
        out = set()
        for s, _, _ in lexicon.hits(words, automaton):
            i = starts[s]
            out |= {" ".join(words[a:b]) for a, b in ((i - 1, i + 1), (i, i + 2)) if a >= 0 and b <= len(words)}
        return out

    spared = _counted(sample, phrases).where("toxic = 0 and clean >= 3")
    lexicon.exceptions = frozenset(r["key"] for r in _collected(spared, most_entries))
    automaton = lexicon.automaton()

    @common.lean
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(fold(t.as_py() or ""), automaton) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64()), batch.column("toxic")], ["dense", "total", "y"])

    points = sample.mapInArrow(measured, "dense double, total double, y int").collect()  # three numbers for each of the bounded rows
    common.delete(sample.sparkSession, sample)
    points.sort()
    lexicon.bias, lexicon.slopes = _fit_curve(np.array([p[:2] for p in points]), np.array([p["y"] for p in points], float))
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, score, predicted (1 from ``threshold`` on); one text at a time leaves the Arrow batch."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    common.workers_can_import(docs.sparkSession)
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("score", DoubleType())])

    @common.lean
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [lexicon.score(lexicon.features(fold(t.as_py() or ""), automaton)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], ["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, schema)
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score under ``threshold``; rows pass through the function, nothing is added to them."""
    common.workers_can_import(docs.sparkSession)

    place = docs.columns.index(text_col)

    @common.lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            for part in common.slices(batch, place):
                low = [lexicon.score(lexicon.features(fold(t.as_py() or ""), automaton)) < threshold for t in part.column(place)]
                yield part.filter(pa.array(low, pa.bool_()))

    return common.mapped_rows(docs, keep)
