"""Interpolated modified Kneser-Ney model of order two or three, counted in Spark, for log10 probabilities and perplexity.

A text is its words (A-Z lower-cased) and one end; the first word follows a begin mark.  Words, pairs and triples of words
are known by 64-bit hashes.

Counting: each task sums the n-grams of its texts and packs them into one block for each of ``parts`` parts, so the shuffle
moves sorted arrays, not a row per n-gram.  In order three the part of a triple is that of its middle word: its task then
has all contexts (pairs that triples begin with) and all pairs (that triples end with) of the word.  It writes triples,
contexts (count and numbers of successors seen once, twice, more often) and pairs (number of distinct predecessors), and
sends each word's shares (as a pair's second word: count and number of distinct predecessors; as its first: numbers of
successors seen once, twice, more often) to the word's part, whose task merges and writes them sorted by hash.  Frequent
words (a share of 1 / ``parts`` and more in a sample; only where work is done depends on it) are spread: triples by their
first two words, so contexts stay whole, and their pairs go on to a part by both words.  Only the list of files, the
frequent words (``parts`` at most) and the counts of counts reach the driver.

Triples are counted in ``PASSES`` passes over the texts, each for its share of the parts, so only that share is ever in
the shuffle; what a step hands to the next is a written table, and a step's shuffle files go when it ends.  Order two
counts pairs in one pass.

Keys of pairs and triples are kept as sorted hashes of 32 bits in buckets of two to four keys: a bucket's number, from the
leading bits of the hash, is where its keys lie and is not stored.  A key of a file of n is known by log2(n) + 30 bits.

The arrays lie in the shared folder and workers map them into memory, so a worker holds no copy and reads what it needs
(from a store that cannot be mapped it reads files by need and holds ``READ_BYTES`` of them at most); a batch's distinct words and pairs are looked up in hash order.  Files have names of their own for each task attempt and
only a successful attempt's are listed.

Probability of word w after v: p2(w|v) = (max(c(v,w) - D(c), 0) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) p1(w)) / c(v), and
p1(w) = max(a(w) - D'(a), 0) / A + g / (V + 1), with a(w) the number of distinct predecessors, A their sum and g the mass
that the discounts D' set free; an unknown word has the last term alone, and after an unknown v it is p1(w).  In order
three it is the same formula over triples, with p2 in the place of p1, and p2 itself after an unknown pair; the c of p2 are
then numbers of distinct predecessors, c(v) their sum.  Nothing precedes the begin mark: pairs that start with it keep
their counts, and a first word has p2.  Discounts of each order are estimated from counts of counts; where these are too few, 0.5, 1 and 1.5 stand in.

Null texts count as empty: their end follows the begin mark.  A null id counts as the empty text for the split.  Repeated
rows count each.  Very long texts are counted and scored whole, in slices of rows.  An empty table gives no rows.  Other
columns are not read, so their names cannot clash.  Without training texts every word is unknown: N = V = 0 and a token's probability is 1 (its base too).
"""

from __future__ import annotations

import functools
import mmap
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import open_fs
from . import common

BEGIN = common.mix(np.array([0xB361], np.uint64))[0]
END = common.mix(np.array([0xE17D], np.uint64))[0]
START = common.mix(np.array([0x57A7], np.uint64))[0]  # in the place before BEGIN
FLUSH_TOKENS = 2 << 20
PART_BYTES = 4 << 20  # of input for each part
MOST_PARTS = 1 << 18
PASSES = 2
SCORED_BYTES = 4 << 20  # of texts scored together: every part of the model is asked once for them
SAMPLE = 16  # of rows, one is looked at for frequent words
BUCKET_KEYS = 4
READ_BYTES = 256 << 20  # of arrays that a worker holds where the store cannot be mapped


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of the token before each, and offsets: text i has ``offsets[i]`` up to the next."""
    words, offsets = common.word_hashes(texts)
    n = len(texts)
    offsets = offsets + np.arange(n + 1)
    tokens = np.empty(len(words) + n, np.uint64)
    ends = offsets[1:] - 1
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    tokens[is_word] = words
    tokens[ends] = END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = BEGIN
    return before, tokens, offsets


def word_before(before: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The token before each of ``before``: START where that is BEGIN."""
    earlier = np.empty_like(before)
    earlier[1:] = before[:-1]
    earlier[offsets[:-1]] = START
    return earlier


def pair_hash(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return common.mix(before * common.MULTIPLIER + tokens)


def _range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    bits = parts.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _is_one_of(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Whether each word is among the sorted ``frequent``."""
    if not len(frequent):
        return np.zeros(len(words), bool)
    return frequent[np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)] == words


def pair_part(before: np.ndarray, tokens: np.ndarray, frequent: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair: its first word's; by both words where that is frequent; its second word's at a text's begin."""
    part = _range_of(common.mix(before), parts)
    hot = _is_one_of(before, frequent)
    part[hot] = _range_of(pair_hash(before[hot], tokens[hot]), parts)
    first = before == BEGIN
    part[first] = _range_of(common.mix(tokens[first]), parts)
    return part


def triple_part(earlier: np.ndarray, before: np.ndarray, tokens: np.ndarray, frequent: np.ndarray, parts: int) -> np.ndarray:
    """The part of each triple: its middle word's; by the first two words where that is frequent; its last word's at a text's begin."""
    part = _range_of(common.mix(before), parts)
    hot = _is_one_of(before, frequent)
    part[hot] = _range_of(pair_hash(earlier[hot], before[hot]), parts)
    first = earlier == START
    part[first] = _range_of(common.mix(tokens[first]), parts)
    return part


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in their smallest unsigned types, self-describing and compressed."""
    small = [a if a.dtype == np.uint64 else a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in arrays]
    head = np.array([len(small), *(x for a in small for x in (a.itemsize, len(a)))], np.int64)
    plain = head.tobytes() + b"".join(a.tobytes() for a in small)
    return np.int64(len(plain)).tobytes() + pa.compress(plain, codec="zstd", asbytes=True)


def _unpack(block: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(block, np.int64, 1)[0])
    block = pa.decompress(memoryview(block)[8:], size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(block, np.int64, 1)[0])
    head = np.frombuffer(block, np.int64, 1 + 2 * n)[1:]
    at, out = 8 * (1 + 2 * n), []
    for k in range(n):
        size, length = int(head[2 * k]), int(head[2 * k + 1])
        out.append(np.frombuffer(block, f"u{size}", length, at))
        at += size * length
    return out


def bucketed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes as the starts of their buckets and the 32 bits after the bucket's."""
    bits = max(0, (len(keys) // BUCKET_KEYS).bit_length())
    at = np.searchsorted(_bucket(keys, bits), np.arange((1 << bits) + 1)).astype(np.uint32)
    return at, _rest(keys, bits)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _rest(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(32 - bits)).astype(np.uint32)


def places(at: np.ndarray, rest: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted hash is among bucketed keys, and whether it is there; all hashes halve their bucket together."""
    bits = (len(at) - 1).bit_length() - 1
    bucket, target = _bucket(wanted, bits), _rest(wanted, bits)
    low, high = at[bucket].astype(np.int32), at[bucket + 1].astype(np.int32)
    end = high
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (rest.take(middle, mode="clip") < target) & (low < high)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    return low, (low < end) & (rest.take(low, mode="clip") == target)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of the values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.insert(keys[1:] != keys[:-1], 0, True))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def _pair_blocks(part: np.ndarray, before: np.ndarray, tokens: np.ndarray, parts: int, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One block for each part: runs of first words, second words by a dictionary, sums of ``values`` (of ones without any)."""
    # equal pairs become neighbours; the few that do not are summed later
    bits = np.uint64(24)
    order = np.argsort((before >> (np.uint64(64) - bits) << (np.uint64(64) - bits)) | (pair_hash(before, tokens) >> bits))
    order = order[np.argsort(part[order].astype(np.uint32), kind="stable")]
    part, before, tokens = part[order], before[order], tokens[order]
    first = np.flatnonzero(np.insert((before[1:] != before[:-1]) | (tokens[1:] != tokens[:-1]) | (part[1:] != part[:-1]), 0, True))
    sums = [np.add.reduceat(x[order], first) for x in values] or [np.diff(np.append(first, len(before)))]
    part, before, tokens = part[first], before[first], tokens[first]
    bounds = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        own = slice(bounds[p], bounds[p + 1])
        v, w = before[own], tokens[own]
        runs = np.flatnonzero(np.insert(v[1:] != v[:-1], 0, True))
        words, codes = np.unique(w, return_inverse=True)
        yield p, _pack(v[runs], np.diff(np.append(runs, len(v))), words, codes, *(x[own] for x in sums))


def _triple_blocks(part: np.ndarray, earlier: np.ndarray, before: np.ndarray, tokens: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """One block for each part: runs of first two words and last words, all by a dictionary, and counts."""
    context = pair_hash(earlier, before)
    bits = np.uint64(32)
    order = np.argsort((context >> bits << bits) | (pair_hash(context, tokens) >> bits))
    order = order[np.argsort(part[order].astype(np.uint32), kind="stable")]
    part, context, tokens, earlier, before = part[order], context[order], tokens[order], earlier[order], before[order]
    first = np.flatnonzero(np.insert((context[1:] != context[:-1]) | (tokens[1:] != tokens[:-1]) | (part[1:] != part[:-1]), 0, True))
    counts = np.diff(np.append(first, len(part)))
    part, context, tokens, earlier, before = part[first], context[first], tokens[first], earlier[first], before[first]
    bounds = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        own = slice(bounds[p], bounds[p + 1])
        c = context[own]
        runs = np.flatnonzero(np.insert(c[1:] != c[:-1], 0, True))
        words, codes = np.unique(np.concatenate((earlier[own][runs], before[own][runs], tokens[own])), return_inverse=True)
        n = len(runs)
        yield p, _pack(words, codes[:n], codes[n : 2 * n], np.diff(np.append(runs, len(c))), codes[2 * n :], counts[own])


def _write(folder: str, arrays: list[np.ndarray]) -> tuple[str, str]:
    """A file of the arrays one after another, and their types and lengths."""
    fs, inner = open_fs(folder)
    name = f"{inner}/{uuid.uuid4().hex}.arrays"
    with fs.open_output_stream(name, compression=None) as out:
        for a in arrays:
            out.write(a.tobytes())
    return name, ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays)


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _write_counted(folder: str, keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[str, str]:
    """A file of sorted keys: those of count 1 alone, then the others with their values."""
    one = counts == 1
    return _write(folder, [*bucketed(keys[one]), *bucketed(keys[~one]), *(_small(x[~one]) for x in (counts, *more))])


def _count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class Model:
    """Files and totals of a counted model; the arrays stay in the shared folder."""

    folder: str
    parts: int
    order: int = 2
    triples: dict[int, tuple[str, str, int]] = field(default_factory=dict)
    contexts: dict[int, tuple[str, str, int]] = field(default_factory=dict)
    pairs: dict[int, tuple[str, str, int]] = field(default_factory=dict)
    spread_pairs: dict[int, tuple[str, str, int]] = field(default_factory=dict)
    words: dict[int, tuple[str, str, int]] = field(default_factory=dict)
    frequent: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    tokens: int = 0
    types: int = 0
    predecessors: int = 0
    triple_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    pair_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    free_mass: float = 1.0

    def mapped(self) -> MappedModel:
        """The arrays; a worker keeps the mappings of the model that it used last."""
        if self.folder not in _MAPPED:
            _MAPPED.clear()
            _MAPPED[self.folder] = MappedModel(self)
        return _MAPPED[self.folder]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts, or 0.5, 1, 1.5 where they give none."""
    if all(n):
        y = n[0] / (n[0] + 2 * n[1])
        found = tuple(k + 1 - (k + 2) * y * n[k + 1] / n[k] if k else 1 - 2 * y * n[1] / n[0] for k in range(3))
        if all(0 < d <= k + 1 for k, d in enumerate(found)):
            return found
    return 0.5, 1.0, 1.5


def default_parts(df: DataFrame) -> int:
    """A power of two after the size of the input in Spark's plan; beyond a terabyte the parts grow instead of their number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_PARTS, 1 << max(4, (max(1, size // PART_BYTES) - 1).bit_length()))


def frequent_words(texts: DataFrame, text_col: str, parts: int) -> np.ndarray:
    """Sorted hashes of words that have a share of 1 / ``parts`` in a sample of the rows.

    Nothing but the part that counts a word depends on it, so a sample will do, and a task may keep to what is frequent there.
    """

    @common.lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for piece in common.slices(batch, "text"):
                own, n = np.unique(common.word_hashes(common.texts_of(piece.column("text")))[0], return_counts=True)
                words, counts = _sums(np.concatenate((words, own)), np.concatenate((counts, n)))
        total = int(counts.sum())
        often = counts * 4 * parts >= total
        yield pa.RecordBatch.from_arrays([pa.array([None, *words[often].view(np.int64).tolist()], pa.int64()), pa.array([total, *counts[often].tolist()], pa.int64())], ["word", "n"])

    rows = texts.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    sums = rows.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = sums.where("word is null").first()
    found = sums.where("word is not null").where(F.col("n") * parts >= (total["n"] if total else 0)).select("word").collect()  # ``parts`` at most
    return np.sort(np.array([r["word"] for r in found], np.int64).view(np.uint64))


def train(texts: DataFrame, text_col: str = "text", parts: int | None = None, order: int = 2) -> Model:
    """Count the texts and write the arrays of the model of ``order`` two or three."""
    if order not in (2, 3):
        raise ValueError(f"order {order} is neither 2 nor 3")
    spark = texts.sparkSession
    common.workers_can_import(spark)
    parts = parts or default_parts(texts)
    folder = common.new_path(spark, "ngrams")
    fs, inner = open_fs(folder)
    fs.create_dir(inner)

    frequent = frequent_words(texts, text_col, parts)

    def counted(own: int, passes: int) -> DataFrame:
        """``part, block`` of the parts of pass ``own``."""

        @common.lean
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []
            for batch in batches:
                for piece in common.slices(batch, "text"):
                    before, tokens, offsets = token_stream(common.texts_of(piece.column("text")))
                    grams = (before, tokens) if order == 2 else (word_before(before, offsets), before, tokens)
                    part = (pair_part if order == 2 else triple_part)(*grams, frequent, parts)
                    grams = (part, *grams)
                    if passes > 1:
                        mine = part % passes == own
                        grams = tuple(x[mine] for x in grams)
                    held.append(grams)
                    if sum(len(x[-1]) for x in held) >= FLUSH_TOKENS:
                        yield flushed(held)
                        held = []
            if any(len(x[-1]) for x in held):
                yield flushed(held)

        return texts.select(F.col(text_col).alias("text")).mapInArrow(count, "part int, block binary")

    def flushed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        blocks = list((_pair_blocks if order == 2 else _triple_blocks)(*(np.concatenate(x) for x in zip(*held, strict=True)), parts))
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], ["part", "block"])

    # kind: b is a block of pairs of frequent words, s and f are blocks of words as second and first of pairs; t, c, p, h
    # and w name files of triples, contexts, pairs, pairs of frequent words, and words
    schema = "part int, kind string, block binary, path string, types string, n long, counts array<long>"
    names = ["part", "kind", "block", "path", "types", "n", "counts"]
    types = [pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]

    def table_of(rows: list[tuple]) -> pa.Table:
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows, strict=True), types, strict=True)})

    def merge_triples(key: tuple, table: pa.Table) -> pa.Table:
        u, v, w, c = [], [], [], []
        for block in table.column("block").to_pylist():
            words, firsts, seconds, lengths, codes, counts = _unpack(block)
            lengths = lengths.astype(np.int64)
            u.append(np.repeat(words[firsts], lengths))
            v.append(np.repeat(words[seconds], lengths))
            w.append(words[codes])
            c.append(counts.astype(np.int64))
        u, v, w, c = (np.concatenate(x) for x in (u, v, w, c))
        h = pair_hash(pair_hash(u, v), w)
        at = np.argsort(h)
        first = np.flatnonzero(np.insert(h[at][1:] != h[at][:-1], 0, True))
        c = np.add.reduceat(c[at], first)
        u, v, w, h = (x[at][first] for x in (u, v, w, h))
        real = u != START
        rows = []
        if real.any():
            seen = c[real]
            path, dtypes = _write_counted(folder, h[real], seen)
            rows.append((key[0].as_py(), "t", None, path, dtypes, len(seen), _count_of_counts(seen)))
            found = _sums(pair_hash(u[real], v[real]), seen, *(m.astype(np.int64) for m in (seen == 1, seen == 2, seen > 2)))
            path, dtypes = _write_counted(folder, *found)
            rows.append((key[0].as_py(), "c", None, path, dtypes, len(found[0]), None))
        seen = np.where(real, 1, c)
        hot = real & _is_one_of(v, frequent)
        if not hot.all():
            rows += pair_rows(key[0].as_py(), "p", *(x[~hot] for x in (v, w, seen, c)))
        if hot.any():
            v, w, seen, c = (x[hot] for x in (v, w, seen, c))
            rows += [(q, "b", block, None, None, 0, None) for q, block in _pair_blocks(pair_part(v, w, frequent, parts), v, w, parts, seen, c)]
        return table_of(rows)

    def pair_rows(part: int, kind: str, v: np.ndarray, w: np.ndarray, c: np.ndarray, n: np.ndarray) -> list[tuple]:
        """The file of the pairs of a part, all of them, and the shares of their words; ``n`` is how often a pair occurs."""
        h = pair_hash(v, w)
        at = np.argsort(h)
        first = np.flatnonzero(np.insert(h[at][1:] != h[at][:-1], 0, True))
        c, n = np.add.reduceat(c[at], first), np.add.reduceat(n[at], first)
        v, w, h = v[at][first], w[at][first], h[at][first]
        path, dtypes = _write_counted(folder, h, c)
        rows = [(part, kind, None, path, dtypes, len(h), _count_of_counts(c))]
        as_second = _sums(w, n, np.ones_like(n))
        as_first = _sums(v, *((m).astype(np.int64) for m in (c == 1, c == 2, c > 2)), c)
        for name, (words, *values) in (("s", as_second), ("f", as_first)):
            ranges = _range_of(words, parts)
            bounds = np.searchsorted(ranges, np.arange(parts + 1))
            rows += [(q, name, _pack(words[bounds[q] : bounds[q + 1]], *(x[bounds[q] : bounds[q + 1]] for x in values)), None, None, 0, None) for q in np.flatnonzero(np.diff(bounds)).tolist()]
        return rows

    def merge_pairs(key: tuple, table: pa.Table) -> pa.Table:
        v, w, c, n = [], [], [], []
        for block in table.column("block").to_pylist():
            runs, lengths, words, codes, *counts = _unpack(block)
            v.append(np.repeat(runs, lengths.astype(np.int64)))
            w.append(words[codes])
            c.append(counts[0].astype(np.int64))
            n.append(counts[-1].astype(np.int64))
        return table_of(pair_rows(key[0].as_py(), "p" if order == 2 else "h", *(np.concatenate(x) for x in (v, w, c, n))))

    def merge_words(key: tuple, table: pa.Table) -> pa.Table:
        rows, merged = [], {}
        for kind, width in (("s", 2), ("f", 4)):
            blocks = [_unpack(b) for b in table.filter(pc.equal(table.column("kind"), kind)).column("block").to_pylist()]
            parted = [np.concatenate([b[k].astype(np.uint64 if not k else np.int64) for b in blocks]) if blocks else np.empty(0, np.uint64 if not k else np.int64) for k in range(width + 1)]
            merged[kind] = _sums(*parted)
        words = np.union1d(merged["s"][0], merged["f"][0])
        columns = []
        for kind in ("s", "f"):
            at = np.searchsorted(words, merged[kind][0])
            for values in merged[kind][1:]:
                column = np.zeros(len(words), np.int64)
                column[at] = values
                columns.append(column)
        if len(words):
            small = [c.astype(np.min_scalar_type(int(c.max()))) for c in columns]
            path, dtypes = _write(folder, [words, *small])
            c, a = columns[0], columns[1]
            rows.append((key[0].as_py(), "w", None, path, dtypes, len(words), [*_count_of_counts(a), int(c.sum()), int((c > 0).sum()), int(a.sum()), int((a > 2).sum())]))
        return table_of(rows)

    files: list = []

    def step(blocks: DataFrame, merge, name: str) -> DataFrame:
        """The written rows of a step; what it names as files is collected, at most two rows for each part."""
        done = common.written(blocks.groupBy("part").applyInArrow(merge, schema), name)
        files.extend(done.where("path is not null").drop("block").collect())
        return done

    with common.short_shuffles(spark):
        tables = [step(counted(k, PASSES), merge_triples, "ngram-triples") for k in range(PASSES)] if order == 3 else []
        spread = functools.reduce(DataFrame.unionByName, tables).where("kind = 'b'").select("part", "block") if tables else counted(0, 1)
        tables.append(step(spread, merge_pairs, "ngram-pairs"))
        shares = functools.reduce(DataFrame.unionByName, tables).where("kind in ('s', 'f')").select("part", "kind", "block")
        tables.append(step(shares, merge_words, "ngram-words"))
        common.delete(spark, *tables)
    model = Model(folder, parts, order, frequent=frequent)
    for row in files:
        {"t": model.triples, "c": model.contexts, "p": model.pairs, "h": model.spread_pairs, "w": model.words}[row["kind"]][row["part"]] = (row["path"], row["types"], row["n"])
    of_triples, of_pairs = ([sum(r["counts"][k] for r in files if r["kind"] in kinds) for k in range(4)] for kinds in ("t", "ph"))
    of_words = [sum(r["counts"][k] for r in files if r["kind"] == "w") for k in range(8)]
    model.tokens, model.types, model.predecessors = of_words[4:7]
    model.triple_discounts, model.pair_discounts, model.word_discounts = discounts(of_triples), discounts(of_pairs), discounts(of_words[:4])
    if model.predecessors:
        d = model.word_discounts
        model.free_mass = (d[0] * of_words[0] + d[1] * of_words[1] + d[2] * of_words[7]) / model.predecessors
    return model


_MAPPED: dict[str, MappedModel] = {}


class MappedModel:
    """The arrays of a model, mapped from the shared folder."""

    def __init__(self, model: Model, mappable: bool | None = None):
        self.m = model
        self.mappable = model.folder.startswith("file:") if mappable is None else mappable
        self.open: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def _arrays(self, entry: tuple[str, str, int]) -> list[np.ndarray]:
        path, dtypes, _ = entry
        if path not in self.open:
            if self.mappable:
                with open(path, "rb") as source:
                    raw = mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ)
            else:  # files are read by need and the oldest go, so memory is bounded
                with open_fs(self.m.folder)[0].open_input_file(path) as source:
                    raw = source.read_buffer()
                self.held += len(raw)
                while self.open and self.held > READ_BYTES:
                    gone = self.open.pop(next(iter(self.open)))
                    self.held -= sum(a.nbytes for a in gone)
            out, at = [], 0
            for dtype, _, n in (x.partition(":") for x in dtypes.split(",")):
                out.append(np.frombuffer(raw, dtype, int(n), at))
                at += np.dtype(dtype).itemsize * int(n)
            self.open[path] = out
        return self.open[path]

    def _looked_up(self, files: dict, hashes: np.ndarray, part: np.ndarray, ones: tuple[int, ...]) -> list[np.ndarray]:
        """Values of hashes; ``part`` is sorted; ``ones`` for keys of count 1, 0 where unknown."""
        out = [np.zeros(len(hashes), np.int64) for _ in ones]
        bounds = np.searchsorted(part, np.arange(self.m.parts + 1))
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            if p in files:
                one_at, one_rest, at, rest, *values = self._arrays(files[p])
                own = slice(bounds[p], bounds[p + 1])
                wanted = hashes[own]
                if len(rest):
                    place, known = places(at, rest, wanted)
                    for o, v in zip(out, values, strict=True):
                        o[own][known] = v[place[known]]
                if len(one_rest):
                    _, known = places(one_at, one_rest, wanted)
                    for o, value in zip(out, ones, strict=True):
                        o[own][known] = value
        return out

    def _of_words(self, distinct: np.ndarray) -> list[np.ndarray]:
        """Values of sorted distinct word hashes, from files of whole hashes."""
        out = [np.zeros(len(distinct), np.int64) for _ in range(6)]
        bounds = np.searchsorted(_range_of(distinct, self.m.parts), np.arange(self.m.parts + 1))
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            if p in self.m.words:
                keys, *values = self._arrays(self.m.words[p])
                own = slice(bounds[p], bounds[p + 1])
                at = np.minimum(np.searchsorted(keys, distinct[own]), len(keys) - 1)
                known = keys[at] == distinct[own]
                for o, v in zip(out, values, strict=True):
                    o[own] = np.where(known, v[at], 0)
        return out

    def words(self, distinct: np.ndarray) -> list[np.ndarray]:
        """Count, predecessors, successors seen once, twice, more often, and sum of these, of sorted distinct word hashes."""
        return self._of_words(distinct)

    def _of_each(self, files: dict, h: np.ndarray, part: np.ndarray, ones: tuple[int, ...]) -> list[np.ndarray]:
        """Values of hashes in any order, each distinct one looked up once."""
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.insert(h[1:] != h[:-1], 0, True))
        part = part[order][first]
        by_part = np.argsort(part.astype(np.uint32), kind="stable")
        lengths = np.diff(np.append(first, len(h)))
        columns = []
        for values in self._looked_up(files, h[first][by_part], part[by_part], ones):
            found, out = np.empty(len(first), np.int64), np.empty(len(h), np.int64)
            found[by_part] = values
            out[order] = np.repeat(found, lengths)
            columns.append(out)
        return columns

    def pairs(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Counts of pairs, or in order three their numbers of predecessors."""
        h, part = pair_hash(before, tokens), pair_part(before, tokens, self.m.frequent, self.m.parts)
        if self.m.order == 2:
            return self._of_each(self.m.pairs, h, part, (1,))[0]
        out = np.zeros(len(h), np.int64)
        hot = _is_one_of(before, self.m.frequent)
        for files, own in ((self.m.pairs, ~hot), (self.m.spread_pairs, hot)):
            if own.any():
                out[own] = self._of_each(files, h[own], part[own], (1,))[0]
        return out

    def probabilities(self, before: np.ndarray, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each token after those before it in its text, and its count in training."""
        m = self.m
        distinct, code = np.unique(np.append(tokens, BEGIN), return_inverse=True)
        count, distinct_before, n1, n2, n3, total = self.words(distinct)
        own, ahead = code[:-1], np.empty(len(tokens), np.int64)
        ahead[1:] = own[:-1]
        ahead[offsets[:-1]] = code[-1]
        unseen = m.free_mass / (m.types + 1)
        p = ((distinct_before - _discount(distinct_before, m.word_discounts)) / max(1, m.predecessors) + unseen)[own]
        p = _interpolated(self.pairs(before, tokens), total[ahead], [n[ahead] for n in (n1, n2, n3)], m.pair_discounts, p)
        if m.order == 3:
            earlier = word_before(before, offsets)
            context, part = pair_hash(earlier, before), triple_part(earlier, before, tokens, m.frequent, m.parts)
            total, *seen = self._of_each(m.contexts, context, part, (1, 1, 0, 0))
            p = _interpolated(self._of_each(m.triples, pair_hash(context, tokens), part, (1,))[0], total, seen, m.triple_discounts, p)
        return p, count[own]


def _interpolated(counts: np.ndarray, total: np.ndarray, seen: list[np.ndarray], d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """Discounted share of ``counts`` in ``total``, and the mass set free by ``lower``; ``lower`` where nothing was counted."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (counts - _discount(counts, d) + (d[0] * seen[0] + d[1] * seen[1] + d[2] * seen[2]) * lower) / total
    return np.where(total > 0, p, lower)


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, n_known, train_tokens, base_score, score of each row's whole text (log10)."""
    common.workers_can_import(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    @common.lean
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = model.mapped()
        for batch in batches:
            for piece in common.slices(batch, "text", SCORED_BYTES):
                before, tokens, offsets = token_stream(common.texts_of(piece.column("text")))
                p, count = mapped.probabilities(before, tokens, offsets)
                base = np.log10((count + 1) / (model.tokens + model.types + 1))
                at = offsets[:-1]
                columns = [pa.array(np.diff(offsets)), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))]
                yield pa.RecordBatch.from_arrays([piece.column("id"), *columns], ["id", "n_tokens", "n_known", "base_score", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scored, f"id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
