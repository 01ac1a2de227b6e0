"""Exact sub-word encoding by segments.

A text may be cut where no match of the tokenizers' split patterns can reach over, none of which looks behind: before a
single space or around a single line feed whose neighbours are no white space, and between an ASCII letter and a
punctuation mark that starts no contraction and is in no special token.  So the ids of the text are the ids of its
segments in order.  Segments repeat far more often than texts.  Arrow finds the distinct ones of a batch, a memo of
bounded size keeps what a worker has encoded, and only unknown segments go to the library, in batches of about equal
bytes.  Long texts are spread over many batches by the same cuts.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMO_BYTES = 64 << 20
ENTRY_BYTES = 200  # of Python objects and table for an entry, besides its bytes
BATCH_BYTES = 1 << 18
_SPACE, _LINE_FEED = 0x20, 0x0A
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[list(b".,;:!?)")] = True
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes of all characters beyond ASCII that are white space somewhere: a cut next to such a byte is left out.
_LEADS_WHITE = np.zeros(256, bool)
_LEADS_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Segments of all texts in order (views of the same bytes), and offsets: text i has ``offsets[i]`` up to the next."""
    starts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    low, high = int(starts[0]), int(starts[-1])
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None else np.empty(0, np.uint8)
    cut = np.zeros(len(raw) + 1, bool)
    at = np.flatnonzero((raw == _SPACE) | (raw == _LINE_FEED))
    at = at[(at > 0) & (at < len(raw) - 1)]
    before, after = raw[at - 1], raw[at + 1]
    safe = ~_ASCII_WHITE[before] & ~_ASCII_WHITE[after] & ~_LEADS_WHITE[after]
    safe &= (before < 0x80) | ~(_LEADS_WHITE[raw[np.maximum(at - 2, 0)]] | _LEADS_WHITE[raw[np.maximum(at - 3, 0)]])
    at = at[safe]
    cut[at] = True
    cut[at[raw[at] == _LINE_FEED] + 1] = True
    cut[1:-1] |= _LETTER[raw[:-1]] & _MARK[raw[1:]]
    # the start of a text is a cut of its own; empty texts have no segment
    cut[starts[:-1] - low] = True
    cut[len(raw)] = False
    cuts = np.flatnonzero(cut)
    offsets = np.searchsorted(cuts, starts - low)
    bounds = np.append(cuts, high - low).astype(np.int32)
    if not len(cuts):
        return pa.array([], pa.string()), offsets
    out = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
    return out, offsets


def byte_batches(texts: Iterable[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches that hold about ``most`` UTF-8 bytes each; a longer text is a batch by itself."""
    batch, held = [], 0
    for text in texts:
        size = len(text.encode())
        if batch and held + size > most:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += size
    if batch:
        yield batch


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class SegmentMemo:
    """What ``encode`` makes of segments: a bytes value for each text of a list.

    Two generations hold at most about ``most`` bytes: when the young one has half of them it becomes the old one, which
    is dropped then; what is used again moves to the young one, so frequent segments stay.  A segment that alone is more
    than a hundredth of that is not kept.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = MEMO_BYTES):
        self.encode, self.most, self.held = encode, most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _keep(self, text: str, value: bytes) -> None:
        self.young[text] = value
        self.held += ENTRY_BYTES + len(text) + len(value)

    def of_distinct(self, texts: list[str]) -> list[bytes]:
        """What ``encode`` makes of distinct texts."""
        if self.held > self.most // 2:
            self.young, self.old, self.held = {}, self.young, 0
        out = [self.young.get(x) for x in texts]
        unknown = []
        for i, value in enumerate(out):
            if value is None:
                text = texts[i]
                value = out[i] = self.old.get(text)
                if value is None:
                    unknown.append(text)
                else:
                    self._keep(text, value)
        found = iter([x for batch in byte_batches(unknown) for x in self._encoded(batch)])
        return [next(found) if v is None else v for v in out] if unknown else out

    def _encoded(self, batch: list[str]) -> list[bytes]:
        values = self.encode(batch)
        for text, value in zip(batch, values, strict=True):
            if len(text) + len(value) <= self.most // 100:
                self._keep(text, value)
        return values

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The 32-bit ids of all texts in order, and offsets: text i has ``offsets[i]`` up to the next."""
        parts, offsets = segments(texts)
        if not len(parts):
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        coded = parts.dictionary_encode()
        values = self.of_distinct(coded.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(values), "<u4")
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool_starts = np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy(zero_copy_only=False)
        own = lengths[codes]
        ends = np.cumsum(own)
        gather = np.arange(ends[-1]) + np.repeat(pool_starts[codes] - (ends - own), own)
        return pool[gather], np.concatenate(([0], ends))[offsets]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        parts, offsets = segments(texts)
        if not len(parts):
            return np.zeros(len(texts), np.int64)
        coded = parts.dictionary_encode()
        values = self.of_distinct(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ends = np.concatenate(([0], np.cumsum(lengths[coded.indices.to_numpy(zero_copy_only=False)])))
        return np.diff(ends[offsets])


@lru_cache(maxsize=4)
def hf_tokenizer(path: str):
    """The tokenizer of a ``.json`` file, without truncation or padding."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=4)
def hf_memo(path: str, most: int = MEMO_BYTES) -> SegmentMemo:
    tokenizer = hf_tokenizer(path)
    return SegmentMemo(lambda texts: [packed_ids(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], most)
