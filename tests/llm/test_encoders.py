"""Token counts, byte-level BPE and packing against the libraries, text by text."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparrowlane.llm import bytebpe, packing, segments, tokencount

from .fixtures import documents, edge_rows

GPT = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = [chr(c) for c in range(32, 0x3100, 7)] + list("  \n\t\r\x1c\x1d\x85\xa0　  'sSltd09aaa.,!    ") * 12 + ["🙂", "한", "<|endoftext|>", "é", "İ", "Σ"]


def random_texts(n, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)] + ["".join(rng.choice("aAb- =") for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("path", [GPT, WORDS])
def test_segments_give_the_ids_of_whole_texts(path):
    texts = random_texts(1500)
    ids, at = segments.hf_memo(path).ids(pa.array(texts))
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in whole]


def test_memo_of_bounded_size():
    sizes = [np.array([1], "<u4").tobytes()]
    memo = segments.SegmentMemo(lambda t: [sizes[0] for _ in t], most=2 * 6 * (segments.ENTRY_BYTES + 6) - 1)
    assert memo.counts(pa.array(["a b c d e f", "a b", ""])).tolist() == [6, 2, 0]
    assert len(memo.young) == 6
    assert memo.counts(pa.array(["b", "zz yy"])).tolist() == [1, 2] and memo.counts(pa.array(["zz c"])).tolist() == [2]
    assert len(memo.young) + len(memo.old) <= 14 and memo.held <= memo.most
    for i in range(200):  # more segments than it holds
        assert memo.counts(pa.array([" ".join(f"s{i}x{k}" for k in range(5))])).tolist() == [5]
        assert len(memo.young) + len(memo.old) <= 24


def test_segments_too_long_to_keep():
    memo = segments.SegmentMemo(lambda t: [b"1234" * len(x) for x in t], most=5000)
    assert memo.counts(pa.array(["x" * 3000, "ab", "x" * 3000])).tolist() == [3000, 2, 3000]
    assert list(memo.young) == ["ab"]


def test_slices_of_arrays_keep_their_bytes():
    whole = pa.array(["left out", "ab cd. ef", None, "g"])
    part = pa.concat_arrays([whole.slice(1).fill_null("")])
    got, at = segments.segments(part)
    assert got.to_pylist() == ["ab", " cd", ".", " ef", "g"] and at.tolist() == [0, 4, 4, 5]


def test_token_counts(spark):
    rows = edge_rows()
    got = tokencount.token_counts(documents(spark, rows, extra="clash"), GPT).collect()
    tok = Tokenizer.from_file(GPT)
    want = sorted((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert tokencount.token_counts(documents(spark, rows).limit(0), GPT).count() == 0


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = edge_rows()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokencount.token_counts(documents(spark, rows), path).collect())
    assert got == sorted((str(i), len(sp.encode(t or ""))) for i, t, *_ in rows)


def test_byte_bpe_equals_rank_encoder(tik):
    texts = random_texts(1500, 3) + [f"a{chr(c)} {chr(c)}1" for c in range(0x20, 0x3000, 5)]
    bpe = bytebpe.byte_bpe(RANKS, public_tokenizers.PATTERN)
    for text, ids in zip(texts, bpe.encode_batch(pa.array(texts)), strict=True):
        assert ids == tik.encode_ordinary(text), ascii(text)
        assert bpe.decode(ids) == text.encode()


def test_byte_bpe_offsets_and_split_characters(tik):
    bpe = bytebpe.byte_bpe(RANKS, public_tokenizers.PATTERN)
    text = "é 🙂x 日́"
    ids = next(iter(bpe.encode_batch(pa.array([text]))))
    spans = bpe.offsets(text, ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for i, (a, b) in zip(ids, spans, strict=True):
        assert bpe.table[i] in text[a:b].encode()
    assert len(bpe.decode(ids[:-1])) < len(text.encode())


def test_byte_bpe_frames(spark, tik):
    rows = edge_rows()
    df = documents(spark, rows, extra="clash")
    pattern = public_tokenizers.PATTERN
    digests = bytebpe.round_trip_digests(df, RANKS, pattern).collect()
    of = lambda t: tik.encode_ordinary(t or "")
    want = sorted((str(i), len(of(t)), hashlib.sha256(",".join(map(str, of(t))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in digests) == want
    encoded = bytebpe.encode(df.where("doc_id in (1, 10)"), RANKS, pattern)
    back = {r["doc_id"]: r["text"] for r in bytebpe.decode(encoded, RANKS, pattern).collect()}
    texts = dict((i, t) for i, t, *_ in rows)
    assert back == {1: texts[1], 10: texts[10]}
    assert bytebpe.encode(df.limit(0), RANKS, pattern).count() == 0


def test_sum_of_squares_chooses_the_smallest_sum():
    rng = random.Random(1)
    packer = packing.SumOfSquares(20)
    for _ in range(300):
        size = rng.randrange(1, 21)
        n = packer.open.copy()
        options = {}
        for gap in [g for g in range(size, 20) if n[g]] + [20]:
            after = n.copy()
            if gap < 20:
                after[gap] -= 1
            if gap > size:
                after[gap - size] += 1
            options[gap] = int((after**2).sum())
        assert options[packer.choose(size)] == min(options.values())
        packer.place(size)


def first_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        for k, used in enumerate(bins):
            if used + x <= capacity:
                bins[k] += x
                break
        else:
            bins.append(x)
    return len(bins)


def check_packing(rows, want, capacity):
    """``want``: sorted (id, ids) of all documents."""
    pieces = []
    for doc, ids in want:
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            pieces.append((doc, k // capacity, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(pieces)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), [p[3] for p in pieces]


@pytest.mark.parametrize("capacity, group", [(4096, 8192), (64, 5)])
def test_packing(spark, capacity, group):
    rows = edge_rows()
    tok = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(documents(spark, rows, extra="clash"), WORDS, capacity=capacity, group_pieces=group).collect()
    used, lengths = check_packing(got, [(str(i), [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows], capacity)
    if group > 100:
        assert used <= first_fit(lengths, capacity)
    assert packing.pack_documents(documents(spark, rows).limit(0), WORDS).count() == 0


def test_packing_is_tight():
    rng = np.random.default_rng(7)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 3000).astype(int) + 1)
    bins, _ = packing.pack_lengths(lengths)
    assert bins.max() + 1 <= first_fit(lengths.tolist(), 4096) + 1
