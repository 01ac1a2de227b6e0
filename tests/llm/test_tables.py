"""WARC, URL filter, top-k, the pipeline, and all SQL of the subpackage."""

import base64
import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrowlane.llm import queries, topk, toxicity, urlfilter, warc
from tests.oracle import assert_same

from .fixtures import documents, edge_rows
from .test_encoders import check_packing
from .test_text_operators import hits_by_force, judged_by_force, near_by_force, near_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, tiny):
    assert_same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, tiny)


# ---------------------------------------------------------------- WARC

def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, record string, at int").repartition(3)


def page_rows():
    big = "<p>é" + "0123456789" * 30_000
    return [(1, "http://a/1", "same"), (2, "http://a/2\r\nX: y", "same"), (3, None, "other\r\n\r\nWARC/1.1\r\n"), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", big), (7, "u", big), (None, "u", "same"), (None, None, None), (8, "ü", "x" * 70_000)]


def test_records_of_pages(spark):
    rows = page_rows()
    got = warc.write_and_read(spark, pages(spark, rows)).collect()
    newest = {}
    for i, _, h in rows:
        newest[h or ""] = max((x for x in (newest.get(h or ""), i) if x is not None), default=None)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        top = newest[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got), key=repr) == sorted(want, key=repr)
    assert warc.write_and_read(spark, pages(spark, rows).limit(0)).count() == 0


def test_chunks_carry_payloads_and_digests(spark):
    from sparrowlane.llm import common

    archives = warc.write_archives(pages(spark, page_rows()).where("page_id is not null"), common.new_path(spark, "warc"), least_bytes=10, chunk_bytes=1000)
    chunks = warc.read_archives(archives, chunk_bytes=777).collect()
    texts = {str(i): h or "" for i, _, h in page_rows() if i not in (7, None)}
    for record, text in texts.items():
        own = sorted((r for r in chunks if r["record"] == record), key=lambda r: r["chunk"])
        if own[0]["type"] == "response":
            assert all(len(r["data"]) <= 777 for r in own) and [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
            raw = b"".join(bytes(r["data"]) for r in own)
            assert raw == text.encode()
            for r in own:
                assert r["sha1"] == warc.base32(hashlib.sha1(raw[: r["at"] + len(r["data"])]).digest())
    assert {r["type"] for r in chunks if r["record"] in ("1", "2", "4", "5")} == {"response"}


# ---------------------------------------------------------------- URL filter

def test_url_filter_removes_false_positives(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MOST_BLOCKS", 1)
    monkeypatch.setattr(urlfilter.block_count, "__defaults__", (urlfilter.BITS_PER_URL, 1))
    listed = spark.createDataFrame([(f"h{i}.net/a",) for i in range(0, 400, 2)] + [(None,), ("h0.net/a",)], "url string")
    rows = [(i, f"http://www.H{i}.net/a/?q=1") for i in range(400)] + [(900, None), (901, "no scheme"), (902, "http://x.org"), (903, "http://x.org/"), (904, "ftp://EXAMPLE.org/en/12#f"), (904, "ftp://EXAMPLE.org/en/12#f"), (None, "http://h0.net/a.html"), (905, "http://notexample.org/es/")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, block string")
    got = urlfilter.judge(df, listed, queries.URL_RULES).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["verdict"] == ("allow" if i % 2 else "block") for i in range(400))
    assert (by[900]["host"], by[901]["host"], by[900]["verdict"]) == ("", "", "allow")
    assert by[902]["rule"] is None and by[903]["rule"] == "org/" and by[904]["rule"] == "example.org/en/1" and by[904]["verdict"] == "block"
    assert by[905]["rule"] == "org/" and by[None]["verdict"] == "block"
    assert urlfilter.judge(df.limit(0), listed, []).count() == 0 and urlfilter.judge(df, listed.limit(0), []).where("verdict = 'block'").count() == 0


def test_plan_of_the_url_filter_is_native(spark, tiny):
    plan = queries.op6_url_filter(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


# ---------------------------------------------------------------- top-k

def by_force(rows, asked, k):
    use = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    scaled = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in use]
    best = {}
    for i, v in scaled:
        if asked(i):
            best[i] = max(best.get(i, v), v)
    out = []
    for i, q in best.items():
        scores = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in scaled if j != i and len(v) == len(q)))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 40])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "BATCH_QUERIES", 7 if shard == 40 else 1024)
    monkeypatch.setattr(topk, "SAMPLE", 4)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(200)]
    rows += [(300 + i, rows[10][1]) for i in range(30)]  # ties
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, rows[0][1]), (10, rows[20][1]), (404, [1.0, 2.0]), (500, [3.0, 4.0]), (405, [])]
    rows += [(700, rows[40][1])] * 40  # a row that is repeated more than k times
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string").repartition(3)
    vectors = df.select("vec_id", topk.scaled(F.col("embedding")).alias("vector"), "rank")
    got = topk.top_k(vectors, vectors.where("vec_id % 10 = 0"), 10, shard_bytes=shard * 6 * 8).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == by_force(rows, lambda i: i % 10 == 0, 10)
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(16, 32)) * 100
    m = np.concatenate([(c + rng.normal(size=(128, 32))) for c in centres]).astype(np.int64)
    shard = topk.Shard(np.arange(len(m)), m)
    asked = np.arange(0, len(m), 128)
    number, ids, scores = shard.search(asked, m[::128], 10)
    assert shard.scored < len(asked) * len(shard.blocks) / 2
    whole = (m[::128] @ m.T).astype(np.int64)
    for i, q in enumerate(asked.tolist()):
        want = sorted((-s, j) for j, s in enumerate(whole[i].tolist()) if j != q)[:10]
        assert list(zip((-scores[number == i]).tolist(), ids[number == i].tolist(), strict=True)) == want
    # with the k-th scores known nothing is lost and less is scored
    before, shard.scored = shard.scored, 0
    kth = np.array([scores[number == i][-1] for i in range(len(asked))])
    again = shard.search(asked, m[::128], 10, kth)
    assert all((a == b).all() for a, b in zip(again, (number, ids, scores), strict=True)) and shard.scored <= before


def test_large_scores_are_exact():
    m = np.array([[1 << 28, 3], [1 << 28, 5], [1, 1]], np.int64)
    _, ids, scores = topk.Shard(np.array([1, 2, 3]), m).search(np.array([9]), np.array([[1 << 28, 1]], np.int64), 2)
    assert ids.tolist() == [2, 1] and scores.tolist() == [(1 << 56) + 5, (1 << 56) + 3]


# ---------------------------------------------------------------- pipeline

def test_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(14)
    rows = [(i, t, "s") for i, t in near_rows(15, 25) + [(i, t) for i, t in edge_rows() if i is not None and i > 90]]
    rows += [(5000 + i, " ".join(f"n{rng.randrange(500)}" for _ in range(40)) + " vileword" * 3, "s") for i in range(30)]
    labels = [(r[0], int(r[0] >= 5000)) for r in rows if r[0] is not None]
    docs = documents(spark, rows)
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def score(text):
        words = toxicity.fold(text or "")
        total = hits_by_force(lexicon, words)
        return lexicon.score((math.log1p(100 * total / max(1, len(words))), math.log1p(total)))

    left = [r for r in rows if score(r[1]) < 0.7]
    assert {r[0] for r in rows if r[0] and r[0] >= 5000}.isdisjoint(r[0] for r in left)
    from sparrowlane.llm.linefreq import Limits

    # no line is over the limits here, so texts stay as they are
    verdicts = judged_by_force(left, Limits())
    assert not any(v[7] for v in verdicts)
    fine = [r for r in left if judged_by_force([r], Limits())[0][8]]
    keep = {v[0] for v in near_by_force(fine) if v[3]}
    want = [r for r in fine if r[0] in keep]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_packing(got, [(str(r[0]), [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in want], 4096)


def test_stages_keep_the_columns(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert 0 < out.count() <= docs.count()
    assert len(corpus_pipeline.STAGES) == 4
