"""Columns of clashing names, repeated rows, and a text of a million words, through every operator and stage."""

import os
import random
import shutil
import subprocess
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrowlane.llm import bbit, bytebpe, kneserney, linefreq, packing, tokencount, topk, toxicity, urlfilter, warc

from .fixtures import words

CLASHING = ["kept_id", "kept_hash", "__host", "__text_hash", "__removed", "id", "host", "text_hash", "removed", "row", "node", "component", "component_id", "kin", "toxic", "score", "kept", "copies", "n", "label", "part", "block", "group", "deal", "a.b", "vector"]


def clashing(df):
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    rng = random.Random(21)
    rows = [(i, " ".join([*words(rng, 40, 900), *(["vileword"] if i % 4 == 0 else [])]), "ab"[i % 2]) for i in range(120)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, str(path)


def test_stages_with_clashing_columns_and_repeated_rows(spark, labelled):
    rows, path = labelled
    plain = docs_of(spark, rows)
    docs = clashing(plain)
    for name, stage in corpus_pipeline.STAGES:
        wide, narrow = stage(spark, docs, path), stage(spark, plain, path)
        if name == "packing":
            assert wide.count() == narrow.count() == plain.count()
            continue
        assert wide.columns == docs.columns and [f.dataType for f in wide.schema] == [f.dataType for f in docs.schema]
        assert sorted(r["doc_id"] for r in wide.select("doc_id").collect()) == sorted(r["doc_id"] for r in narrow.select("doc_id").collect())
        values = wide.select(*(f"`{c}`" for c in CLASHING)).distinct().collect()
        assert [tuple(r) for r in values] == [tuple(range(len(CLASHING)))]
        twice = stage(spark, docs.unionByName(docs), path)
        assert twice.count() == wide.count() * (1 if name == "near_duplicates" else 2), name


def test_stages_of_empty_tables(spark, labelled):
    rows, path = labelled
    docs = clashing(docs_of(spark, rows)).limit(0)
    assert all(stage(spark, docs, path).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_operators_with_clashing_columns(spark):
    rng = random.Random(22)
    rows = [(i, " ".join(words(rng, 30)), "s") for i in range(20)] + [(30, None, None), (None, "x y", "s")]
    docs = clashing(docs_of(spark, rows))
    model = kneserney.train(docs)
    out = [linefreq.judged(docs), bbit.near_duplicates(docs), tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")), toxicity.scored(docs, toxicity.Lexicon({"w1": 1.0})), kneserney.score(docs, model), packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")), bytebpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)]
    assert all(x.count() == len(rows) for x in out)
    pages = clashing(spark.createDataFrame([(i, f"http://h{i}/p", f"<p>{i % 3}") for i in range(9)], "page_id long, url string, html string")).drop("n", "kept")
    assert warc.write_and_read(spark, pages).count() == 9
    assert urlfilter.judge(pages, spark.createDataFrame([("h1/p",)], "url string"), []).where("verdict = 'block'").count() == 1
    vectors = clashing(spark.createDataFrame([(i, [i, 1]) for i in range(12)], "vec_id long, v array<bigint>")).withColumn("vector", F.col("v"))
    assert topk.top_k(vectors, vectors.where("vec_id = 0"), 3).count() == 3


def test_a_text_of_a_million_words(spark):
    rng = random.Random(23)
    text = "\n".join(" ".join(words(rng, 20, 5000)) for _ in range(50_000))
    docs = docs_of(spark, [(1, text, "s"), (2, "short text", "s"), (3, text, "s")])
    lexicon = toxicity.Lexicon({"w1*": 1.0, "w22": 2.0}, frozenset({"w1 w2"}))
    judged = {r["doc_id"]: r for r in linefreq.judged(docs).collect()}
    assert judged[1]["n_words"] == 1_000_000 and judged[1]["kept"]
    near = {r["doc_id"]: r["component_id"] for r in bbit.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 1}
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(docs, lexicon).collect())
    counts = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counts[1] == counts[3] > 1_000_000
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).where("doc_id = 1")
    assert pieces.where("length = 4096").count() >= pieces.count() - 1
    digests = {r["doc_id"]: r["decoded_sha256"] for r in bytebpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    assert digests[1] == digests[3]
    model = kneserney.train(docs, order=3)
    assert {r["doc_id"]: r["n_tokens"] for r in kneserney.score(docs, model).collect()}[1] == 1_000_001
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r["page_id"]: r["payload_bytes"] for r in warc.write_and_read(spark, pages).collect()}[3] == len(text)


def test_the_other_queries_load_without_a_library_of_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("sparrowlane", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(root, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'RUN-2' in q and not any(x.startswith('op') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
