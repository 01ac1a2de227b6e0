"""Operators on literal rows: golden fixtures, edge cases, and what SQL cannot express."""

import functools
import hashlib
import math
import os
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowlane import registry
from sparrowlane.functions import text as T
from sparrowlane.functions import vector as V
from sparrowlane.operators import adapters, blocks, campaigns, fusion, gates, graph, metrics, ordering, sampling, storage, topk, windows
from sparrowlane.operators import events as E
from sparrowlane.operators import neighborhood as N
from sparrowlane.sources import collection
from sparrowlane.sources.checkpoints import Checkpoints
from sparrowlane.streaming import rollups


def one(df):
    return df.collect()[0]


def test_entry_and_queries(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_stands_without_the_subpackage(tmp_path):
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "sparrowlane"), tmp_path / "sparrowlane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'RUN-2' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


@pytest.mark.parametrize("grades, dcg, ndcg", [([1, 1, 1], 1 + 1 / math.log2(3) + 0.5, 1.0), ([0, 0], 0.0, 0.0), ([0, 1], 1 / math.log2(3), 1 / math.log2(3))])
def test_metrics(spark, grades, dcg, ndcg):
    ranks = spark.createDataFrame([(1, i + 1, i) for i in range(len(grades))], "query_id long, rank int, vec_id long")
    qrels = spark.createDataFrame([(1, i, float(g)) for i, g in enumerate(grades)], "query_id long, vec_id long, grade double")
    row = one(metrics.per_query(ranks, qrels))
    assert row["dcg"] == pytest.approx(dcg) and row["ndcg"] == pytest.approx(ndcg)


def test_rank_delta(spark):
    df = spark.createDataFrame([(1, 3), (None, 3), (2, None), (None, None)], "c int, b int")
    assert [r[0] for r in df.select(metrics.rank_delta(F.col("c"), F.col("b"))).collect()] == [-2, 999, -999, None]


def test_top_k_ties_and_zero_vectors(spark):
    corpus = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [-1.0, 0.0])], "vec_id long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (9, [0.0, 0.0])], "query_id long, q array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in topk.cosine_top_k(corpus, queries, 3).collect()}
    assert [got[0, k] for k in (1, 2, 3)] == [1, 3, 2]
    assert [got[9, k] for k in (1, 2, 3)] == [1, 2, 3]
    assert topk.cosine_top_k(corpus, queries.where("query_id > 99"), 3).count() == 0


def test_top_k_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "packed", functools.partial(blocks.packed, most=200))
    monkeypatch.setattr(topk, "SHARD_BYTES", 600)
    monkeypatch.setattr(topk, "CELLS", 20)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 8))
    corpus = spark.createDataFrame([(i, m[i].tolist()) for i in range(40)], "vec_id long, v array<double>").repartition(3)
    asked = corpus.where("vec_id < 15").toDF("query_id", "q")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = topk.cosine_top_k(corpus, asked, 4).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [int(x) for i in range(15) for x in np.argsort(-(unit[i] @ unit.T))[:4]]
    others = topk.cosine_top_k(corpus, asked, 4, own=False).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in others] == [int(x) for i in range(15) for x in np.argsort(-(unit[i] @ unit.T))[1:5]]
    stats = {r["query_id"]: (r["docs"], r["mean"], r["best"]) for r in topk.score_statistics(corpus, asked).collect()}
    assert all(stats[i] == pytest.approx((40, (unit[i] @ unit.T).mean(), 1.0)) for i in range(15))
    pairs = {(r["a"], r["b"]) for r in topk.similar_pairs(corpus, 0.3, "vec_id", "v").collect()}
    assert pairs == {(i, j) for i in range(40) for j in range(i + 1, 40) if unit[i] @ unit[j] >= 0.3}
    shards = topk.sharded_top_k(corpus.withColumn("drive", F.pmod("vec_id", F.lit(3))), asked, 4, "drive").orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in shards] == [r["vec_id"] for r in got]


def test_top_k_of_a_vector_that_is_repeated(spark):
    rows = spark.range(10_000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(-1.0)).alias("v")).repartition(5)
    rows = rows.unionByName(spark.createDataFrame([(20_000 + i, [1.0, float(i), 0.0]) for i in range(50)], "vec_id long, v array<double>"))
    asked = rows.where("vec_id % 100 = 0").toDF("query_id", "q")
    got = topk.cosine_top_k(rows, asked, 3, own=False).where("query_id < 10000").groupBy("query_id").agg(F.collect_set("vec_id").alias("s")).collect()
    assert len(got) == 100 and all(sorted(r["s"]) == [x for x in range(4) if x != r["query_id"]][:3] for r in got)


def test_rows_are_numbered_over_uneven_partitions(spark):
    big = spark.range(20_000).select((F.col("id") * 7919 % 100_003).alias("vec_id"), F.array_repeat(F.col("id").cast("double"), 64).alias("v"))
    rows = big.repartition(13).unionByName(big.limit(0)).unionByName(spark.range(200_000, 200_050).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.0), 64).alias("v")).coalesce(1))
    placed = collection.ingested(rows, 64, 100, "vec_id", "v")
    ids = sorted(r[0] for r in rows.select("vec_id").collect())
    got = sorted((r["vec_id"], r["point_id"], r["batch"]) for r in placed.select("vec_id", "point_id", "batch").collect())
    assert got == [(i, k, k // 100) for k, i in enumerate(ids)]
    assert placed.count() == len(ids) and placed.where("accepted").select(F.sum("point_id")).first()[0] == len(ids) * (len(ids) - 1) // 2


def test_consecutive_rows(spark):
    rows = spark.createDataFrame([(i * 3 % 17, float(i)) for i in range(17)], "k long, x double").repartition(4)
    got = {r["k"]: (r["x"], r["before_x"]) for r in ordering.consecutive(rows, "k", "x").collect()}
    value = {i * 3 % 17: float(i) for i in range(17)}
    assert got == {k: (value[k], value[k - 1]) for k in range(1, 17)}


def test_masks_at_the_edges(spark):
    equal = spark.createDataFrame([(1, p, 0.0, 2.0) for p in range(4)], "query_id long, pos int, mean double, var double")
    assert one(N.variance_mask(equal))["mask"] == [0.0] * 4
    rising = spark.createDataFrame([(1, p, 0.0, float(p)) for p in range(4)], "query_id long, pos int, mean double, var double")
    assert one(N.variance_mask(rising, 1.0))["mask"] == [1.0, 1.0, 1.0, 0.0]
    assert one(N.variance_mask(rising, 0.0))["mask"] == [0.0] * 4


def test_mask_flips_a_ranking(spark):
    q, good, bad = [1.0, 4.0], [1.0, 0.0], [0.0, 4.0]
    rows = spark.createDataFrame([(1, good), (2, bad)], "vec_id long, v array<double>")
    query = spark.createDataFrame([(0, q)], "query_id long, q array<double>")
    first = lambda r, s: one(topk.cosine_top_k(r, s, 1))["vec_id"]
    keep = F.array(F.lit(1.0), F.lit(0.0))
    assert first(rows, query) == 2
    assert first(rows.withColumn("v", V.masked(F.col("v"), keep)), query.withColumn("q", V.masked(F.col("q"), keep))) == 1


def test_rerank_rejects_temperature(spark):
    with pytest.raises(ValueError):
        N.rerank(spark.range(1), spark.range(1), temperature=0)


def test_decisions(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "v double, t double")
    act = lambda q, c: [r[0] for r in df.select(N.decision(F.col("v"), F.col("t"), q, c)).collect()]
    assert act(True, False) == ["FAST", "CHELATE"] and act(True, True) == ["CHELATE"] * 2
    assert act(False, True) == ["CHELATE_ALWAYS"] * 2 and act(False, False) == ["FAST"] * 2


def test_fusion_falls_back_to_the_union(spark):
    rows = spark.createDataFrame([(0, 1, 1, 10), (1, 1, 1, 11), (0, 2, 1, 10), (1, 2, 3, 10), (1, 2, 1, 12)], "variant int, query_id long, rank int, vec_id long")
    got = fusion.intersection_fusion(rows).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(1, 10, 1.0), (1, 11, 1.0), (2, 10, 0.5)]


def test_languages(spark):
    texts = ["これは日本語です", "한국어 문장", "中文句子", "Русский текст", "مرحبا بالعالم", "हिन्दी वाक्य", "ภาษาไทย", "plain words", "1234", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(T.detected_language(F.col("t"))[0]).collect()]
    assert got == ["ja", "ko", "zh", "ru", "ar", "hi", "th", "en", "en", "en"]


def test_variants_and_policies(spark):
    df = spark.createDataFrame([("the risk of Heart disease",), ("a",), ("cats",)], "q string")
    got = [[(v["strategy"], v["text"]) for v in r[0]] for r in df.select(T.variants(F.col("q"))).collect()]
    assert got[0] == [("original", "the risk of Heart disease"), ("stopword_removed", "risk heart disease"), ("focused_prefix", "risk heart")]
    assert got[1] == [("original", "a")] and got[2] == [("original", "cats")]
    f = T.lexical_features(F.col("q"))
    assert one(df.select(T.applies(f, "selective_claim_cue").alias("x")))["x"] is True
    with pytest.raises(ValueError):
        T.applies(f, "unknown")


def test_lists_and_terms(spark):
    df = spark.createDataFrame([("1. one\n2) two\n- three\n\n",), ("plain",)], "t string")
    assert [r[0] for r in df.select(T.list_items(F.col("t"))).collect()] == [["one", "two", "three"], ["plain"]]
    terms = spark.createDataFrame([("Deep-learning of the deep_sea, deep!",), ("a b",)], "t string").select(T.keyword_terms(F.col("t"))).collect()
    assert terms[0][0] == ["deep", "learning"] and terms[1][0] == ["retrieval"]


def test_decomposition_depth(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma and delta epsilon or zeta eta theta; iota kappa lambda mu")], "id long, text string")
    tree = graph.decomposition_tree(df, "id", "text", max_depth=2).collect()
    assert {r["node"] for r in tree if r["depth"] == 0} == {"0"}
    assert max(r["depth"] for r in tree) == 2 and all(r["is_leaf"] for r in tree if r["depth"] == 2)


def test_recursive_retrieval_fuses_the_leaves(spark, tiny):
    from sparrowlane.plans import language as L

    def unit(text):
        words = set(re.split(r"\s+", text.lower().replace("-", " ")))
        v = np.array(L._START)
        for keys, more in L._FAMILIES:
            v = v + np.array(more) * bool(words & set(keys))
        return tuple(v / np.linalg.norm(v))

    docs = [(r["doc_id"], unit(r["text"])) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    leaves = {}
    for r in L._trees(spark, tiny).where("is_leaf").collect():
        leaves.setdefault(tuple(r["root"]), []).append((r["node"], unit(r["text"])))
    assert any(len(x) > 1 for x in leaves.values())
    best = {q: sorted(docs, key=lambda x: (-round(float(np.dot(x[1], q)), 9), x[0]))[:10] for ls in leaves.values() for _, q in ls}
    want = []
    for root, ls in leaves.items():
        score, first = {}, {}
        for node, q in sorted(ls):
            for rank, (doc, _) in enumerate(best[q], 1):
                score[doc] = score.get(doc, 0) + 1 / (59 + rank)
                first.setdefault(doc, (node, rank))
        order = sorted(score, key=lambda x: (-round(score[x], 12), first[x]))[:10]
        want += [(*root, i, doc, round(score[doc], 6)) for i, doc in enumerate(order, 1)]
    got = [tuple(r) for r in registry.queries()["RUN-3"](spark, tiny).collect()]
    assert sorted(got) == sorted(want)


def test_judged_sample_fills_up(spark, tiny):
    corpus = spark.range(1000).withColumnRenamed("id", "doc_id")
    judged = spark.createDataFrame([(i,) for i in (3, 3, 5, 700, 5000)], "doc_id long")
    hashes = {i: int(hashlib.md5(f"{i}:7".encode()).hexdigest()[:15], 16) for i in range(1000)}
    rest = sorted((i for i in range(1000) if i not in (3, 5, 700)), key=lambda i: (hashes[i], i))
    for size in (0, 3, 4, 50, 999, 1000, 2000):
        got = sorted(r[0] for r in sampling.judged_sample(corpus, judged, size, 7, "doc_id").collect())
        assert got == sorted([3, 5, 700, *rest[: max(0, size - 3)]])
    found = {r[0] for r in registry.queries()["SAMP-1"](spark, tiny).collect()}
    ids, known = ({r[0] for r in spark.read.parquet(f"{tiny}/{t}.parquet").select("doc_id").collect()} for t in ("documents", "labels"))
    assert len(found) == len(ids) * 3 // 5 > len(ids & known) and ids & known <= found


def test_routes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "packed", functools.partial(blocks.packed, most=100))
    monkeypatch.setattr(topk, "CELLS", 16)
    rng = np.random.default_rng(2)
    m, c = rng.normal(size=(30, 4)), rng.normal(size=(9, 4))
    c[7] = c[2]  # a tie goes to the smaller route
    rows = spark.createDataFrame([(i, i % 10 if i % 11 else None, m[i].tolist()) for i in range(30)], "vec_id long, label long, v array<double>")
    routes = spark.createDataFrame([(k, c[k].tolist()) for k in range(9)], "query_id long, q array<double>").repartition(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit(m) @ unit(c).T, 12)
    for r in topk.route_scores(rows, routes).collect():
        i, label = r["id"], r["label"]
        assert r["route"] == int(s[i].argmax()) and r["score"] == s[i].max()
        assert r["log_sum"] == pytest.approx(math.log(np.exp(s[i] / 0.07).sum()))
        known = label is not None and label < 9
        assert r["own"] == (s[i, label] if known else None)
        assert r["other"] == max(x for k, x in enumerate(s[i]) if not known or k != label)
    assert topk.route_scores(rows, routes.limit(0)).where("route is not null").count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 500, 120])
def test_pair_counts_in_blocks(spark, block_bytes):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(57, 6))
    m[20:40] = m[5]  # copies of a vector
    labels = rng.integers(0, 3, 57)
    df = spark.createDataFrame([(m[i].tolist(), int(labels[i])) for i in range(57)], "v array<double>, label long").repartition(3)
    got = graph.pair_counts(df, "v", "v", "label", (0.1, 0.4, 0.8), block_bytes)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.triu_indices(57, 1)
    sims = np.clip((unit @ unit.T)[i, j], -1, 1)
    total = one(got.agg(F.sum("pairs").alias("n"), F.sum("total").alias("t"), F.max("high").alias("h"), F.min("low").alias("l"), F.sum("squares").alias("q")))
    assert total["n"] == len(sims) and total["t"] == pytest.approx(sims.sum()) and total["h"] == pytest.approx(sims.max()) and total["l"] == pytest.approx(sims.min()) and total["q"] == pytest.approx((sims**2).sum())
    same = one(got.where("label is not null").agg(F.sum("pairs").alias("n")))["n"]
    assert same == int((labels[i] == labels[j]).sum())
    bonds = {r["bond"]: r["n"] for r in got.groupBy("bond").agg(F.sum("pairs").alias("n")).collect()}
    assert bonds == {b: int(n) for b, n in zip(graph.BONDS, np.bincount(np.searchsorted((0.1, 0.4, 0.8), np.round(sims, 12), side="right"), minlength=4), strict=True) if n}


def test_median_partition_equals_recursion(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(50)], "id long, v array<double>")
    got = {}
    for r in graph.variance_median_partition(df, 5, "id", "v").collect():
        got.setdefault(r["cluster"], set()).add(r["id"])

    def split(ids, k):
        if k <= 1:
            return [set(ids)]
        x = m[ids]
        dim = int(np.argmax(x.var(axis=0)))
        cut = np.median(x[:, dim])
        left, right = [i for i in ids if m[i, dim] <= cut], [i for i in ids if m[i, dim] > cut]
        return split(left, k // 2) + split(right, k - k // 2)

    assert sorted(map(sorted, got.values())) == sorted(map(sorted, split(list(range(50)), 5)))


def _stop(losses, patience=5, relative=0.01, least=3):
    best, without = None, 0
    for epoch, x in enumerate(losses, 1):
        if epoch == 1 or (x < best and (best - x) / (abs(best) + 1e-12) >= relative):
            best, without = x, 0
        else:
            without += 1
        if epoch >= least and without >= patience:
            return epoch
    return None


def test_early_stop(spark, tiny):
    rows = registry.queries()["WIN-14"](spark, tiny).collect()
    events = spark.read.parquet(f"{tiny}/events.parquet").toPandas().sort_values(["user_id", "ts", "event_id"])
    want = {u: _stop((g["value"] / 10000).tolist()) for u, g in events.groupby("user_id")}
    assert {r["key"]: r["stopped_at"] for r in rows} == want


def test_folds(spark):
    rows = spark.createDataFrame([(k, i, x) for k in (1, 2) for i, x in enumerate([0.0004, 0.00040005, None, 0.002])], "key long, seq long, v double").repartition(3)
    assert {r["key"]: r["threshold"] for r in windows.dead_band(rows, "v", 0.0004).collect()} == {1: 0.002, 2: 0.002}
    gaps = spark.createDataFrame([(7, 0, 0.5), (7, 1, -1.0), (None, 0, 0.5)], "key long, seq long, g double")
    first = 0.9 * 0.3 + 0.1 * 0.3 / 1.5
    assert {r["key"]: r["margin"] for r in windows.margins(gaps, "g").collect()} == {7: pytest.approx(0.9 * first + 0.1), None: pytest.approx(first)}
    assert windows.dead_band(rows.limit(0), "v", 0.0004).count() == 0


def test_fold_of_a_long_series(spark):
    rows = spark.range(300_000).select(F.lit("k").alias("key"), F.col("id").alias("seq"), (F.col("id") % 7).cast("double").alias("v")).repartition(6)
    got = windows.folded(rows, lambda: (0, 0.0), lambda s, x: (s[0] + 1, s[1] * 0.5 + x), lambda s: s, "n long, mean double", "v").collect()
    want = 0.0
    for i in range(300_000):
        want = want * 0.5 + i % 7
    assert [tuple(r) for r in got] == [("k", 300_000, want)]


def test_adaptive_weight_equals_a_loop(spark, tiny):
    rows = {r["key"]: r["weight"] for r in registry.queries()["WIN-13-ADAPTIVE"](spark, tiny).collect()}
    events = spark.read.parquet(f"{tiny}/events.parquet").toPandas().sort_values(["user_id", "ts", "event_id"])
    for user, g in events.groupby("user_id"):
        weight, best, without = 0.5, math.inf, 0
        for x in (g["value"] / 10000).tolist():
            if x < best:
                weight, best, without = weight * 0.9, x, 0
            else:
                without += 1
                if without >= 5:
                    weight, without = weight * 1.1, 0
            weight = max(weight, 0.01)
        assert rows[user] == pytest.approx(weight, abs=1e-8)


def test_orthogonal_adapter_keeps_angles(spark):
    forward = adapters.orthogonal(adapters.rule_matrix(6, 6, 7), np.ones(6))
    x = np.random.default_rng(5).normal(size=(10, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(forward(x) @ forward(x).T, x @ x.T)


def test_targets_at_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [0.0, 0.0])], "v array<double>, n array<double>")
    got = [r[0] for r in df.select(adapters.homeostatic_target(F.col("v"), F.col("n"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [1.0, 0.0] and got[2] == pytest.approx([1.0, 0.0])


def test_block_graph_by_hand():
    w1 = np.array([[1, 0, 0.5], [0, 1, 0.5], [1, 0, 1], [1, 0, 1]], float)
    square = lambda m: np.pad(m, ((0, 4 - m.shape[0]), (0, 4 - m.shape[1])))
    image = storage.pack_block(square(w1), 4 * 4 * 2 + 8) + storage.pack_block(square(np.array([[1.0, 0], [0, 1], [2, -1]])), 0)
    y, blocks = storage.run_blocks(image, np.array([[1.0, -2.0, 3.0, 0.5]], np.float32), 4)
    hidden = np.maximum(np.array([1.0, -2.0, 3.0, 0.5]) @ w1, 0)
    assert blocks == 2 and y[0, :2] == pytest.approx([hidden[0] + 2 * hidden[2], hidden[1] - hidden[2]])
    with pytest.raises(ValueError):
        storage.run_blocks(image[:10], np.ones((1, 4), np.float32), 4)


def test_nearest_place(spark):
    df = spark.createDataFrame([(4,), (1,), (10,)], "n long")
    assert [r[0] for r in df.select(E.nearest_place(F.col("n"), 0.5)).collect()] == [3, 1, 5]


def test_event_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"timestamp": 1234567890.0, "action": "FAST"}\n\n{"timestamp": 1.0, "action": "ADAPT"}\n')
    assert [r["action"] for r in E.read_jsonl(spark, str(path), "timestamp double, action string").collect()] == ["FAST", "ADAPT"]
    path.write_text('{"action": "FAST"}\n\n{"action": "FAST"}\nnot json\nnor this\n')
    with pytest.raises(ValueError, match="malformed event in line 4 of .*log.jsonl"):
        E.read_jsonl(spark, str(path), "action string")
    with pytest.raises(Exception, match="malformed"):
        E.parsed_lines(spark.read.text(str(path)), "action string").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        E.read_jsonl(spark, str(tmp_path / "none"), "action string")
    assert E.recent(spark.createDataFrame([(1, None)], "event_id long, ts timestamp"), -1).count() == 0


def test_collections(spark, tmp_path):
    for bad in (None, "http:///x", "https://host/x"):
        with pytest.raises(ValueError):
            collection.open_collection(spark, bad)
    rows = spark.createDataFrame([(i, [1.0, float(i)] if i != 7 else [1.0]) for i in range(12)], "id long, v array<double>")
    got = {r["id"]: (r["point_id"], r["batch"], r["accepted"]) for r in collection.ingested(rows, 2, 5, "id", "v").collect()}
    assert got[4] == (4, 0, True) and got[7] == (7, 1, False) and got[11] == (11, 2, True)
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    news = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, x string, version int")
    assert {(r["id"], r["x"]) for r in collection.upserted(base, news, "id").collect()} == {(1, "a"), (2, "d"), (3, "e")}


def test_upserts_of_one_version_take_the_first_row_of_the_table(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from sparrowlane import registry

    def put(name, **columns):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        pq.write_table(pa.table(columns), tmp_path / name)

    put("orders.parquet", o_orderkey=list(range(12)), o_totalprice=[-1.0] * 12)
    # the second file is larger, so Spark reads it before the first; no line 2 has a price
    put("lineitem.parquet/a.parquet", l_orderkey=[*range(10), *range(5)], l_linenumber=pa.array([1] * 10 + [2] * 5, pa.int32()), l_extendedprice=[*map(float, range(10)), *[None] * 5])
    put("lineitem.parquet/b.parquet", l_orderkey=[k % 10 for k in range(20_000)], l_linenumber=pa.array([1] * 20_000, pa.int32()), l_extendedprice=[100.0 + k for k in range(20_000)])
    got = {r["k"]: r["v"] for r in registry.queries()["SRC-5"](spark, str(tmp_path)).collect()}
    assert got == {k: float(k) for k in range(10)} | {10: -1.0, 11: -1.0}
    news = spark.createDataFrame([(1, "late", 1, 9), (1, "first", 1, 2), (1, "old", 0, 1)], "id long, x string, version int, at int")
    assert [tuple(r) for r in collection.upserted(spark.createDataFrame([(1, "a")], "id long, x string"), news, "id", ("at",)).collect()] == [(1, "first")]


def test_checkpoints(spark, tmp_path):
    store = Checkpoints(spark, f"file://{tmp_path}/versions")
    assert store.names() == []
    for k in range(3):
        store.create(spark.range(k + 1), f"v{k}")
    assert store.restore("v2").count() == 3
    assert store.keep_last(2) == ["v0"] and store.names() == ["v2", "v1"]
    (next((tmp_path / "versions" / "v1").glob("*.parquet"))).unlink()
    with pytest.raises(ValueError):
        store.restore("v1")
    with pytest.raises(RuntimeError), store.guarded(spark.range(1), "v9"):
        raise RuntimeError
    assert "v9" in store.names()


def test_gates(spark):
    df = spark.createDataFrame([(1.0, 0.9, 0.0), (0.0, 0.1, 0.0), (1.0, -0.5, 0.0)], "f double, q double, b double")
    g = gates.quantization_gate(F.col("f"), F.col("q"), F.col("b"))
    got = df.select(g["passed"].alias("p"), g["retained_ratio"].alias("r"), g["reasons"].alias("why")).collect()
    assert [r["p"] for r in got] == [True, False, False] and got[1]["r"] == 1.0
    assert got[2]["why"] == ["retained_gain_below_threshold", "quantized_fitness_below_baseline"]
    with pytest.raises(ValueError):
        graph.bond(F.lit(0.1), (0.5, 0.4, 0.9))


def test_streams(spark, tiny, tmp_path):
    schema = spark.read.parquet(f"{tiny}/events.parquet").schema
    source = tmp_path / "in"
    spark.read.parquet(f"{tiny}/events.parquet").repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = rollups.tumbling(stream, "1 day").writeStream.format("memory").queryName("days").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from (select start, event_type, max(n) n from days group by 1, 2)").first()[0] == 1000
    q = rollups.adaptive_thresholds(stream.withColumn("value", F.col("value") / 10000)).writeStream.format("memory").queryName("limits").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from (select key, max(n) n from limits group by key)").first()[0] == 1000
    rollups.upsert_batches(stream, lambda df, n: df.select("event_id"), str(tmp_path / "c3"), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


def test_logistic_fit(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 2))
    rows = [(float(a), float(b), float(a - b > 0)) for a, b in x]
    w, _ = adapters.fit_logistic(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y")
    assert w[0] > 0.5 and w[1] < -0.5
    with pytest.raises(ValueError):
        adapters.fit_logistic(spark.range(9).selectExpr("id a", "id y"), ["a"], "y", most_rows=3)
    with pytest.raises(ValueError):
        adapters.create("unknown")


def test_collections_from_texts(spark):
    texts = spark.createDataFrame([(1, "aaaa"), (2, "b" * 12), (3, None), (4, "c" * 40)], "id long, text string")
    got = {r["id"]: (r["sent"], r["vector"]) for r in collection.embedded(texts, "text", (20, 10, 5), lambda t: F.octet_length(t) <= 10, lambda t: F.array(F.length(t).cast("double")), 1).collect()}
    assert got == {1: ("aaaa", [4.0]), 2: ("b" * 10, [10.0]), 3: (None, [0.0]), 4: ("c" * 10, [10.0])}
    refused = collection.embedded(texts, "text", (20,), lambda t: F.octet_length(t) <= 10, lambda t: F.array(F.lit(1.0)), 1)
    assert {r["id"]: r["vector"] for r in refused.collect()}[2] == [0.0]
    with pytest.raises(Exception, match="no text for id 3"):
        collection.refreshed(texts, "text", "id", F.array(F.length("text").cast("double"))).collect()
    teachers = spark.createDataFrame([("en", "a", 4, 0.0), ("de", "b", 8, 0.0)], "lang string, teacher string, dim int, shift double")
    spoken = spark.createDataFrame([(1, "en"), (2, "de"), (3, "xx")], "id long, lang string")
    with pytest.raises(ValueError, match="dimensions"):
        collection.routed(spoken, teachers, "lang", ("c", 4, 0.0))
    assert collection.routed(spoken.where("id <> 2"), teachers, "lang", ("c", 4, 0.0)).count() == 2


def test_languages_of_other_scripts(spark):
    texts = {"ja": "これは日本語です", "zh": "\U00020000\U00020001\U000200FF 中文", "ko": "한국어 텍스트", "ru": "русский текст"}
    df = spark.createDataFrame(list(texts.items()), "want string, text string")
    assert all(r["want"] == r["got"] for r in df.select("want", T.detected_language(F.col("text"))[0].alias("got")).collect())


def _scripts_of(text):
    """Language and confidence by a plain loop over the characters."""
    import re

    n = {k: len(re.findall("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), v) + "]", text or "")) for k, v in T.SCRIPTS.items()}
    total = sum(n.values())
    japanese = n["kana"] + n["cjk"]
    if not total:
        return "en", 0.0
    if n["kana"] and japanese / total > 0.3:
        found = "ja", japanese / total
    elif n["hangul"] / total > 0.3:
        found = "ko", n["hangul"] / total
    elif not n["kana"] and n["cjk"] / total > 0.3:
        found = "zh", n["cjk"] / total
    else:
        named = {"ru": "cyrillic", "ar": "arabic", "hi": "devanagari", "th": "thai"}
        found = next(((k, n[v] / total) for k, v in named.items() if n[v] / total > 0.3), None)
        found = found or (("en", n["latin"] / total * 0.6) if n["latin"] / total > 0.5 else ("en", 0.0))
    return (found[0] if found[1] >= 0.5 else "en"), found[1]


def _mixed_texts(n=400):
    import random

    draw = random.Random(7)
    pools = ["abcXYZéü", " \n.,-", "0123", "漢字一龥", "\U00020000\U0002a6df", "ひらカナー", "한글ᄀㄱ", "Жизнь", "سلامݐ", "हिन्दी", "ไทย", "\U0001f600✓’—", "×÷ƒɏɐʰαβ", "ϿЀӿԀ〿぀ヿ"]
    mixed = ["".join(draw.choice(draw.choice(few)) for _ in range(draw.randint(1, 40))) for few in (draw.sample(pools, draw.randint(1, 4)) for _ in range(n))]
    return [None, "", " 12 ", "plain", "naïve café", "’—", *mixed]


def _times(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_language_histogram_counts_each_script_once(spark, tmp_path):
    from collections import Counter

    from sparrowlane import registry

    texts = _mixed_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["AGG-27"](spark, str(tmp_path))
    assert _times(got, "regexp_replace") <= len(T.SCRIPTS)
    assert {r["language"]: r["n"] for r in got.collect()} == Counter(_scripts_of(t)[0] for t in texts)


def test_detected_languages_read_each_text_once(spark, tmp_path):
    from sparrowlane import registry

    texts = _mixed_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["STR-7"](spark, str(tmp_path))
    assert _times(got, "regexp_replace") <= len(T.SCRIPTS) and _times(got, "RLIKE") <= 2
    rows = {r["doc_id"]: (r["language"], r["confidence"]) for r in got.collect()}
    assert rows == {i: (language, pytest.approx(confidence, abs=1e-6)) for i, (language, confidence) in enumerate(map(_scripts_of, texts))}


def test_presets_and_read_api(spark, tiny):
    from sparrowlane.functions.presets import PRESETS, preset
    from sparrowlane.sources.api import ReadApi

    assert len(PRESETS) == 19 and preset("balanced")["chelation_p"] == 85
    for bad in (("balanced", "none"), ("none", "chelation")):
        with pytest.raises(ValueError):
            preset(*bad)
    api = ReadApi({"events": spark.read.parquet(f"{tiny}/events.parquet")}, token="t")
    assert api.get("/api/events", "Bearer t", 5).count() == 5
    with pytest.raises(PermissionError):
        api.get("/api/events", "Bearer x")
    with pytest.raises(KeyError):
        api.get("/api/none", "Bearer t")


def test_query_windows(spark):
    rows = spark.range(10).withColumnRenamed("id", "q")
    assert sorted(r["q"] for r in sampling.query_slice(rows, "q", 3, 4, exact=True).collect()) == [3, 4, 5, 6]
    with pytest.raises(ValueError):
        sampling.query_slice(rows, "q", 8, 4, exact=True)
    got = {r["q"]: r["window"] for r in campaigns.windows_of(rows, "q", 3, offset=2).collect()}
    assert got == {q: (q - 2) // 3 for q in range(2, 10)}


def test_campaigns_go_on_where_they_stopped(spark, tmp_path):
    store, calls = Checkpoints(spark, f"file://{tmp_path}/runs"), []
    windows_ = campaigns.windows_of(spark.range(10).withColumnRenamed("id", "q"), "q", 3)

    def evaluate(open_):
        calls.append(sorted({r["window"] for r in open_.collect()}))
        return open_.groupBy("window").agg(F.sum("q").alias("s"))

    assert campaigns.resumed(windows_, evaluate, store, most=2).count() == 2
    for _ in range(2):
        assert {r["window"]: r["s"] for r in campaigns.resumed(windows_, evaluate, store).collect()} == {0: 3, 1: 12, 2: 21, 3: 9}
    assert calls == [[0, 1], [2, 3]]


def test_intermediates(spark):
    from types import SimpleNamespace

    from sparrowlane import session

    small = session.written(spark.range(1000, numPartitions=200), "many")
    assert small.count() == 1000 and len(small.inputFiles()) <= session.file_count(spark.range(1))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert any(x.startswith("sparrowlane-many-") for x in os.listdir(folder))
    session.clean(spark)
    assert not any(x.startswith("sparrowlane-") for x in os.listdir(folder))
    # off local mode a folder of the driver's machine is no shared one
    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", environment={}))
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(cluster)
