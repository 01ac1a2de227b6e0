"""Queries: vectors, top-k, masks, metrics, fusion, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V
from ..operators import adapters as A
from ..operators import fusion, metrics, storage
from ..operators import neighborhood as N
from ..operators.topk import cosine_top_k, ranked, route_scores, score_statistics, sharded_top_k
from ..registry import query
from . import base as B
from .base import r6, sql
from .base import r6_sql as R


def _digest(rows: DataFrame, col: str) -> DataFrame:
    """vec_id with norm, sum and weighted sum of a vector: one line per vector."""
    place = F.aggregate(F.transform(col, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", r6(V.norm(F.col(col))).alias("norm"), r6(V.total(F.col(col))).alias("total"), r6(place).alias("weighted"))


def _digest_sql(ctes: str, source: str, e: str) -> str:
    return sql(ctes, f"""SELECT vec_id, {R('sqrt(list_inner_product(y, y))')} AS norm, {R('list_sum(y)')} AS total,
      {R('list_sum(list_transform(y, lambda x, i: x * i))')} AS weighted FROM (SELECT vec_id, {e} AS y FROM {source})""")


WITH_CENTROID = f"{B.QUERIES}, paired AS (SELECT c.vec_id, c.label, c.v, q.q FROM corpus c JOIN centroids q ON c.label = q.query_id)"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    rows = B.corpus(spark, d)
    return rows.join(B.centroids(rows).withColumnRenamed("query_id", "label"), "label")


@query("VEC-1", sql(WITH_CENTROID, f"SELECT vec_id, label, {R('list_cosine_similarity(v, q)')} AS cosine FROM paired"))
def cosine_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).select("vec_id", "label", r6(V.cosine(F.col("v"), F.col("q"))).alias("cosine"))


@query("VEC-2", _digest_sql(B.CORPUS, "corpus", "list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12::DOUBLE))"))
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _digest(V.with_unit(B.corpus(spark, d), "v", "y"), "y")


@query("VEC-3", sql(B.QUERIES, f"SELECT a.query_id AS a, b.query_id AS b, {R('least(greatest(list_cosine_similarity(a.q, b.q), -1.0::DOUBLE), 1.0::DOUBLE)')} AS similarity FROM centroids a JOIN centroids b ON true"))
def centroid_matrix(spark: SparkSession, d: str) -> DataFrame:
    q = B.centroids(B.corpus(spark, d))
    n = q.count()
    found = cosine_top_k(q.select(F.col("query_id").alias("b"), F.col("q").alias("v")), q, max(1, n), "b")
    return found.select(F.col("query_id").alias("a"), "b", r6(F.least(F.greatest("score", F.lit(-1.0)), F.lit(1.0))).alias("similarity"))


@query("VEC-4", _digest_sql(B.CORPUS, "corpus", "list_transform(v, lambda x, i: x * CASE WHEN i % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)"))
def masked_vectors(spark: SparkSession, d: str) -> DataFrame:
    mask = F.transform("v", lambda _, i: F.when((i + 1) % 3 == 0, 0.0).otherwise(1.0))
    return _digest(B.corpus(spark, d).withColumn("y", V.masked(F.col("v"), mask)), "y")


@query("VEC-5", _digest_sql(WITH_CENTROID, "paired", "list_transform(list_zip(v, q), lambda z: z[1] - z[2])"))
def centred_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_paired(spark, d).withColumn("y", V.subtract(F.col("v"), F.col("q"))), "y")


@query("VEC-6", sql(f"{B.CORPUS}, {B.DIMS}, scale AS (SELECT quantile_cont(abs(x), 0.99) AS reference FROM dims)", f"""SELECT vec_id,
  sum(CASE WHEN reference <= 1e-12 THEN 0 ELSE least(greatest(round_even(x / (reference / 127), 0), -127), 127) END)::BIGINT AS levels,
  {R('sum(abs(CASE WHEN reference <= 1e-12 THEN 0 ELSE least(greatest(round_even(x / (reference / 127), 0), -127), 127) * (reference / 127) END - x))')} AS error
  FROM dims CROSS JOIN scale GROUP BY vec_id"""))
def int8_simulation(spark: SparkSession, d: str) -> DataFrame:
    dims = V.exploded(B.corpus(spark, d), "v", "vec_id")
    reference = F.broadcast(dims.agg(F.percentile(F.abs("x"), F.lit(0.99)).alias("reference")))
    level = F.when(F.col("reference") <= 1e-12, 0.0).otherwise(F.least(F.greatest(F.rint(F.col("x") / (F.col("reference") / 127)), F.lit(-127.0)), F.lit(127.0)))
    rows = dims.crossJoin(reference).withColumn("level", level)
    return rows.groupBy("vec_id").agg(F.sum("level").cast("long").alias("levels"), r6(F.sum(F.abs(F.col("level") * (F.col("reference") / 127) - F.col("x")))).alias("error"))


def _w(i: str, j: str, seed: int) -> str:
    return f"(((31 * {i} + 17 * {j} + {seed}) % 23 - 11)::DOUBLE / 40.0::DOUBLE)"


def _matvec(x: str, rows: int, seed: int) -> str:
    """W x with the rule's weights, W of ``rows`` rows."""
    return f"list_transform(range(0, {rows}), lambda i: list_sum(list_transform({x}, lambda e, j: e * {_w('i', '(j - 1)', seed)})))"


@query("VEC-7", _digest_sql(B.CORPUS, "corpus", _matvec("v", 16, 5)))
def projection(spark: SparkSession, d: str) -> DataFrame:
    return _digest(A.applied(B.corpus(spark, d), A.projection(A.rule_matrix(16, 64, 5)), "v", "y", "vec_id"), "y")


_MLP = f"hidden AS (SELECT vec_id, v, list_transform({_matvec('v', 8, 1)}, lambda e, i: greatest(e + {_w('(i - 1)', '0', 3)}, 0.0::DOUBLE)) AS h FROM corpus), moved AS (SELECT vec_id, list_transform(list_zip(v, {_matvec('h', 64, 2)}), lambda z, i: z[1] + z[2] + {_w('(i - 1)', '0', 4)}) AS y FROM hidden)"


@query("VEC-8", _digest_sql(f"{B.CORPUS}, {_MLP}", "moved", "list_transform(y, lambda x: x / greatest(sqrt(list_inner_product(y, y)), 1e-12::DOUBLE))"))
def mlp_adapter(spark: SparkSession, d: str) -> DataFrame:
    forward = A.mlp(A.rule_matrix(8, 64, 1), A.rule_matrix(8, 1, 3)[:, 0], A.rule_matrix(64, 8, 2), A.rule_matrix(64, 1, 4)[:, 0])
    return _digest(A.applied(B.corpus(spark, d), forward, "v", "y", "vec_id"), "y")


@query("VEC-9")
def orthogonal_adapter(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: the weights need a linear solve; the test checks that lengths and angles stay."""
    import numpy as np

    return _digest(A.applied(B.corpus(spark, d), A.orthogonal(A.rule_matrix(64, 64, 7), np.ones(64)), "v", "y", "vec_id"), "y")


_LOW = f"inner_part AS (SELECT vec_id, v, list_transform(range(0, 4), lambda r: list_sum(list_transform(v, lambda e, i: e * {_w('(i - 1)', 'r', 8)}))) AS h FROM corpus), moved AS (SELECT vec_id, v, list_transform(list_zip(v, {_matvec('h', 64, 9)}), lambda z, i: z[1] + z[2] + {_w('(i - 1)', '0', 6)}) AS y FROM inner_part)"


def _low_rank():
    return A.low_rank(A.rule_matrix(64, 4, 8), A.rule_matrix(64, 4, 9), A.rule_matrix(64, 1, 6)[:, 0])


@query("VEC-10", _digest_sql(f"{B.CORPUS}, {_LOW}", "moved", "list_transform(y, lambda x: x / greatest(sqrt(list_inner_product(y, y)), 1e-12::DOUBLE))"))
def low_rank_adapter(spark: SparkSession, d: str) -> DataFrame:
    return _digest(A.applied(B.corpus(spark, d), _low_rank(), "v", "y", "vec_id"), "y")


_BOUNDED = f"unit_part AS (SELECT vec_id, v, list_transform(y, lambda x: x / greatest(sqrt(list_inner_product(y, y)), 1e-12::DOUBLE)) AS y FROM moved), sized AS (SELECT vec_id, v, y, list_distance(v, y) AS n FROM unit_part), factored AS (SELECT *, CASE WHEN n < 0.01 AND n > 1e-10 THEN 0.01::DOUBLE / n WHEN n > 0.5 THEN 0.5::DOUBLE / n ELSE 1.0::DOUBLE END AS f FROM sized)"


@query("VEC-11", _digest_sql(f"{B.CORPUS}, {_LOW}, {_BOUNDED}", "factored", "list_transform(list_zip(v, y), lambda z: z[1] + (z[2] - z[1]) * f)"))
def bounded_adapter(spark: SparkSession, d: str) -> DataFrame:
    rows = A.applied(B.corpus(spark, d), _low_rank(), "v", "moved", "vec_id", "v")
    return _digest(rows.withColumn("y", A.bounded(F.col("v"), F.col("moved"))), "y")


_TARGET = f"{WITH_CENTROID}, pushed AS (SELECT vec_id, list_transform(list_zip(v, q), lambda z: z[1] + (z[1] - z[2]) / list_distance(v, q) * 0.1::DOUBLE) AS t FROM paired)"


@query("VEC-13", _digest_sql(_TARGET, "pushed", "list_transform(t, lambda x: x / sqrt(list_inner_product(t, t)))"))
def homeostatic_targets(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_paired(spark, d).withColumn("y", A.homeostatic_target(F.col("v"), F.col("q"))), "y")


_BLEND = f"{WITH_CENTROID}, mixed AS (SELECT vec_id, list_transform(list_zip(v, q), lambda z: 0.7::DOUBLE * z[1] + 0.3::DOUBLE * z[2]) AS t FROM paired)"


@query("VEC-14", _digest_sql(_BLEND, "mixed", "list_transform(t, lambda x: x / greatest(sqrt(list_inner_product(t, t)), 1e-9::DOUBLE))"))
def distillation_blend(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_paired(spark, d).withColumn("y", A.blend(F.col("v"), F.col("q"), 0.3)), "y")


@query("VEC-15", _digest_sql(WITH_CENTROID, "paired", "list_transform(list_zip(v, q), lambda z: z[1] * 2.0::DOUBLE / 5.0::DOUBLE + z[2] * 3.0::DOUBLE / 5.0::DOUBLE)"))
def teacher_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Two teachers, the vector and its centroid, of weights 2 and 3 normalised to one."""
    rows = _paired(spark, d)
    teachers = V.exploded(rows, "v", "vec_id").select("vec_id", "pos", (F.col("x") * 2.0 / 5.0).alias("x")).unionByName(V.exploded(rows, "q", "vec_id").select("vec_id", "pos", (F.col("x") * 3.0 / 5.0).alias("x")))
    return _digest(V.assembled(teachers.groupBy("vec_id", "pos").agg(F.sum("x").alias("s")), "s", "y", "vec_id"), "y")


@query("VEC-16", sql(WITH_CENTROID, f"SELECT {R('coalesce(avg(list_inner_product(v, q) / ((sqrt(list_inner_product(v, v)) + 1e-9) * (sqrt(list_inner_product(q, q)) + 1e-9))), 0)')} AS alignment, count(*) AS pairs FROM paired"))
def alignment(spark: SparkSession, d: str) -> DataFrame:
    v, q = F.col("v"), F.col("q")
    row = V.dot(v, q) / ((V.norm(v) + 1e-9) * (V.norm(q) + 1e-9))
    return _paired(spark, d).agg(r6(F.coalesce(F.avg(row), F.lit(0.0))).alias("alignment"), F.count("*").alias("pairs"))


_PREDICTOR = f"{B.TO_STATS}, features AS (SELECT query_id, list_concat(list(mean ORDER BY pos), list(var ORDER BY pos)) AS f FROM stats GROUP BY query_id), hid AS (SELECT query_id, list_transform({_matvec('f', 16, 11)}, lambda e: greatest(e, 0.0::DOUBLE)) AS h FROM features), outs AS (SELECT query_id, list_transform({_matvec('h', 64, 12)}, lambda e: 1 / (1 + exp(-e))) AS s FROM hid)"


@query("VEC-18", sql(_PREDICTOR, f"SELECT query_id, len(list_filter(s, lambda e: e >= 0.5))::BIGINT AS kept, {R('list_sum(s)')} AS total FROM outs"))
def learned_mask(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    stats = N.dimension_stats(B.scout(spark, d)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "var"))).alias("r"))
    features = stats.select("query_id", F.concat(F.transform("r", lambda x: x["mean"]), F.transform("r", lambda x: x["var"])).alias("f"))
    w1, w2 = A.rule_matrix(16, 128, 11), A.rule_matrix(64, 16, 12)
    scores = A.applied(features, lambda x: 1 / (1 + np.exp(-(np.maximum(x @ w1.T, 0) @ w2.T))), "f", "s", "query_id")
    return scores.select("query_id", F.size(F.filter("s", lambda e: e >= 0.5)).cast("long").alias("kept"), r6(V.total(F.col("s"))).alias("total"))


# ---------------------------------------------------------------- top-k

@query("TOPK-1", sql(B.TO_SCOUT, f"SELECT query_id, rank::INTEGER AS rank, vec_id, {R('score')} AS score FROM scout"))
def scout_top_k(spark: SparkSession, d: str) -> DataFrame:
    return B.search(B.corpus(spark, d), B.SCOUT_K).select("query_id", "rank", "vec_id", r6("score").alias("score"))


_MASK = "list_transform({0}, lambda x, i: x * CASE WHEN i % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)"


@query("TOPK-2", sql(B.QUERIES, f"SELECT query_id, vec_id, {R('score')} AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, list_cosine_similarity({_MASK.format('v')}, {_MASK.format('q')}) AS score FROM corpus CROSS JOIN queries WHERE vec_id <> query_id)) WHERE rank <= 10"))
def masked_top_k(spark: SparkSession, d: str) -> DataFrame:
    on = lambda c: F.transform(c, lambda x, i: x * F.when((i + 1) % 3 == 0, 0.0).otherwise(1.0))
    rows = B.corpus(spark, d)
    found = cosine_top_k(rows.withColumn("v", on("v")), B.queries(rows).withColumn("q", on("q")), B.RESULT_K, own=False)
    return found.select("query_id", "vec_id", r6("score").alias("score"), "rank")


@query("TOPK-3", sql(B.TO_SCOUT, f"SELECT query_id, {R('max(CASE WHEN rank = 1 THEN score END)')} AS top, {R('max(CASE WHEN rank = 2 THEN score END)')} AS second, {R('coalesce(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 0)')} AS margin FROM scout GROUP BY query_id"))
def score_details(spark: SparkSession, d: str) -> DataFrame:
    top = B.search(B.corpus(spark, d), 2)
    first, second = (F.max(F.when(F.col("rank") == k, F.col("score"))) for k in (1, 2))
    return top.groupBy("query_id").agg(r6(first).alias("top"), r6(second).alias("second"), r6(F.coalesce(first - second, F.lit(0.0))).alias("margin"))


@query("TOPK-4", sql(f"{B.TO_STATS}, {B.RERANKED}", f"SELECT query_id, vec_id, rank::INTEGER AS scout_rank, new_rank::INTEGER AS rank, {R('new_score')} AS score FROM masked"))
def centred_masked_rerank(spark: SparkSession, d: str) -> DataFrame:
    return B.reranked(B.scout(spark, d)).select("query_id", "vec_id", F.col("rank").alias("scout_rank"), F.col("new_rank").alias("rank"), r6("new_score").alias("score"))


@query("TOPK-5", sql(f"{B.TO_STATS}, {B.RERANKED}", f"SELECT query_id, vec_id, new_rank::INTEGER AS rank, {R('new_score / 0.5')} AS score FROM masked WHERE new_rank <= 10"))
def temperature(spark: SparkSession, d: str) -> DataFrame:
    hits = B.scout(spark, d)
    rows = N.rerank(hits, N.variance_mask(N.dimension_stats(hits)), temperature=0.5)
    return rows.where("new_rank <= 10").select("query_id", "vec_id", F.col("new_rank").alias("rank"), r6("new_score").alias("score"))


@query("TOPK-6", sql(B.SERIES, "SELECT key, event_id, rank::INTEGER AS rank FROM (SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY round(v, 3) DESC, event_id) AS rank FROM series) WHERE rank <= 10"))
def tie_aware_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Scores rounded so that many tie; the smaller id wins."""
    return ranked(B.series(spark, d), 10, ["key"], F.round("v", 3).desc(), "event_id").select("key", "event_id", "rank")


@query("TOPK-7", sql(f"{B.TO_SCOUT}, loads AS (SELECT vec_id % 4 AS shard, count(*) AS depth FROM corpus GROUP BY 1)", f"SELECT query_id, rank::INTEGER AS rank, vec_id, s.shard, {R('score')} AS score, depth, {R('(1 + least((SELECT max(depth) FROM loads), 16) * 100 + greatest((SELECT max(depth) FROM loads) - 16, 0) * 200) / 1000.0::DOUBLE')} AS latency_ms FROM (SELECT *, (vec_id % 4)::BIGINT AS shard FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.query_id, c.vec_id, list_cosine_similarity(c.v, q.q) AS score FROM corpus c CROSS JOIN queries q)) WHERE rank <= 10) s JOIN loads l ON s.shard = l.shard"))
def sharded(spark: SparkSession, d: str) -> DataFrame:
    """Four drives scan their own vectors for their best ten, the host merges; load of each drive, latency of the slowest."""
    rows = B.corpus(spark, d).withColumn("shard", F.pmod("vec_id", F.lit(4)).cast("long"))
    loads = rows.groupBy("shard").agg(F.count("*").alias("depth"))
    slowest = F.broadcast(loads.agg(F.max("depth").alias("slowest")))
    latency = storage.latency_us(F.lit(100.0), F.lit(1.0), F.lit(16), F.col("slowest")) / 1000
    found = sharded_top_k(rows, B.queries(rows), B.RESULT_K, "shard").join(F.broadcast(loads), "shard").crossJoin(slowest)
    return found.select("query_id", "rank", "vec_id", "shard", r6("score").alias("score"), "depth", r6(latency).alias("latency_ms"))


@query("TOPK-8", "SELECT event_type, rank::INTEGER AS rank, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts, event_id) AS rank FROM events) WHERE rank <= 16")
def elite_archive(spark: SparkSession, d: str) -> DataFrame:
    return ranked(B.table(spark, d, "events"), 16, ["event_type"], F.col("value").desc(), "ts", "event_id").select("event_type", "rank", "event_id", "value")


@query("TOPK-9", "SELECT event_id, user_id, event_type FROM events ORDER BY coalesce(epoch_us(ts), 0) DESC, event_id LIMIT 100")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.events import recent

    return recent(B.table(spark, d, "events"), 100).select("event_id", "user_id", "event_type")


@query("TOPK-10", sql(B.EXPERIMENTS, f"SELECT task, win, profile, {R('ndcg')} AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY task, win ORDER BY ndcg DESC, profile) AS r FROM experiments) WHERE r = 1"))
def best_profile(spark: SparkSession, d: str) -> DataFrame:
    return ranked(B.experiments(spark, d), 1, ["task", "win"], F.col("ndcg").desc(), "profile").select("task", "win", "profile", r6("ndcg").alias("ndcg"))


@query("TOPK-11", "SELECT o_orderkey, o_custkey, place::INTEGER AS place FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders)")
def multi_key_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey")
    return B.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("place"))


# ---------------------------------------------------------------- neighbourhoods and masks

@query("AGG-1", sql(B.TO_STATS, f"SELECT query_id, {R('global_variance', 9)} AS global_variance FROM spread"))
def global_variance(spark: SparkSession, d: str) -> DataFrame:
    return N.spread(N.dimension_stats(B.scout(spark, d))).select("query_id", r6("global_variance", 9).alias("global_variance"))


@query("AGG-2", sql(B.TO_STATS, f"SELECT query_id, (pos - 1)::INTEGER AS pos, {R('mean', 9)} AS mean FROM stats"))
def centre_of_mass(spark: SparkSession, d: str) -> DataFrame:
    return N.dimension_stats(B.scout(spark, d)).select("query_id", "pos", r6("mean", 9).alias("mean"))


@query("AGG-3", sql(B.TO_STATS, f"SELECT query_id, {R('quantile_cont(var, 0.5)', 9)} AS p50, {R('quantile_cont(var, 0.85)', 9)} AS p85 FROM stats GROUP BY query_id"))
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    s = N.dimension_stats(B.scout(spark, d))
    return s.groupBy("query_id").agg(r6(F.percentile("var", F.lit(0.5)), 9).alias("p50"), r6(F.percentile("var", F.lit(0.85)), 9).alias("p85"))


@query("MASK-1", sql(B.TO_STATS, "SELECT query_id, list_sum(mask)::BIGINT AS kept, array_to_string(list_transform(mask, lambda m: m::BIGINT::VARCHAR), '') AS bits FROM masks"))
def variance_masks(spark: SparkSession, d: str) -> DataFrame:
    m = N.variance_mask(N.dimension_stats(B.scout(spark, d)))
    return m.select("query_id", V.total(F.col("mask")).cast("long").alias("kept"), F.array_join(F.transform("mask", lambda x: x.cast("long").cast("string")), "").alias("bits"))


@query("MASK-2", sql(B.TO_STATS, "SELECT s.query_id, count(*) FILTER (var > low) AS kept FROM stats s JOIN (SELECT query_id, quantile_cont(var, 0.15) AS low FROM stats GROUP BY query_id) c ON s.query_id = c.query_id GROUP BY s.query_id"))
def inverted_masks(spark: SparkSession, d: str) -> DataFrame:
    m = N.variance_mask(N.dimension_stats(B.scout(spark, d)), inverted=True)
    return m.select("query_id", V.total(F.col("mask")).cast("long").alias("kept"))


@query("MASK-3", sql(B.TO_STATS, f"SELECT c.query_id, {R('sqrt(list_sum(list_transform(list_zip(c.q, m.mask), lambda z: z[1] * z[2] * z[1] * z[2])))')} AS norm FROM queries c JOIN masks m ON c.query_id = m.query_id"))
def masked_queries(spark: SparkSession, d: str) -> DataFrame:
    masks = N.variance_mask(N.dimension_stats(B.scout(spark, d)))
    q = B.queries(B.corpus(spark, d)).join(masks, "query_id", "left")
    return q.select("query_id", r6(V.norm(F.coalesce(V.masked(F.col("q"), F.col("mask")), F.col("q")))).alias("norm"))


@query("MASK-4", sql(B.TO_STATS, f"SELECT query_id, {R('list_avg(mask)')} AS density FROM masks"))
def mask_density(spark: SparkSession, d: str) -> DataFrame:
    m = N.variance_mask(N.dimension_stats(B.scout(spark, d)))
    return m.select("query_id", r6(V.total(F.col("mask")) / F.size("mask")).alias("density"))


@query("MASK-5", sql(B.TO_STATS, f"SELECT query_id, {R('global_variance', 9)} AS global_variance, CASE WHEN global_variance > (SELECT quantile_cont(global_variance, 0.5) FROM spread) THEN 'CHELATE' ELSE 'FAST' END AS action, 'CHELATE_ALWAYS' AS centred_action FROM spread"))
def decisions(spark: SparkSession, d: str) -> DataFrame:
    s = N.spread(N.dimension_stats(B.scout(spark, d)))
    cut = F.broadcast(s.agg(F.percentile("global_variance", F.lit(0.5)).alias("cut")))
    return s.crossJoin(cut).select("query_id", r6("global_variance", 9).alias("global_variance"), N.decision(F.col("global_variance"), F.col("cut"), True, False).alias("action"), N.decision(F.col("global_variance"), F.col("cut"), False, True).alias("centred_action"))


_RUN = f"""{B.TO_STATS}, {B.RERANKED},
acts AS (SELECT query_id, CASE WHEN global_variance > (SELECT quantile_cont(global_variance, 0.5) FROM spread) THEN 'CHELATE' ELSE 'FAST' END AS action FROM spread),
final AS (SELECT m.query_id, a.action, m.vec_id, m.rank AS scout_rank, CASE WHEN a.action = 'CHELATE' THEN m.new_rank ELSE m.rank END AS rank FROM masked m JOIN acts a ON m.query_id = a.query_id),
overlap AS (SELECT query_id, count(*) FILTER (rank <= 10 AND scout_rank <= 10) / count(*) FILTER (rank <= 10 OR scout_rank <= 10)::DOUBLE AS jaccard FROM final GROUP BY query_id)"""


def run_inference(spark: SparkSession, d: str) -> DataFrame:
    """query_id, action, vec_id, scout_rank, rank over all scouted rows: re-ranked where the spread is over the median."""
    hits = B.scout(spark, d)
    stats = N.dimension_stats(hits)
    s = N.spread(stats)
    cut = F.broadcast(s.agg(F.percentile("global_variance", F.lit(0.5)).alias("cut")))
    actions = s.crossJoin(cut).select("query_id", N.decision(F.col("global_variance"), F.col("cut"), True, False).alias("action"))
    rows = N.rerank(hits, N.variance_mask(stats)).join(actions, "query_id")
    return rows.select("query_id", "action", "vec_id", F.col("rank").alias("scout_rank"), F.when(F.col("action") == "CHELATE", F.col("new_rank")).otherwise(F.col("rank")).alias("rank"))


@query("RUN-2", sql(_RUN, f"SELECT f.query_id, action, f.rank::INTEGER AS rank, vec_id, {R('jaccard')} AS jaccard FROM final f JOIN overlap o ON f.query_id = o.query_id WHERE f.rank <= 10"))
def adaptive_retrieval(spark: SparkSession, d: str) -> DataFrame:
    rows = run_inference(spark, d)
    both = F.count(F.when((F.col("rank") <= 10) & (F.col("scout_rank") <= 10), 1))
    either = F.count(F.when((F.col("rank") <= 10) | (F.col("scout_rank") <= 10), 1))
    overlap = rows.groupBy("query_id").agg((both / either).alias("jaccard"))
    return rows.where("rank <= 10").join(overlap, "query_id").select("query_id", "action", "rank", "vec_id", r6("jaccard").alias("jaccard"))


@query("METRIC-8", sql(_RUN, f"SELECT query_id, {R('jaccard')} AS jaccard FROM overlap"))
def result_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = run_inference(spark, d)
    sets = rows.groupBy("query_id").agg(F.collect_set(F.when(F.col("scout_rank") <= 10, F.col("vec_id"))).alias("a"), F.collect_set(F.when(F.col("rank") <= 10, F.col("vec_id"))).alias("b"))
    return sets.select("query_id", r6(N.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


_HARM = f"""{B.TO_RANKINGS}, rel AS (SELECT label, pos, avg(x) AS m FROM dims GROUP BY label, pos),
noise AS (SELECT query_id, vec_id, v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM scout WHERE label <> query_label) WHERE n <= 5),
bad AS (SELECT query_id, pos, avg(x) AS m FROM (SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM noise) GROUP BY query_id, pos),
qd AS (SELECT query_id, query_label, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM queries),
harm AS (SELECT qd.pos, sum(greatest(0.0::DOUBLE, qd.x * bad.m - qd.x * rel.m)) AS harm FROM qd JOIN bad ON qd.query_id = bad.query_id AND qd.pos = bad.pos JOIN rel ON qd.query_label = rel.label AND qd.pos = rel.pos GROUP BY qd.pos)"""


def harmful_dimensions(hits: DataFrame, centroids: DataFrame, queries: DataFrame) -> DataFrame:
    """pos (from 0) and harm: how much more a dimension speaks for the first distractors than for the relevant."""
    relevant = V.exploded(centroids, "q", "query_id").select(F.col("query_id").alias("query_label"), "pos", F.col("x").alias("good"))
    noise = ranked(hits.where("label <> query_label").withColumnRenamed("rank", "scout_rank"), 5, ["query_id"], "scout_rank")
    bad = V.exploded(noise, "v", "query_id").groupBy("query_id", "pos").agg(F.avg("x").alias("bad"))
    q = V.exploded(queries, "q", "query_id", "query_label").join(bad, ["query_id", "pos"]).join(relevant, ["query_label", "pos"])
    return q.groupBy("pos").agg(F.sum(F.greatest(F.lit(0.0), F.col("x") * F.col("bad") - F.col("x") * F.col("good"))).alias("harm"))


def _harm(spark: SparkSession, d: str) -> DataFrame:
    rows = B.corpus(spark, d)
    return harmful_dimensions(B.scout(spark, d), B.centroids(rows), B.queries(rows))


@query("AGG-20", sql(_HARM, f"SELECT (pos - 1)::INTEGER AS pos, {R('harm', 9)} AS harm FROM harm"))
def harm_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    return _harm(spark, d).select("pos", r6("harm", 9).alias("harm"))


@query("AGG-21", sql(f"{B.QUERIES}", f"""SELECT (qd.pos - 1)::INTEGER AS pos, {R('sum(greatest(0.0::DOUBLE, qd.x * (o.m - r.m)))', 9)} AS harm
 FROM (SELECT query_id, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM centroids) qd
 JOIN (SELECT label, pos, avg(x) AS m FROM dims GROUP BY label, pos) r ON r.label = qd.query_id AND r.pos = qd.pos
 JOIN (SELECT label, pos, avg(x) AS m FROM dims GROUP BY label, pos) o ON o.label <> qd.query_id AND o.pos = qd.pos GROUP BY qd.pos"""))
def pairwise_harm(spark: SparkSession, d: str) -> DataFrame:
    """Every other cluster's mean against the query's own, per dimension.

    In the order of the means at a position, those over a cluster's own follow it and those under it come before, so sums
    over the pairs are running sums: nothing is joined with itself.
    """
    means = V.exploded(B.centroids(B.corpus(spark, d)), "q", "query_id")
    at = Window.partitionBy("pos")
    below = at.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    x = F.col("x")
    rows = means.withColumns({"n": F.count("*").over(at), "all": F.sum(x).over(at), "n_low": F.count("*").over(below), "low": F.sum(x).over(below)})
    over = (F.col("all") - F.col("low")) - (F.col("n") - F.col("n_low")) * x
    under = F.col("n_low") * x - F.col("low")
    return rows.groupBy("pos").agg(r6(F.sum(F.when(x > 0, x * over).otherwise(-x * under)), 9).alias("harm"))


# ---------------------------------------------------------------- metrics

def metrics_of(hits: DataFrame, rankings: DataFrame | None = None, k: int = B.RESULT_K) -> DataFrame:
    """The metrics of each profile and query of scouted rows."""
    return metrics.per_query(B.rankings(hits) if rankings is None else rankings, B.qrels(hits), k, keys=("profile", "query_id"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics_of(B.scout(spark, d))


def _metric(name: str, column: str) -> None:
    @query(name, sql(B.TO_METRICS, f"SELECT profile, query_id, {R(column)} AS {column} FROM metrics"))
    def one(spark: SparkSession, d: str) -> DataFrame:
        return _metrics(spark, d).select("profile", "query_id", r6(column).alias(column))


for _name, _column in (("METRIC-1", "dcg"), ("METRIC-2", "ndcg"), ("METRIC-3", "ap"), ("METRIC-4", "rr"), ("METRIC-5", "recall")):
    _metric(_name, _column)


@query("METRIC-6", sql(B.TO_METRICS, f"SELECT m.profile, m.query_id, {R('ndcg')} AS ndcg, {R('ap')} AS ap, {R('rr')} AS rr, {R('recall')} AS recall, first_rank::INTEGER AS first_relevant_rank, hits, relevant, r.vec_id AS top_doc FROM metrics m JOIN rankings r ON m.profile = r.profile AND m.query_id = r.query_id AND r.rank = 1"))
def query_rows(spark: SparkSession, d: str) -> DataFrame:
    hits = B.scout(spark, d)
    rankings = B.rankings(hits)
    top = rankings.where("rank = 1").select("profile", "query_id", F.col("vec_id").alias("top_doc"))
    rows = metrics_of(hits, rankings).join(top, ["profile", "query_id"])
    return rows.select("profile", "query_id", *(r6(c).alias(c) for c in ("ndcg", "ap", "rr", "recall")), "first_relevant_rank", "hits", "relevant", "top_doc")


_DELTAS = f"""{B.TO_METRICS}, attributed AS (SELECT c.profile, c.query_id, c.ndcg - coalesce(b.ndcg, 0.0::DOUBLE) AS delta, c.first_rank AS candidate, b.first_rank AS baseline
  FROM metrics c LEFT JOIN (SELECT * FROM metrics WHERE profile = 'baseline') b ON c.query_id = b.query_id)"""


def _attributed(spark: SparkSession, d: str) -> DataFrame:
    rows = _metrics(spark, d)
    base = rows.where("profile = 'baseline'").select("query_id", F.col("ndcg").alias("base"), F.col("first_relevant_rank").alias("baseline"))
    return rows.join(base, "query_id", "left").withColumn("delta", F.col("ndcg") - F.coalesce("base", F.lit(0.0))).withColumnRenamed("first_relevant_rank", "candidate")


@query("METRIC-7", sql(_DELTAS, "SELECT profile, query_id, (CASE WHEN candidate IS NULL AND baseline IS NULL THEN NULL WHEN candidate IS NULL THEN 999 WHEN baseline IS NULL THEN -999 ELSE candidate - baseline END)::INTEGER AS rank_delta FROM attributed"))
def rank_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _attributed(spark, d).select("profile", "query_id", metrics.rank_delta(F.col("candidate"), F.col("baseline")).alias("rank_delta"))


@query("JOIN-4", sql(_DELTAS, f"SELECT profile, query_id, {R('delta')} AS delta FROM attributed"))
def baseline_join(spark: SparkSession, d: str) -> DataFrame:
    return _attributed(spark, d).select("profile", "query_id", r6("delta").alias("delta"))


@query("METRIC-9", sql(B.TO_RANKINGS, f"""SELECT query_id, {R('avg(c / (20.0 - c))')} AS stability FROM (SELECT a.query_id, a.profile AS pa, b.profile AS pb,
  (SELECT count(*) FROM rankings x JOIN rankings y ON x.query_id = y.query_id AND x.vec_id = y.vec_id WHERE x.profile = a.profile AND y.profile = b.profile AND x.query_id = a.query_id)::DOUBLE AS c
  FROM (SELECT DISTINCT profile, query_id FROM rankings) a JOIN (SELECT DISTINCT profile, query_id FROM rankings) b ON a.query_id = b.query_id AND a.profile < b.profile) GROUP BY query_id"""))
def stability(spark: SparkSession, d: str) -> DataFrame:
    sets = B.rankings(B.scout(spark, d)).groupBy("query_id", "profile").agg(F.collect_set("vec_id").alias("s"))
    pairs = sets.alias("a").join(sets.alias("b"), "query_id").where("a.profile < b.profile")
    return pairs.groupBy("query_id").agg(r6(F.avg(N.jaccard(F.col("a.s"), F.col("b.s")))).alias("stability"))


@query("METRIC-10", sql(_DELTAS, f"SELECT c.profile, {R('avg(c.ndcg) - avg(b.ndcg)')} AS gain, {R('CASE WHEN avg(b.ndcg) = 0 THEN 0 ELSE (avg(c.ndcg) - avg(b.ndcg)) / avg(b.ndcg) * 100 END')} AS percent FROM metrics c JOIN metrics b ON c.query_id = b.query_id AND b.profile = 'baseline' WHERE c.profile <> 'baseline' GROUP BY c.profile"))
def learning_gain(spark: SparkSession, d: str) -> DataFrame:
    rows = _attributed(spark, d).where("profile <> 'baseline'").groupBy("profile").agg(F.avg("ndcg").alias("post"), F.avg("base").alias("pre"))
    gain = F.col("post") - F.col("pre")
    return rows.select("profile", r6(gain).alias("gain"), r6(F.when(F.col("pre") == 0, 0.0).otherwise(gain / F.col("pre") * 100)).alias("percent"))


@query("AGG-4", sql(B.TO_METRICS, f"SELECT profile, {R('avg(ndcg)')} AS ndcg, {R('avg(ap)')} AS map, {R('avg(rr)')} AS mrr, {R('avg(recall)')} AS recall, count(*) AS queries FROM metrics GROUP BY profile"))
def metric_means(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).groupBy("profile").agg(r6(F.avg("ndcg")).alias("ndcg"), r6(F.avg("ap")).alias("map"), r6(F.avg("rr")).alias("mrr"), r6(F.avg("recall")).alias("recall"), F.count("*").alias("queries"))


@query("AGG-5", sql(B.TO_METRICS, f"SELECT profile, {R('0.6 * avg(ndcg) + 0.2 * avg(rr) + 0.2 * avg(recall)')} AS fitness FROM metrics WHERE relevant > 0 GROUP BY profile"))
def fitness(spark: SparkSession, d: str) -> DataFrame:
    rows = _metrics(spark, d).where("relevant > 0")
    return rows.groupBy("profile").agg(r6(0.6 * F.avg("ndcg") + 0.2 * F.avg("rr") + 0.2 * F.avg("recall")).alias("fitness"))


@query("METRIC-12", sql(B.TO_METRICS, f"SELECT profile, {R('avg(ndcg) FILTER (hits > 0)')} AS judged_mean, count(*) FILTER (hits > 0) AS judged FROM metrics GROUP BY profile"))
def judged_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """The older evaluators' mean: over queries that have a hit."""
    return _metrics(spark, d).groupBy("profile").agg(r6(F.avg(F.when(F.col("hits") > 0, F.col("ndcg")))).alias("judged_mean"), F.count_if(F.col("hits") > 0).alias("judged"))


# ---------------------------------------------------------------- joins over rankings

@query("JOIN-1", sql(B.TO_RANKINGS, "SELECT profile, r.query_id, rank::INTEGER AS rank, r.vec_id, c.label AS payload FROM rankings r LEFT JOIN corpus c ON r.vec_id = c.vec_id"))
def payload_join(spark: SparkSession, d: str) -> DataFrame:
    rows = B.rankings(B.scout(spark, d))
    return rows.join(B.corpus(spark, d).select("vec_id", F.col("label").alias("payload")), "vec_id", "left").select("profile", "query_id", "rank", "vec_id", "payload")


@query("JOIN-2", sql(B.TO_RANKINGS, "SELECT profile, r.query_id, r.vec_id, coalesce(q.grade, 0.0::DOUBLE) AS grade FROM rankings r LEFT JOIN qrels q ON r.query_id = q.query_id AND r.vec_id = q.vec_id"))
def judgement_join(spark: SparkSession, d: str) -> DataFrame:
    hits = B.scout(spark, d)
    return metrics.judged(B.rankings(hits), B.qrels(hits)).select("profile", "query_id", "vec_id", "grade")


@query("JOIN-3", sql(B.TO_RANKINGS, "SELECT a.query_id, count(*) AS common_docs FROM rankings a JOIN rankings b ON a.query_id = b.query_id AND a.vec_id = b.vec_id WHERE a.profile = 'baseline' AND b.profile = 'masked' GROUP BY a.query_id"))
def common_results(spark: SparkSession, d: str) -> DataFrame:
    rows = B.rankings(B.scout(spark, d))
    a, b = (rows.where(F.col("profile") == p).select("query_id", "vec_id") for p in ("baseline", "masked"))
    return a.join(b, ["query_id", "vec_id"]).groupBy("query_id").agg(F.count("*").alias("common_docs"))


@query("JOIN-5", sql(B.QUERIES, f"SELECT query_id, count(*) AS docs, {R('avg(list_cosine_similarity(v, q))')} AS mean_score, {R('max(list_cosine_similarity(v, q))')} AS best FROM corpus CROSS JOIN queries GROUP BY query_id"))
def all_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every query against every row, aggregated where the rows are."""
    rows = B.corpus(spark, d)
    return score_statistics(rows, B.queries(rows)).select("query_id", "docs", r6("mean").alias("mean_score"), r6("best").alias("best"))


@query("JOIN-7", sql(B.TO_SCOUT, "SELECT query_id, vec_id, place::INTEGER AS place FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM scout WHERE label <> query_label) WHERE place <= 5"))
def distractors(spark: SparkSession, d: str) -> DataFrame:
    hits = B.scout(spark, d)
    rest = hits.select("query_id", "vec_id", F.col("rank").alias("scout_rank")).join(B.qrels(hits), ["query_id", "vec_id"], "left_anti")
    return ranked(rest, 5, ["query_id"], "scout_rank").select("query_id", "vec_id", F.col("rank").alias("place"))


@query("JOIN-9", sql(B.QUERIES, f"SELECT vec_id, label, query_id AS route, {R('score')} AS score FROM (SELECT vec_id, label, query_id, list_cosine_similarity(v, q) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(v, q) DESC, query_id) AS r FROM corpus CROSS JOIN centroids) WHERE r = 1"))
def nearest_route(spark: SparkSession, d: str) -> DataFrame:
    """The best centroid of each vector; blocks of centroids pass by the vectors, however many there are."""
    rows = B.corpus(spark, d)
    return route_scores(rows, B.centroids(rows)).select(F.col("id").alias("vec_id"), "label", "route", r6("score").alias("score"))


# ---------------------------------------------------------------- fusion and sets

_VARIANTS = f"{B.TO_RANKINGS}, variants AS (SELECT CASE profile WHEN 'baseline' THEN 0 WHEN 'centered' THEN 1 ELSE 2 END AS variant, query_id, rank, vec_id FROM rankings)"


def _variants(spark: SparkSession, d: str) -> DataFrame:
    number = F.when(F.col("profile") == "baseline", 0).when(F.col("profile") == "centered", 1).otherwise(2)
    return B.rankings(B.scout(spark, d)).select(number.alias("variant"), "query_id", "rank", "vec_id")


def _fused_sql(score: str, tie: str = "min(variant * 1000 + rank)") -> str:
    return sql(_VARIANTS, f"SELECT query_id, vec_id, {R('score')} AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie) AS rank FROM (SELECT query_id, vec_id, {score} AS score, {tie} AS tie FROM variants GROUP BY query_id, vec_id)) WHERE rank <= 10")


def _fused(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", r6("score").alias("score"), "rank")


@query("SET-1", _fused_sql("round(sum(1.0::DOUBLE / (60 + rank)), 12)"))
def rrf_variants(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.reciprocal_rank_fusion(_variants(spark, d)))


@query("SET-2", _fused_sql("round(sum(1.0::DOUBLE / (60 + rank - 1)), 12)"))
def rrf_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.reciprocal_rank_fusion(_variants(spark, d), 59.0))


@query("SET-3", _fused_sql("1.0::DOUBLE / min(rank)"))
def union_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.union_fusion(_variants(spark, d)))


@query("SET-4", sql(f"{_VARIANTS}, inside AS (SELECT query_id, vec_id, 1.0::DOUBLE / avg(rank) AS score, 0 AS tie FROM variants GROUP BY query_id, vec_id HAVING count(DISTINCT variant) = 3), outside AS (SELECT query_id, vec_id, 1.0::DOUBLE / min(rank) AS score, min(variant * 1000 + rank) AS tie FROM variants WHERE query_id NOT IN (SELECT query_id FROM inside) GROUP BY query_id, vec_id)", f"""SELECT query_id, vec_id, {R('score')} AS score, rank::INTEGER AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie, vec_id) AS rank FROM (SELECT * FROM inside UNION ALL SELECT * FROM outside)) WHERE rank <= 10"""))
def intersection_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(fusion.intersection_fusion(_variants(spark, d)))


_OVER = f"{B.TO_RANKINGS}, sets AS (SELECT profile, query_id, list(vec_id) AS s FROM rankings GROUP BY profile, query_id), isomers AS (SELECT a.query_id, 1 - len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE AS strength FROM sets a JOIN sets b ON a.query_id = b.query_id WHERE a.profile = 'baseline' AND b.profile = 'masked')"


def _isomers(spark: SparkSession, d: str) -> DataFrame:
    sets = B.rankings(B.scout(spark, d)).groupBy("query_id").agg(*(F.collect_set(F.when(F.col("profile") == p, F.col("vec_id"))).alias(p) for p in ("baseline", "masked")))
    return sets.select("query_id", (1.0 - N.jaccard(F.col("baseline"), F.col("masked"))).alias("strength"))


@query("SET-5", sql(_OVER, f"SELECT query_id, {R('strength')} AS strength FROM isomers"))
def isomer_strength(spark: SparkSession, d: str) -> DataFrame:
    return _isomers(spark, d).select("query_id", r6("strength").alias("strength"))


@query("SET-6", sql(_OVER, f"SELECT count(*) AS pairs, count(*) FILTER (strength >= 0.2) AS isomers, {R('count(*) FILTER (strength >= 0.2) / count(*)::DOUBLE')} AS ratio, {R('avg(strength)')} AS mean, {R('max(strength)')} AS most FROM isomers"))
def isomer_summary(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("strength")
    return _isomers(spark, d).agg(F.count("*").alias("pairs"), F.count_if(s >= 0.2).alias("isomers"), r6(F.count_if(s >= 0.2) / F.count("*")).alias("ratio"), r6(F.avg(s)).alias("mean"), r6(F.max(s)).alias("most"))


_ITEMS = f"{B.TO_RANKINGS}, sets AS (SELECT profile || '/' || query_id AS item, vec_id FROM rankings), pairs AS (SELECT a.item AS a, b.item AS b, count(*) AS c FROM sets a JOIN sets b ON a.vec_id = b.vec_id AND a.item < b.item GROUP BY 1, 2)"


@query("SET-7", sql(_ITEMS, f"SELECT a, b, {R('c / (20.0 - c)')} AS jaccard FROM pairs"))
def similar_result_sets(spark: SparkSession, d: str) -> DataFrame:
    """Queries of all profiles whose result sets share a document."""
    items = B.rankings(B.scout(spark, d)).select(F.concat_ws("/", "profile", "query_id").alias("item"), "vec_id")
    return fusion.overlaps(items, item="item").select("a", "b", r6("jaccard").alias("jaccard"))


@query("AGG-22", sql(_OVER, f"SELECT count(*) AS n, {R('avg(strength)')} AS mean, {R('stddev_pop(strength)')} AS std, {R('min(strength)')} AS low, {R('quantile_cont(strength, 0.25)')} AS q25, {R('median(strength)')} AS median, {R('quantile_cont(strength, 0.75)')} AS q75, {R('max(strength)')} AS high FROM isomers"))
def strength_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = "strength"
    quantile = lambda p: r6(F.percentile(s, F.lit(p)))
    return _isomers(spark, d).agg(F.count("*").alias("n"), r6(F.avg(s)).alias("mean"), r6(F.stddev_pop(s)).alias("std"), r6(F.min(s)).alias("low"), quantile(0.25).alias("q25"), quantile(0.5).alias("median"), quantile(0.75).alias("q75"), r6(F.max(s)).alias("high"))
