"""Queries: sources and sinks, predicates, gates, learning targets, sampling, simulated storage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import adapters as A
from ..operators import gates as G
from ..operators import metrics, storage
from ..operators.topk import cosine_top_k, ranked
from ..registry import query
from ..sources import collection as C
from . import base as B
from .base import r6, sql
from .base import r6_sql as R

_VALID = "(embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"


# ---------------------------------------------------------------- sources

@query("SRC-1", "SELECT count(*) AS points, count(DISTINCT vec_id) AS ids FROM embeddings")
def opened(spark: SparkSession, d: str) -> DataFrame:
    return C.open_collection(spark, f"{d}/embeddings.parquet").agg(F.count("*").alias("points"), F.countDistinct("vec_id").alias("ids"))


_UNIT = "list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12::DOUBLE))"


@query("SRC-2", sql(f"{B.CORPUS}, unit AS (SELECT vec_id, {_UNIT} AS u FROM corpus), flat AS (SELECT vec_id, unnest(u) AS x FROM unit), scale AS (SELECT quantile_cont(abs(x), 0.99) / 127 AS s FROM flat)", "SELECT vec_id AS id, sum(least(greatest(round_even(x / s, 0), -127), 127))::BIGINT AS levels FROM flat CROSS JOIN scale GROUP BY vec_id"))
def created(spark: SparkSession, d: str) -> DataFrame:
    rows = C.created(B.corpus(spark, d), 64, "vec_id", "v")
    return rows.select("id", F.aggregate("code", F.lit(0).cast("long"), lambda s, x: s + x).alias("levels"))


@query("SRC-3", "SELECT vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 100)::BIGINT AS page, (((row_number() OVER (ORDER BY vec_id) - 1) // 100 + 1) * 100)::BIGINT AS next_offset FROM embeddings")
def scrolled(spark: SparkSession, d: str) -> DataFrame:
    return C.pages(B.table(spark, d, "embeddings").select("vec_id"), "vec_id", 100).select("vec_id", "page", "next_offset")


@query("SRC-4", "SELECT l.doc_id, (row_number() OVER (PARTITION BY d.source ORDER BY l.doc_id))::INTEGER AS place, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def retrieved(spark: SparkSession, d: str) -> DataFrame:
    """The labelled documents by id, each with its place in its source."""
    wanted = B.table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    rows = C.retrieved(B.table(spark, d, "documents").select("doc_id", "source", "n_chars"), wanted, "doc_id")
    return ranked(rows, None, ["source"], "doc_id").select("doc_id", F.col("rank").alias("place"), "n_chars")


@query("SRC-5", "WITH u AS (SELECT l_orderkey AS k, arg_max(l_extendedprice, l_linenumber) AS v FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey NOT IN (SELECT k FROM u) UNION ALL SELECT k, v FROM u")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Line items update order rows; the last line with a price wins, and of lines of one number the first in the table."""
    base = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    known = price.isNotNull() & line.isNotNull()
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    updates = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(known, price).alias("v"), F.when(known, line).alias("version"), *place)
    return C.upserted(base, updates, "k", ("file", "row"))


@query("SRC-6", f"WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS point_id, {_VALID} AS good FROM embeddings) SELECT vec_id, point_id, (point_id // 100)::BIGINT AS batch, bool_and(good) OVER (PARTITION BY point_id // 100) AS accepted FROM o")
def ingested(spark: SparkSession, d: str) -> DataFrame:
    rows = C.ingested(B.table(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v")), 64, 100, "vec_id", "v")
    return rows.select("vec_id", F.col("point_id").cast("long").alias("point_id"), "batch", "accepted")


@query("SRC-9", "SELECT 'corpus' AS part, count(*) AS n, sum(length(text) + 1)::BIGINT AS chars FROM documents UNION ALL SELECT 'queries', count(*), sum(length(text))::BIGINT FROM benchmark UNION ALL SELECT 'qrels', count(*), sum(quality)::BIGINT FROM labels")
def dataset(spark: SparkSession, d: str) -> DataFrame:
    judged = B.table(spark, d, "labels").select(F.lit(0).alias("query_id"), "doc_id", F.col("quality").alias("score"))
    corpus, queries, qrels = C.dataset(B.table(spark, d, "documents").select("doc_id", "text"), B.table(spark, d, "benchmark"), judged)
    out = corpus.agg(F.lit("corpus").alias("part"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    out = out.unionByName(queries.agg(F.lit("queries").alias("part"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))
    return out.unionByName(qrels.agg(F.lit("qrels").alias("part"), F.count("*").alias("n"), F.sum("score").cast("long").alias("chars")))


@query("SRC-10", "SELECT event_id, json_extract_string(props, '$.k') AS found FROM events")
def found_keys(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").select("event_id", F.expr("try_variant_get(parse_json(props), '$.k', 'string')").alias("found"))


@query("SRC-23", "SELECT d.doc_id, d.n_chars AS expected, length(d.text)::BIGINT AS observed FROM documents d WHERE d.n_chars IS DISTINCT FROM length(d.text)")
def evidence_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("expected"), F.length("text").cast("long").alias("observed"))
    return rows.where(~F.col("expected").eqNullSafe(F.col("observed")))


@query("SRC-21", "SELECT c_custkey, CASE WHEN lo < hi THEN substr(rpad(hex('result'), 1024, '0'), (2 * (lo - 51200) + 1)::BIGINT, (2 * (hi - lo))::BIGINT) ELSE '' END AS sector, (en - st)::BIGINT AS bytes FROM (SELECT *, greatest(st, 51200) AS lo, least(en, 51712) AS hi FROM (SELECT c_custkey, least((c_custkey * 37) % 60000, 65536) AS st, least((c_custkey * 37) % 60000 + 256, 65536) AS en FROM customer))")
def disk_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads of 256 bytes at places all over a 64 KB disk: the part of the result sector in each, and the length."""
    offset = (F.col("c_custkey") * 37) % 60000
    data = storage.read_range(offset, F.lit(256), 65536, "result")
    low, high = F.greatest(offset, F.lit(51200)), F.least(offset + 256, F.lit(51712))
    sector = F.when(low < high, F.substring(data, (2 * (low - offset) + 1).cast("int"), (2 * (high - low)).cast("int"))).otherwise("")
    return B.table(spark, d, "customer").select("c_custkey", sector.alias("sector"), (F.length(data) / 2).cast("long").alias("bytes"))


# ---------------------------------------------------------------- predicates

@query("PRJ-6", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 50")
def collapse_targets(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 50")


@query("PRJ-8", sql(B.SERIES, "SELECT key, seq, v > 0.005 AS above, CASE WHEN v > 0.005 THEN 'rerank' ELSE 'fast' END AS policy, v > 0.005 AND seq % 2 = 0 AS high_variance_fast_path FROM series"))
def policy_projection(spark: SparkSession, d: str) -> DataFrame:
    above = F.col("v") > 0.005
    return B.series(spark, d).select("key", "seq", above.alias("above"), F.when(above, "rerank").otherwise("fast").alias("policy"), (above & (F.col("seq") % 2 == 0)).alias("high_variance_fast_path"))


@query("PRJ-11", "SELECT doc_id, quality::DOUBLE AS grade FROM labels WHERE quality > 0")
def positive_grades(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "labels").where("quality > 0").select("doc_id", F.col("quality").cast("double").alias("grade"))


@query("PRJ-12", f"SELECT vec_id, {_VALID} AS valid FROM embeddings")
def valid_vectors(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "embeddings").select("vec_id", V.valid(F.col("embedding"), 64).alias("valid"))


_GATES = "g(gate, op, cut) AS (VALUES ('few', '<=', 3.0::DOUBLE), ('many', '>=', 5.0::DOUBLE), ('under', '<', 2.0::DOUBLE))"


def _gate_rows(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([("few", "<=", 3.0), ("many", ">=", 5.0), ("under", "<", 2.0)], "gate string, op string, cut double"))


@query("PRJ-13", sql(f"{B.EXPERIMENTS}, {_GATES}", f"SELECT profile, task, win, gate, CASE op WHEN '<=' THEN n <= cut WHEN '>=' THEN n >= cut ELSE n < cut END AS fits, {R('1 / (1 + exp(-(2 * delta - 0.1 * n)))')} AS classifier FROM experiments CROSS JOIN g"))
def gate_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = B.experiments(spark, d).crossJoin(_gate_rows(spark))
    return rows.select("profile", "task", "win", "gate", G.holds(F.col("n"), F.col("op"), F.col("cut")).alias("fits"), r6(G.logistic(2 * F.col("delta") - 0.1 * F.col("n"))).alias("classifier"))


@query("PRJ-15", f"SELECT event_id, {R('least(greatest(value, 10), 90)')} AS clamped FROM events")
def clamped(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").select("event_id", r6(F.least(F.greatest("value", F.lit(10.0)), F.lit(90.0))).alias("clamped"))


# ---------------------------------------------------------------- gates

_RATIO = "CASE WHEN delta <= 0 THEN CASE WHEN 0.9 * ndcg - base >= delta THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (0.9 * ndcg - base) / delta END"


@query("GATE-1", sql(B.EXPERIMENTS, f"SELECT profile, task, win, {R(_RATIO)} AS retained, delta > 0 AND {_RATIO} >= 0.8 AS passed, concat_ws(',', CASE WHEN delta <= 0 THEN 'fp32_gain_below_minimum' END, CASE WHEN {_RATIO} < 0.8 THEN 'retained_gain_below_threshold' END, CASE WHEN 0.9 * ndcg - base < 0 THEN 'quantized_fitness_below_baseline' END) AS reasons FROM experiments"))
def quantization_gate(spark: SparkSession, d: str) -> DataFrame:
    g = G.quantization_gate(F.col("ndcg"), 0.9 * F.col("ndcg"), F.col("base"))
    return B.experiments(spark, d).select("profile", "task", "win", r6(g["retained_ratio"]).alias("retained"), g["passed"].alias("passed"), F.array_join(g["reasons"], ",").alias("reasons"))


_ACTIVE = "(n > 2)"
_KIND = f"""CASE WHEN profile = baseline_name THEN 'reference' WHEN NOT {_ACTIVE} AND abs(delta) <= 0.001 THEN 'no_op_tied' WHEN NOT {_ACTIVE} THEN 'metric_changed_without_actuator'
 WHEN delta > 0.001 THEN 'actuator_active_positive' WHEN delta < -0.001 THEN 'actuator_active_negative' ELSE 'actuator_active_neutral' END"""


@query("GATE-2", sql(B.EXPERIMENTS, f"SELECT profile, task, win, {_KIND} AS fault_class, CASE {_KIND} WHEN 'metric_changed_without_actuator' THEN 'high' WHEN 'actuator_active_negative' THEN 'medium' WHEN 'actuator_active_neutral' THEN 'low' ELSE 'none' END AS severity FROM experiments"))
def behaviour_classes(spark: SparkSession, d: str) -> DataFrame:
    kind, severity = G.behaviour(F.col("profile"), F.col("baseline_name"), F.col("delta"), F.col("n") > 2)
    return B.experiments(spark, d).select("profile", "task", "win", kind.alias("fault_class"), severity.alias("severity"))


@query("GATE-3", sql(B.EXPERIMENTS, """SELECT profile, task, win, concat_ws(',', CASE WHEN ndcg < 0.2 THEN 'reject_candidate' END, CASE WHEN 1 + delta < 0.7 THEN 'reduce_optimization_aggression,enable_query_reformulation' END,
 CASE WHEN NOT (delta >= 0) THEN 'reject_quantized_candidate' END, CASE WHEN n > 4 THEN 'apply_storage_latency_penalty' END,
 CASE WHEN ndcg < 0.5 OR ndcg > 2 THEN 'normalize_runtime_vectors' WHEN ndcg < 0.75 OR ndcg > 1.33 THEN 'inspect_norm_drift' END, CASE WHEN base < 0.25 THEN 'disable_low_effectiveness_route' END) AS actions,
 CASE WHEN ndcg < 0.2 THEN 'fail' WHEN 1 + delta < 0.7 OR NOT (delta >= 0) OR n > 4 OR ndcg < 0.75 OR ndcg > 1.33 OR base < 0.25 THEN 'warning' ELSE 'pass' END AS status FROM experiments"""))
def adaptive_gate(spark: SparkSession, d: str) -> DataFrame:
    g = G.adaptive_gate(F.col("ndcg"), 1 + F.col("delta"), F.col("delta") >= 0, F.col("n"), F.col("ndcg"), F.col("base"), 0.2, 0.7, 4)
    return B.experiments(spark, d).select("profile", "task", "win", F.array_join(g["actions"], ",").alias("actions"), g["status"].alias("status"))


@query("GATE-4", sql(B.EXPERIMENTS, f"SELECT profile, task, win, {R('ndcg * greatest(0, 1 - 0.5 * (1 - least(greatest(1 + delta, 0), 1)))')} AS composed FROM experiments"))
def composed_fitness(spark: SparkSession, d: str) -> DataFrame:
    score = F.least(F.greatest(1 + F.col("delta"), F.lit(0.0)), F.lit(1.0))
    return B.experiments(spark, d).select("profile", "task", "win", r6(F.col("ndcg") * G.penalty(score)).alias("composed"))


@query("MATH-7", sql(B.EXPERIMENTS, f"SELECT profile, task, win, {R('0.4 * (1 - least(greatest(ndcg, 0), 1)) + 0.3 * (1 - least(greatest(base, 0), 1)) + 0.3 * (1 - least(greatest(abs(delta), 0), 1))')} AS score FROM experiments"))
def health_scores(spark: SparkSession, d: str) -> DataFrame:
    return B.experiments(spark, d).select("profile", "task", "win", r6(G.health(F.col("ndcg"), F.col("base"), F.abs("delta"))).alias("score"))


_TRAIN = f"""{B.EXPERIMENTS}, {_GATES}, matched AS (SELECT profile, gate, delta, dense_rank() OVER (ORDER BY win) % 5 = 0 AS holdout FROM experiments CROSS JOIN g WHERE CASE op WHEN '<=' THEN n <= cut WHEN '>=' THEN n >= cut ELSE n < cut END),
rules AS (SELECT profile, gate, count(*) FILTER (NOT holdout) AS train, count(*) FILTER (holdout) AS held, avg(delta) FILTER (NOT holdout) AS train_mean, avg(delta) FILTER (holdout) AS held_mean,
 count(*) FILTER (NOT holdout AND delta < -0.001) AS train_losses, count(*) FILTER (holdout AND delta < -0.001) AS held_losses FROM matched GROUP BY profile, gate)"""


@query("GATE-5", sql(_TRAIN, f"SELECT profile, gate, train, held, {R('train_mean')} AS train_mean, {R('held_mean')} AS held_mean, train >= 3 AND held >= 2 AND coalesce(train_mean >= 0.001, false) AND coalesce(held_mean >= 0.001, false) AND train_losses = 0 AND held_losses = 0 AS accepted FROM rules"))
def trained_gates(spark: SparkSession, d: str) -> DataFrame:
    """Rules on the windows, accepted only if both splits pass; every fifth day is held out."""
    rows = B.experiments(spark, d)
    days = ranked(rows.select("win").distinct().withColumn("all", F.lit(1)), None, ["all"], "win").select("win", (F.col("rank") % 5 == 0).alias("holdout"))
    matched = rows.join(F.broadcast(days), "win").crossJoin(_gate_rows(spark)).where(G.holds(F.col("n"), F.col("op"), F.col("cut")))
    on = lambda held, x: F.when(F.col("holdout") == held, x)
    x = F.col("delta")
    rules = matched.groupBy("profile", "gate").agg(F.count(on(False, x)).alias("train"), F.count(on(True, x)).alias("held"), F.avg(on(False, x)).alias("train_mean"), F.avg(on(True, x)).alias("held_mean"), F.count(on(False, F.when(x < -0.001, x))).alias("l1"), F.count(on(True, F.when(x < -0.001, x))).alias("l2"))
    passed = (F.col("train") >= 3) & (F.col("held") >= 2) & F.coalesce(F.col("train_mean") >= 0.001, F.lit(False)) & F.coalesce(F.col("held_mean") >= 0.001, F.lit(False)) & (F.col("l1") == 0) & (F.col("l2") == 0)
    return rules.select("profile", "gate", "train", "held", r6("train_mean").alias("train_mean"), r6("held_mean").alias("held_mean"), passed.alias("accepted"))


@query("GATE-8", sql(B.EXPERIMENTS, f"SELECT profile, {R('avg(delta)')} AS mean, CASE WHEN avg(delta) > 0.001 THEN 'widen' WHEN avg(delta) < -0.001 THEN 'retreat' ELSE 'hold' END AS proposal FROM experiments GROUP BY profile"))
def proposals(spark: SparkSession, d: str) -> DataFrame:
    m = F.avg("delta")
    return B.experiments(spark, d).groupBy("profile").agg(r6(m).alias("mean"), F.when(m > 0.001, "widen").when(m < -0.001, "retreat").otherwise("hold").alias("proposal"))


_PROMOTE = "avg(delta) > 0 AS directional, avg(delta) > 0.001 AND count(*) FILTER (delta < -0.001) <= count(*) * 0.4::DOUBLE AS promotable, count(*) FILTER (delta < -0.001) = 0 AND avg(delta) > 0.001 AS golden"


@query("GATE-9", sql(B.EXPERIMENTS, f"SELECT profile, {_PROMOTE} FROM experiments GROUP BY profile"))
def promotions(spark: SparkSession, d: str) -> DataFrame:
    m, losses = F.avg("delta"), F.count_if(F.col("delta") < -0.001)
    return B.experiments(spark, d).groupBy("profile").agg((m > 0).alias("directional"), ((m > 0.001) & (losses <= F.count("*") * 0.4)).alias("promotable"), ((losses == 0) & (m > 0.001)).alias("golden"))


@query("GATE-10", "SELECT event_type, '{\"events\":' || count(*) || ',\"users\":' || count(DISTINCT user_id) || '}' AS report FROM events GROUP BY event_type")
def integrated_report(spark: SparkSession, d: str) -> DataFrame:
    """Sections that were not measured are null and drop out of the JSON."""
    rows = B.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    return rows.select("event_type", F.to_json(F.struct("events", "users", F.lit(None).cast("long").alias("norm_drift"))).alias("report"))


@query("GATE-13", "SELECT r_name, '| ' || r_name || ' | ' || string_agg(n_name, ', ' ORDER BY n_name) || ' |' AS line FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def markdown_table(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "nation").join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.array_join(F.array_sort(F.collect_list("n_name")), ", ")
    return rows.groupBy("r_name").agg(F.concat(F.lit("| "), F.first("r_name"), F.lit(" | "), names, F.lit(" |")).alias("line"))


@query("JSON-1", f"SELECT user_id, (json_extract_string(props, '$.k'))::BIGINT AS feature, count(*) AS n, {R('avg(value)')} AS mean FROM events GROUP BY ALL")
def gate_features(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return B.table(spark, d, "events").groupBy("user_id", k.alias("feature")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("JSON-2", sql(B.EXPERIMENTS, f"SELECT win, task, profile, {R('ndcg')} AS ndcg, {R('base')} AS baseline, {R('delta')} AS delta, CASE WHEN delta > 0.001 THEN 'improved' WHEN delta < -0.001 THEN 'regressed' ELSE 'tied' END AS direction FROM experiments"))
def attribution_rows(spark: SparkSession, d: str) -> DataFrame:
    """An artifact nested as windows, then profiles, flattened again."""
    rows = B.experiments(spark, d)
    nested = rows.groupBy("win", "task").agg(F.collect_list(F.struct("profile", "ndcg", "base", "delta")).alias("profiles"))
    flat = nested.select("win", "task", F.inline("profiles"))
    x = F.col("delta")
    return flat.select("win", "task", "profile", r6("ndcg").alias("ndcg"), r6("base").alias("baseline"), r6("delta").alias("delta"), F.when(x > 0.001, "improved").when(x < -0.001, "regressed").otherwise("tied").alias("direction"))


# ---------------------------------------------------------------- learning

# ---------------------------------------------------------------- sampling and grids

@query("SAMP-3", "WITH t(name, tier) AS (VALUES ('tiny', 1), ('small', 2), ('medium', 3), ('large', 4)) SELECT a.tier, b.name FROM t a JOIN t b ON b.tier <= a.tier")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([("tiny", 1), ("small", 2), ("medium", 3), ("large", 4)], "name string, tier int")
    return t.select("tier").alias("a").join(t.select("name", F.col("tier").alias("own")), F.col("own") <= F.col("tier")).select("tier", "name")


@query("SAMP-5", "SELECT i AS run, 42 + i * 1009 AS seed, i % 7 AS template FROM (SELECT unnest(range(0, 21)) AS i)")
def seed_matrix(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return spark.range(21).select(i.alias("run"), (42 + i * 1009).alias("seed"), F.pmod(i, F.lit(7)).cast("long").alias("template"))


# ---------------------------------------------------------------- simulated storage and arithmetic

_DEVICES = "devices(device, fetch_us, branch_us, most) AS (VALUES ('rp2040', 500.0::DOUBLE, 10.0::DOUBLE, 2), ('consumer_nvme', 100.0::DOUBLE, 1.0::DOUBLE, 16), ('smartssd', 50.0::DOUBLE, 2.0::DOUBLE, 64), ('dpu_storage', 25.0::DOUBLE, 2.0::DOUBLE, 128)), load AS (SELECT event_type, count(*) AS depth FROM events GROUP BY event_type)"


def _loads(spark: SparkSession, d: str) -> DataFrame:
    load = B.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("depth"))
    return load.crossJoin(F.broadcast(storage.devices(spark)))


@query("MATH-1", f"SELECT event_id, {R('log2(value + 1)')} AS l, {R('exp(-value / 100)')} AS e, {R('cos(value)')} AS c, {R('sqrt(abs(value))')} AS s FROM events")
def functions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return B.table(spark, d, "events").select("event_id", r6(F.log2(v + 1)).alias("l"), r6(F.exp(-v / 100)).alias("e"), r6(F.cos(v)).alias("c"), r6(F.sqrt(F.abs(v))).alias("s"))


@query("MATH-2", "SELECT event_id, round_even(event_id / 2.0::DOUBLE, 0)::BIGINT AS half FROM events")
def half_even(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events").select("event_id", F.rint(F.col("event_id") / 2).cast("long").alias("half"))


@query("MATH-3", f"WITH {_DEVICES} SELECT event_type, device, {R('branch_us + least(depth, most) * fetch_us + greatest(depth - most, 0) * fetch_us * 2')} AS latency_us FROM load CROSS JOIN devices")
def storage_latency(spark: SparkSession, d: str) -> DataFrame:
    return _loads(spark, d).select("event_type", "device", r6(storage.latency_us(F.col("fetch_us"), F.col("branch_us"), F.col("max_queue"), F.col("depth"))).alias("latency_us"))


@query("MATH-4", f"WITH {_DEVICES} SELECT event_type, device, {R('depth * (branch_us + fetch_us)')} AS sequential_us, {R('depth * branch_us + fetch_us')} AS speculative_us, {R('100 * (1 - (depth * branch_us + fetch_us) / (depth * (branch_us + fetch_us)))')} AS hidden FROM load CROSS JOIN devices")
def execution_modes(spark: SparkSession, d: str) -> DataFrame:
    sequential = F.col("depth") * (F.col("branch_us") + F.col("fetch_us"))
    speculative = F.col("depth") * F.col("branch_us") + F.col("fetch_us")
    return _loads(spark, d).select("event_type", "device", r6(sequential).alias("sequential_us"), r6(speculative).alias("speculative_us"), r6(100 * (1 - speculative / sequential)).alias("hidden"))


@query("MATH-5", f"WITH {_DEVICES} SELECT event_type, device, {R('depth * (524296 / 3.5e9::DOUBLE * 1e6 + fetch_us)')} AS host_us, {R('1024 / 3.5e9::DOUBLE * 1e6 + depth * fetch_us')} AS near_us FROM load CROSS JOIN devices")
def near_data(spark: SparkSession, d: str) -> DataFrame:
    """Blocks over the bus for a host, or inputs and outputs only for near-data compute, at 3.5 GB a second."""
    micros = lambda n: n / 3.5e9 * 1e6
    host = F.col("depth") * (micros(524296) + F.col("fetch_us"))
    near = micros(1024) + F.col("depth") * F.col("fetch_us")
    return _loads(spark, d).select("event_type", "device", r6(host).alias("host_us"), r6(near).alias("near_us"))


@query("VEC-17")
def block_graphs(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: half-float images; the test has the result by hand."""
    import pyarrow as pa

    first, second = A.rule_matrix(64, 64, 13), A.rule_matrix(64, 64, 14)
    width = 64 * 64 * 2 + 8
    image = storage.pack_block(first, width) + storage.pack_block(second, 0)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float32)
                y, blocks = storage.run_blocks(image, x, 64)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(y.sum(axis=1).astype(float)), pa.array([blocks] * batch.num_rows, pa.int32())], ["vec_id", "total", "blocks"])

    out = B.corpus(spark, d).select("vec_id", "v").mapInArrow(run, "vec_id long, total double, blocks int")
    return out.select("vec_id", r6("total", 3).alias("total"), "blocks")


@query("MASK-7", "SELECT 'plain' AS run, 0.0::DOUBLE AS ndcg, 0.0::DOUBLE AS rr, 0.0::DOUBLE AS recall UNION ALL SELECT 'masked', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE")
def synthetic_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Topics with one noisy dimension at cutoff 3: nothing is found until that dimension is masked.

    For each topic t there is a document e_t, four times the noise axis as a distractor, and a query e_t + 4 e_4.
    """
    axis = lambda t: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == t, 1.0).otherwise(0.0))
    noise = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == 4, 4.0).otherwise(0.0))
    topics = spark.range(4).withColumnRenamed("id", "t")
    docs = topics.select((F.col("t") + 10).alias("vec_id"), axis(F.col("t")).alias("v")).unionByName(topics.select("t", noise.alias("v")).toDF("vec_id", "v"))
    queries = topics.select(F.col("t").alias("query_id"), V.add(axis(F.col("t")), noise).alias("q"))
    qrels = topics.select(F.col("t").alias("query_id"), (F.col("t") + 10).alias("vec_id"), F.lit(1.0).alias("grade"))
    out = None
    for name, mask in (("plain", [1.0] * 5), ("masked", [1.0] * 4 + [0.0])):
        keep = F.array(*(F.lit(x) for x in mask))
        ranks = cosine_top_k(docs.withColumn("v", V.masked(F.col("v"), keep)), queries.withColumn("q", V.masked(F.col("q"), keep)), 3)
        rows = metrics.per_query(ranks, qrels, k=3).agg(F.lit(name).alias("run"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("rr"), F.avg("recall").alias("recall"))
        out = rows if out is None else out.unionByName(rows)
    return out
