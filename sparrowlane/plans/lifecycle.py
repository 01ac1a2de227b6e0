"""Queries: sinks, artifacts, checkpoints, fixtures, and fits on aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adapters as A
from ..operators import metrics, storage
from ..operators.topk import cosine_top_k
from ..registry import query
from ..session import new_path
from ..sources import sinks
from ..sources.checkpoints import Checkpoints
from . import base as B
from .base import r6, sql
from .base import r6_sql as R
from .retrieval import metrics_of

# ---------------------------------------------------------------- sinks and read APIs


@query("SRC-12", "SELECT event_id, event_type, epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS elapsed_us FROM events")
def log_sink(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "log")
    sinks.log_lines(B.table(spark, d, "events"), path, "ts", "event_type")
    back = spark.read.schema("event_id long, event_type string, elapsed_seconds double").json(path)
    return back.select("event_id", "event_type", F.rint(F.col("elapsed_seconds") * 1e6).cast("long").alias("elapsed_us"))


@query("SRC-13", sql(B.EXPERIMENTS, f"SELECT profile, task, win, {R('ndcg')} AS ndcg FROM experiments"))
def artifact_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "artifact")
    rows = B.experiments(spark, d).groupBy("win").agg(F.collect_list(F.struct("profile", "task", "ndcg")).alias("results"))
    sinks.write_artifact(rows, path)
    back = sinks.read_artifact(spark, path, "win string, results array<struct<profile: string, task: long, ndcg: double>>")
    return back.select("win", F.inline("results")).select("profile", "task", "win", r6("ndcg").alias("ndcg"))


@query("SRC-14", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "csv")
    rows = B.table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    sinks.append_csv(rows.where("user_id % 2 = 0"), path)
    sinks.append_csv(rows.where("user_id % 2 <> 0"), path)
    return spark.read.schema("event_type string, user_id long, n long").option("header", True).csv(path)


@query("SRC-17", sql(B.QUERIES, f"SELECT query_id, vec_id, {R('score')} AS score FROM (SELECT query_id, vec_id, list_cosine_similarity(v, q) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(v, q) DESC, vec_id) AS r FROM corpus CROSS JOIN queries WHERE vec_id <> query_id) WHERE r <= 3"))
def memory_store(spark: SparkSession, d: str) -> DataFrame:
    return B.search(B.corpus(spark, d), 3).select("query_id", "vec_id", r6("score").alias("score"))


@query("SRC-18", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O'")
def restored_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Two versions, the older one dropped, the newer one verified and restored."""
    store = Checkpoints(spark, new_path(spark, "versions"))
    rows = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    store.create(rows.where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber"), "v1")
    store.create(rows.where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber"), "v2")
    store.keep_last(1)
    return store.restore(store.names()[0])


# ---------------------------------------------------------------- stateful forms in batch


# ---------------------------------------------------------------- training

@query("LEARN-11")
def gate_classifier(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: gradient steps; fitted on one row per profile, task and day, compared with plain numpy in the test."""
    rows = B.experiments(spark, d).select("base", F.col("n").cast("double").alias("n"), (F.col("delta") > 0.001).cast("double").alias("y"))
    weights, bias = A.fit_logistic(rows, ["base", "n"], "y")
    return spark.createDataFrame([(f, float(w)) for f, w in zip(["base", "n", "bias"], [*weights, bias], strict=True)], "feature string, weight double")


# ---------------------------------------------------------------- runs


# fixed values: the closed course, whose first and last query ask for a document that is not the best match
COURSE = ["adaptive retrieval chelation variance", "semantic collapse adaptive retrieval", "near data ssd nvme storage", "quantization int8 gate retention", "adapter routing policy centroid", "retrieval quantization adapter route", "storage adapter route latency"]
COURSE_QUERIES = ["adaptive retrieval", "ssd storage", "quantization gate", "adapter routing", "retrieval route"]
COURSE_RELEVANT = [1, 2, 3, 4, 4]
COURSE_FAMILIES = [(["adaptive", "retrieval", "chelation", "variance", "collapse"], [1.0, 0.35, 0.05, 0.05]), (["ssd", "nvme", "storage", "latency"], [0.05, 1.0, 0.35, 0.05]), (["quantization", "int8", "gate", "retention"], [0.05, 0.05, 1.0, 0.35]), (["adapter", "routing", "route", "policy", "centroid"], [0.35, 0.05, 0.05, 1.0])]
COURSE_PROFILES = {"baseline": 0, "mask_1": 1, "mask_2": 2, "mask_3": 3, "mask_4": 4}
COURSE_K = 5


def _course_sql() -> str:
    values = lambda rows: ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)
    parts = [" + ".join(["0.05::DOUBLE", *(f"CASE WHEN list_has_any(w, {keys}) THEN {v[i]}::DOUBLE ELSE 0.0::DOUBLE END" for keys, v in COURSE_FAMILIES)]) for i in range(4)]
    vector = f"list_transform([{', '.join(parts)}], lambda x, i: CASE WHEN i = gone THEN 0.0::DOUBLE ELSE x END)"
    return f"""WITH texts(id, t) AS (VALUES {values(enumerate(COURSE))}), asked(q, t, good) AS (VALUES {values((i, t, g) for i, (t, g) in enumerate(zip(COURSE_QUERIES, COURSE_RELEVANT)))}), profiles(profile, gone) AS (VALUES {values(COURSE_PROFILES.items())}),
 docs AS (SELECT profile, id, {vector} AS v FROM (SELECT id, string_split(t, ' ') AS w FROM texts) CROSS JOIN profiles), queries AS (SELECT profile, q, good, {vector} AS v FROM (SELECT q, good, string_split(t, ' ') AS w FROM asked) CROSS JOIN profiles),
 ranked AS (SELECT q.profile, q, id, good, row_number() OVER (PARTITION BY q.profile, q ORDER BY round(list_cosine_similarity(d.v, q.v), 12) DESC, id) AS rank FROM docs d JOIN queries q ON d.profile = q.profile),
 found AS (SELECT profile, q, min(CASE WHEN id = good AND rank <= {COURSE_K} THEN rank END) AS at_ FROM ranked GROUP BY profile, q),
 fits AS (SELECT profile, count(*) AS queries, avg(coalesce(1 / log2(at_ + 1), 0)) AS ndcg, avg(coalesce(1.0::DOUBLE / at_, 0)) AS mrr, avg(CASE WHEN at_ IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall FROM found GROUP BY profile),
 scored AS (SELECT *, 0.6 * ndcg + 0.2 * mrr + 0.2 * recall AS fitness FROM fits)
 SELECT s.profile, queries, {R('ndcg')} AS ndcg, {R('mrr')} AS mrr, {R('recall')} AS recall, {R('fitness')} AS fitness, CASE WHEN s.profile = 'baseline' THEN 'reference' WHEN round(fitness - b, 9) > 0.001 THEN 'candidate' WHEN round(fitness - b, 9) < -0.001 THEN 'reject' ELSE 'hold' END AS plan, b < 1 AS unsaturated FROM scored s CROSS JOIN (SELECT fitness AS b FROM scored WHERE profile = 'baseline')"""


@query("RUN-4", _course_sql())
def closed_course(spark: SparkSession, d: str) -> DataFrame:
    """The fixture's texts and queries under a matrix of profiles, and the plan that follows: what beats the baseline is a candidate.

    The baseline is not saturated, so there is room to be better.
    """
    from ..functions.text import keyword_embedding

    embed = keyword_embedding(F.col("t"), COURSE_FAMILIES, [0.05] * 4)
    texts = spark.createDataFrame(list(enumerate(COURSE)), "vec_id long, t string").select("vec_id", embed.alias("v"))
    asked = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(COURSE_QUERIES, COURSE_RELEVANT, strict=True))], "query_id long, t string, good long")
    qrels = asked.select("query_id", F.col("good").alias("vec_id"), F.lit(1.0).alias("grade"))
    queries, out = asked.select("query_id", embed.alias("q")), None
    for name, gone in COURSE_PROFILES.items():
        on = lambda c: F.transform(c, lambda x, i: F.when(i == gone - 1, 0.0).otherwise(x))  # noqa: B023, E731
        ranks = cosine_top_k(texts.withColumn("v", on("v")), queries.withColumn("q", on("q")), COURSE_K)
        row = metrics.per_query(ranks, qrels, k=COURSE_K).agg(F.lit(name).alias("profile"), F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"), F.avg("recall").alias("recall"))
        out = row if out is None else out.unionByName(row)
    scored = out.withColumn("fitness", 0.6 * F.col("ndcg") + 0.2 * F.col("mrr") + 0.2 * F.col("recall"))
    base = F.broadcast(scored.where("profile = 'baseline'").select(F.col("fitness").alias("b")))
    gain = F.round(F.col("fitness") - F.col("b"), 9)
    plan = F.when(F.col("profile") == "baseline", "reference").when(gain > 0.001, "candidate").when(gain < -0.001, "reject").otherwise("hold")
    return scored.crossJoin(base).select("profile", "queries", *(r6(c).alias(c) for c in ("ndcg", "mrr", "recall", "fitness")), plan.alias("plan"), (F.col("b") < 1).alias("unsaturated"))


_AT_3 = B.PER_QUERY.replace("FROM rankings r LEFT JOIN", "FROM (SELECT * FROM rankings WHERE rank <= 3) r LEFT JOIN").replace("least(relevant, 10)", "least(relevant, 3)")


@query("METRIC-11", sql(f"{B.TO_RANKINGS}, {_AT_3}", f"SELECT profile, query_id, {R('ndcg')} AS ndcg, {R('rr')} AS rr, {R('recall')} AS recall FROM metrics"))
def metrics_at_three(spark: SparkSession, d: str) -> DataFrame:
    found = metrics_of(B.scout(spark, d), k=3)
    return found.select("profile", "query_id", *(r6(c).alias(c) for c in ("ndcg", "rr", "recall")))


@query("MASK-8", sql(B.TO_SCOUT, "SELECT 'random_mask' AS profile, query_id, rank::INTEGER AS rank, vec_id FROM scout WHERE rank <= 10"))
def random_mask(spark: SparkSession, d: str) -> DataFrame:
    """The option is declared but read nowhere, so the profile equals the baseline."""
    return B.search(B.corpus(spark, d), B.RESULT_K).select(F.lit("random_mask").alias("profile"), "query_id", "rank", "vec_id")


