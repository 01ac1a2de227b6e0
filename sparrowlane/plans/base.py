"""Shared inputs of the queries, in Spark and in SQL.

corpus: all embeddings as doubles.  queries: the rows whose id is divisible by 50, so the query set grows with the table;
a query's own row is not among its results.  centroids: the mean of each label, for operators that route.  scout: the 50
best rows of each query; a scouted row is relevant to a query of its label (judgements are pooled from what was scouted).
series: all events by user in time order, with a small value.  experiments: one score per profile (event type), task
(user modulo 4) and window (day), over all events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V
from ..operators import neighborhood as N
from ..operators.topk import cosine_top_k
from ..session import written

SCOUT_K, RESULT_K = 50, 10
BROADCAST_HITS = 200_000  # of three numbers each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), V.doubles(F.col("embedding")).alias("v"))


def centroids(rows: DataFrame) -> DataFrame:
    return V.mean_vector(rows, "v", "q", "label").withColumnRenamed("label", "query_id")


def queries(rows: DataFrame) -> DataFrame:
    """query_id, query_label, q."""
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("v").alias("q"))


def search(rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` other rows of each query."""
    return cosine_top_k(rows, queries(rows), k, own=False)


def scout(spark: SparkSession, sf_dir: str, k: int = SCOUT_K) -> DataFrame:
    """query_id, query_label, rank, vec_id, score, label, v, q; written once, since spread, masks and re-ranking all read it.

    Vectors are fetched by a broadcast of the hits where these are checked to be few, else by a join on the id.
    """
    rows = corpus(spark, sf_dir)
    top = written(search(rows, k), "hits")
    few = top.count() <= BROADCAST_HITS
    asked = queries(rows)
    return written(rows.join(F.broadcast(top) if few else top, "vec_id").join(F.broadcast(asked) if few else asked, "query_id"), "scout")


def reranked(hits: DataFrame, percentile: float = 0.85) -> DataFrame:
    return N.rerank(hits, N.variance_mask(N.dimension_stats(hits), percentile))


def rankings(hits: DataFrame) -> DataFrame:
    """profile, query_id, rank, vec_id for the profiles baseline, centered and masked."""
    stats = N.dimension_stats(hits)
    masks = N.variance_mask(stats)
    centered = N.rerank(hits, masks.withColumn("mask", F.transform("mask", lambda _: F.lit(1.0)))).select("query_id", "vec_id", F.col("new_rank").alias("centered"))
    rows = N.rerank(hits, masks).join(centered, ["query_id", "vec_id"])
    places = [F.struct(F.lit(name).alias("profile"), F.col(c).alias("rank")) for name, c in (("baseline", "rank"), ("centered", "centered"), ("masked", "new_rank"))]
    out = rows.select("query_id", "vec_id", F.explode(F.array(*places)).alias("p"))
    return out.select("p.profile", "query_id", "p.rank", "vec_id").where(F.col("rank") <= RESULT_K)


def qrels(hits: DataFrame) -> DataFrame:
    """query_id, vec_id, grade of the scouted rows of the query's label."""
    return hits.where("label = query_label").select("query_id", "vec_id", F.lit(1.0).alias("grade"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (user), seq, ts, event_type, v."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("key"), F.row_number().over(w).cast("long").alias("seq"), "event_id", "ts", "event_type", (F.col("value") / 10000.0).alias("v"))


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile, task, win, ndcg, n, and delta to the baseline profile of the same task and window (0 without one)."""
    e = table(spark, sf_dir, "events")
    scores = e.groupBy(F.col("event_type").alias("profile"), F.pmod("user_id", F.lit(4)).cast("long").alias("task"), F.to_date("ts").cast("string").alias("win")).agg((F.avg("value") / 100.0).alias("ndcg"), F.count("*").alias("n"))
    named = scores.crossJoin(F.broadcast(scores.agg(F.min("profile").alias("baseline_name"))))
    base = named.where("profile = baseline_name").select("task", "win", F.col("ndcg").alias("base"))
    out = named.join(base, ["task", "win"], "left")
    return out.withColumn("base", F.coalesce("base", F.lit(0.0))).withColumn("delta", F.col("ndcg") - F.col("base"))


# ---------------------------------------------------------------- SQL

CORPUS = "corpus AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
DIMS = "dims AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM corpus)"
CENTROIDS = "centroids AS (SELECT label AS query_id, list(m ORDER BY pos) AS q FROM (SELECT label, pos, avg(x) AS m FROM dims GROUP BY label, pos) GROUP BY label)"
QUERY_SET = "queries AS (SELECT vec_id AS query_id, label AS query_label, v AS q FROM corpus WHERE vec_id % 50 = 0)"
SCOUT = """scored AS (SELECT c.query_id, c.query_label, d.vec_id, d.label, d.v, c.q, list_cosine_similarity(d.v, c.q) AS score FROM corpus d CROSS JOIN queries c WHERE d.vec_id <> c.query_id),
scout AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 50)"""
STATS = """sdims AS (SELECT query_id, rank, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM scout),
stats AS (SELECT query_id, pos, avg(x) AS mean, var_pop(x) AS var FROM sdims GROUP BY query_id, pos),
spread AS (SELECT query_id, avg(var) AS global_variance FROM stats GROUP BY query_id),
cuts AS (SELECT query_id, quantile_cont(var, 0.85) AS cut FROM stats GROUP BY query_id),
masks AS (SELECT s.query_id, list(mean ORDER BY pos) AS mean, list(CASE WHEN var < cut THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY pos) AS mask
          FROM stats s JOIN cuts c ON s.query_id = c.query_id GROUP BY s.query_id)"""


def _moved(mask: str) -> tuple[str, str]:
    inner = "z[1] - z[2]" if not mask else "(z[1] - z[2]) * z[3]"
    third = ", m.mask" if mask else ""
    return tuple(f"list_transform(list_zip(s.{c}, m.mean{third}), lambda z: {inner})" for c in ("v", "q"))


def rerank_sql(name: str, mask: bool) -> str:
    v, q = _moved("mask" if mask else "")
    return f"""{name}_moved AS (SELECT s.query_id, s.rank, s.vec_id, s.label, {v} AS cv, {q} AS cq FROM scout s JOIN masks m ON s.query_id = m.query_id),
{name}_scored AS (SELECT *, CASE WHEN list_inner_product(cv, cv) * list_inner_product(cq, cq) > 0
   THEN list_inner_product(cv, cq) / (sqrt(list_inner_product(cv, cv)) * sqrt(list_inner_product(cq, cq))) ELSE 0.0::DOUBLE END AS new_score FROM {name}_moved),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, rank) AS new_rank FROM {name}_scored)"""


RERANKED = rerank_sql("masked", True)
RANKINGS = f"""{RERANKED}, {rerank_sql("centered", False)},
rankings AS (SELECT 'baseline' AS profile, query_id, rank, vec_id FROM scout WHERE rank <= 10
  UNION ALL SELECT 'masked', query_id, new_rank, vec_id FROM masked WHERE new_rank <= 10
  UNION ALL SELECT 'centered', query_id, new_rank, vec_id FROM centered WHERE new_rank <= 10),
qrels AS (SELECT query_id, vec_id, 1.0::DOUBLE AS grade FROM scout WHERE label = query_label)"""
QUERIES = f"{CORPUS}, {DIMS}, {CENTROIDS}, {QUERY_SET}"
TO_SCOUT = f"{QUERIES}, {SCOUT}"
TO_STATS = f"{TO_SCOUT}, {STATS}"
TO_RANKINGS = f"{TO_STATS}, {RANKINGS}"
PER_QUERY = """hits AS (SELECT r.*, coalesce(j.grade, 0.0::DOUBLE) AS grade FROM rankings r LEFT JOIN qrels j ON r.query_id = j.query_id AND r.vec_id = j.vec_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY profile, query_id ORDER BY grade DESC, rank) AS ideal,
  sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY profile, query_id ORDER BY rank) AS so_far FROM hits),
relevant AS (SELECT query_id, count(*) AS relevant FROM qrels WHERE grade > 0 GROUP BY query_id),
raw AS (SELECT profile, query_id, sum(grade / log2(rank + 1)) AS dcg, sum(grade / log2(ideal + 1)) AS idcg,
  sum(CASE WHEN grade > 0 THEN so_far / rank::DOUBLE ELSE 0 END) AS precisions, min(CASE WHEN grade > 0 THEN rank END) AS first_rank,
  count(*) FILTER (grade > 0) AS hits FROM ordered GROUP BY profile, query_id),
metrics AS (SELECT profile, raw.query_id, dcg, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0::DOUBLE END AS ndcg,
  CASE WHEN coalesce(relevant, 0) > 0 THEN precisions / least(relevant, 10) ELSE 0.0::DOUBLE END AS ap,
  coalesce(1.0::DOUBLE / first_rank, 0.0::DOUBLE) AS rr, CASE WHEN coalesce(relevant, 0) > 0 THEN hits / relevant::DOUBLE ELSE 0.0::DOUBLE END AS recall,
  first_rank, hits, coalesce(relevant, 0) AS relevant FROM raw LEFT JOIN relevant ON raw.query_id = relevant.query_id)"""
TO_METRICS = f"{TO_RANKINGS}, {PER_QUERY}"
SERIES = "series AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts, event_type, value / 10000.0::DOUBLE AS v FROM events)"
EXPERIMENTS = """scores AS (SELECT event_type AS profile, (user_id % 4)::BIGINT AS task, ts::DATE::VARCHAR AS win, avg(value) / 100.0::DOUBLE AS ndcg, count(*) AS n FROM events GROUP BY ALL),
base AS (SELECT task, win, ndcg AS base FROM scores WHERE profile = (SELECT min(event_type) FROM events)),
experiments AS (SELECT s.*, coalesce(b.base, 0.0::DOUBLE) AS base, s.ndcg - coalesce(b.base, 0.0::DOUBLE) AS delta, (SELECT min(event_type) FROM events) AS baseline_name
  FROM scores s LEFT JOIN base b ON s.task = b.task AND s.win = b.win)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def r6_sql(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0::DOUBLE"
