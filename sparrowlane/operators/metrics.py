"""Retrieval metrics of rankings against relevance judgements; one grouped pass gives them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def judged(rankings: DataFrame, qrels: DataFrame, doc: str = "vec_id") -> DataFrame:
    """Rankings with ``grade``, 0 for documents without judgement."""
    return rankings.join(qrels, ["query_id", doc], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))


def gain(grade: Column, rank: Column) -> Column:
    return grade / F.log2(rank + 1.0)


def per_query(rankings: DataFrame, qrels: DataFrame, k: int = 10, doc: str = "vec_id", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``keys``, dcg, ndcg, ap, rr, recall, first_relevant_rank, hits, relevant at cutoff ``k``.

    The ideal order is that of the retrieved grades, as the definition asks; a query without hits scores 0.
    """
    rows = judged(rankings.where(F.col("rank") <= k), qrels, doc)
    by = Window.partitionBy(*keys)
    rows = rows.withColumn("hit", (F.col("grade") > 0).cast("double"))
    rows = rows.withColumn("ideal", F.row_number().over(by.orderBy(F.col("grade").desc(), "rank")))
    rows = rows.withColumn("so_far", F.sum("hit").over(by.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    relevant = qrels.where("grade > 0").groupBy("query_id").agg(F.count("*").alias("relevant"))
    out = rows.groupBy(*keys).agg(
        F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"),
        F.sum(gain(F.col("grade"), F.col("ideal"))).alias("idcg"),
        F.sum(F.col("hit") * F.col("so_far") / F.col("rank")).alias("precisions"),
        F.min(F.when(F.col("hit") > 0, F.col("rank"))).alias("first_relevant_rank"),
        F.sum("hit").cast("long").alias("hits"),
    )
    out = out.join(relevant, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    safe = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    return out.select(
        *keys, "dcg", safe(F.col("dcg"), F.col("idcg")).alias("ndcg"), safe(F.col("precisions"), F.least("relevant", F.lit(k))).alias("ap"),
        F.coalesce(1.0 / F.col("first_relevant_rank"), F.lit(0.0)).alias("rr"), safe(F.col("hits"), F.col("relevant")).alias("recall"), "first_relevant_rank", "hits", "relevant",
    )


def rank_delta(candidate: Column, baseline: Column) -> Column:
    """Candidate minus baseline rank; 999 if only the candidate misses, -999 if only the baseline does, null if both."""
    return F.when(candidate.isNull() & baseline.isNull(), F.lit(None).cast("int")).when(candidate.isNull(), 999).when(baseline.isNull(), -999).otherwise(candidate - baseline)
