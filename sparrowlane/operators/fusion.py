"""Fusion of the rankings of several variants or leaves, and overlap of result sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .topk import ranked


def reciprocal_rank_fusion(rankings: DataFrame, k: float = 60.0, doc: str = "vec_id", variant: str = "variant", most: int = 10) -> DataFrame:
    """``query_id, doc, score, rank``: sums of 1 / (k + rank) to twelve digits, rank from 1; ties by first appearance.

    Ranks from 0, as the leaves of a tree are fused by, are a ``k`` less by one.
    """
    fused = rankings.groupBy("query_id", doc).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct(variant, "rank")).alias("first"))
    return ranked(fused, most, ["query_id"], F.col("score").desc(), "first").drop("first")


def union_fusion(rankings: DataFrame, doc: str = "vec_id", variant: str = "variant", most: int = 10) -> DataFrame:
    """Score 1 / best rank."""
    fused = rankings.groupBy("query_id", doc).agg((1.0 / F.min("rank")).alias("score"), F.min(F.struct(variant, "rank")).alias("first"))
    return ranked(fused, most, ["query_id"], F.col("score").desc(), "first").drop("first")


def intersection_fusion(rankings: DataFrame, doc: str = "vec_id", variant: str = "variant", most: int = 10) -> DataFrame:
    """Documents of all variants by 1 / mean rank, ties by id; a query without any falls back to the union."""
    asked = rankings.groupBy("query_id").agg(F.countDistinct(variant).alias("variants"))
    found = rankings.groupBy("query_id", doc).agg(F.countDistinct(variant).alias("n"), F.avg("rank").alias("mean_rank"), F.min("rank").alias("best"), F.min(F.struct(variant, "rank")).alias("first")).join(asked, "query_id")
    inside = F.col("n") == F.col("variants")
    found = found.withColumn("shared", F.max(inside).over(Window.partitionBy("query_id"))).where(~F.col("shared") | inside)
    score = F.when(F.col("shared"), 1.0 / F.col("mean_rank")).otherwise(1.0 / F.col("best"))
    found = found.select("query_id", doc, score.alias("score"), F.when(~F.col("shared"), F.col("first")).alias("first"))
    return ranked(found, most, ["query_id"], F.col("score").desc(), "first", doc).drop("first")


def overlaps(rankings: DataFrame, doc: str = "vec_id", item: str = "query_id") -> DataFrame:
    """``a, b, jaccard`` of the result sets of items that share a document, by an inverted index and not by all pairs."""
    sizes = rankings.groupBy(item).agg(F.countDistinct(doc).alias("n"))
    left = rankings.select(F.col(item).alias("a"), doc).distinct()
    right = rankings.select(F.col(item).alias("b"), doc).distinct()
    common = left.join(right, doc).where("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    common = common.join(sizes.select(F.col(item).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(item).alias("b"), F.col("n").alias("nb")), "b")
    return common.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))
