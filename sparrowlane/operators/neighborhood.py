"""Spread of a query's neighbourhood, masks from it, and re-ranking in the centred and masked space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from .topk import ranked


def dimension_stats(scout: DataFrame) -> DataFrame:
    """``query_id, pos, mean, var`` (population) of the scouted vectors."""
    return V.exploded(scout, "v", "query_id").groupBy("query_id", "pos").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def spread(stats: DataFrame) -> DataFrame:
    """``query_id, global_variance``: mean of the dimensions' variances."""
    return stats.groupBy("query_id").agg(F.avg("var").alias("global_variance"))


def variance_mask(stats: DataFrame, percentile: float = 0.85, inverted: bool = False) -> DataFrame:
    """``query_id, mean, mask`` arrays: 1 where the variance is strictly under the percentile (inverted: over 1 - it)."""
    cut = stats.groupBy("query_id").agg(F.percentile("var", F.lit(1 - percentile if inverted else percentile)).alias("cut"))
    keep = F.col("var") > F.col("cut") if inverted else F.col("var") < F.col("cut")
    rows = stats.join(cut, "query_id").withColumn("bit", F.when(keep, 1.0).otherwise(0.0))
    packed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "bit"))).alias("r"))
    return packed.select("query_id", F.transform("r", lambda x: x["mean"]).alias("mean"), F.transform("r", lambda x: x["bit"]).alias("mask"))


def rerank(scout: DataFrame, masks: DataFrame, temperature: float = 1.0) -> DataFrame:
    """The scout rows with ``new_score`` and ``new_rank``: centred, masked cosine; ties keep the scout order."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    rows = scout.join(masks, "query_id")
    rows = rows.withColumn("cv", V.masked(V.subtract(F.col("v"), F.col("mean")), F.col("mask"))).withColumn("cq", V.masked(V.subtract(F.col("q"), F.col("mean")), F.col("mask")))
    rows = rows.withColumn("new_score", V.cosine(F.col("cv"), F.col("cq")) / temperature).drop("cv", "cq")
    return ranked(rows.withColumnRenamed("rank", "scout_rank"), None, ["query_id"], F.col("new_score").desc(), "scout_rank").withColumnsRenamed({"rank": "new_rank", "scout_rank": "rank"})


def decision(variance: Column, threshold: Column, quantized: bool, centering: bool) -> Column:
    """CHELATE, CHELATE_ALWAYS or FAST."""
    if quantized:
        return F.when((variance > threshold) | F.lit(centering), "CHELATE").otherwise("FAST")
    return F.lit("CHELATE_ALWAYS" if centering else "FAST")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones give 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
