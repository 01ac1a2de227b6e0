"""Connected components of an edge table, by alternating stars; nothing but two sums per round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60
HUB_EDGES = 100_000
MOST_HUBS = 1_000_000  # that a broadcast holds


def _with_least(edges: DataFrame, least: DataFrame, hub_edges: int) -> DataFrame:
    """The edges ``(u, v)`` with the ``m`` of their ``u`` in ``least`` ``(u, m, n)``, n the number of edges of ``u``.

    Edges of hubs meet their value by a broadcast, so no task gathers them; at most edges / ``hub_edges`` nodes are hubs.
    """
    hubs = F.broadcast(least.where(F.col("n") >= hub_edges).select("u", F.col("m").alias("hub_m")))
    rest = least.where(F.col("n") < hub_edges).select("u", "m")
    marked = edges.join(hubs, "u", "left")
    plain = marked.where("hub_m is null").select("u", "v").join(rest, "u")
    return plain.select("u", "v", "m").union(marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def connected_components(edges: DataFrame, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``node, component`` for every end of the edges ``(a, b)``; a component is its smallest node.

    Each round hooks the larger neighbours of every node to its smallest neighbour, then the smaller ones; the rounds
    grow with the logarithm of the number of nodes.  Every round is written to the shared folder.  Null ends are no edge.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.written(edges, "edges")
    hub_edges = max(hub_edges, edges.count() // MOST_HUBS)
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least, hub_edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, root, hub_edges).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = common.written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        common.delete(spark, edges)
        edges = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
