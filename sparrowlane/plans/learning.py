"""Queries: training cycles with fit, write-back and rollback; losses, evolution, mask pre-training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import adapters as A
from ..operators import graph, storage
from ..operators import neighborhood as N
from ..operators import training as L
from ..operators.blocks import matrix_of
from ..operators.topk import ranked, route_scores
from ..registry import query
from ..session import new_path, written
from ..sources import collection as C
from ..sources.checkpoints import Checkpoints
from . import base as B
from .base import r6, sql
from .base import r6_sql as R

RANK, EPOCHS, RATE = 4, 10, 0.05
PAIRED = f"{B.QUERIES}, paired AS (SELECT c.vec_id, c.label, c.v, q.q FROM corpus c JOIN centroids q ON c.label = q.query_id)"
TARGETS = f"""{PAIRED}, pushed AS (SELECT *, list_transform(list_zip(v, q), lambda z: z[1] + (z[1] - z[2]) / list_distance(v, q) * 0.1::DOUBLE) AS p FROM paired),
homeo AS (SELECT *, list_transform(p, lambda x: x / sqrt(list_inner_product(p, p))) AS h, list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))) AS teacher FROM pushed),
blends AS (SELECT *, list_transform(list_zip(h, q), lambda z: 0.5::DOUBLE * z[1] + 0.5::DOUBLE * z[2]) AS b FROM homeo),
modes AS (SELECT vec_id, label, v, 'baseline' AS mode, h AS t FROM homeo UNION ALL SELECT vec_id, label, v, 'offline', teacher FROM homeo UNION ALL SELECT vec_id, label, v, 'hybrid', list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) FROM blends)"""
MODES = ("baseline", "offline", "hybrid")


def paired(spark: SparkSession, d: str) -> DataFrame:
    rows = B.corpus(spark, d)
    return rows.join(B.centroids(rows).withColumnRenamed("query_id", "label"), "label")


def _with_target(rows: DataFrame, mode: str) -> DataFrame:
    return L.with_targets(rows, mode, A.homeostatic_target(F.col("v"), F.col("q")), F.col("q"))


# ---------------------------------------------------------------- cycles

@query("LEARN-1", sql(TARGETS, f"SELECT vec_id, mode, {R('t[1]')} AS first_value, {R('list_distance(v, t)')} AS distance FROM modes"))
def training_targets(spark: SparkSession, d: str) -> DataFrame:
    """What a cycle trains on, by mode: pushed from the noise, the teacher's vector, or the blend of both."""
    rows = paired(spark, d)
    out = None
    for mode in MODES:
        one = _with_target(rows, mode).select("vec_id", F.lit(mode).alias("mode"), r6(F.element_at("t", 1)).alias("first_value"), r6(V.norm(V.subtract(F.col("v"), F.col("t")))).alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out


def chelation_log(hits: DataFrame) -> DataFrame:
    """``vec_id, centre``: each re-ranked result of a query of large spread is logged with the centre of its neighbourhood."""
    stats = N.dimension_stats(hits)
    masks = N.variance_mask(stats)
    s = N.spread(stats)
    cut = F.broadcast(s.agg(F.percentile("global_variance", F.lit(0.5)).alias("cut")))
    wide = s.crossJoin(cut).where("global_variance > cut").select("query_id")
    return N.rerank(hits, masks).where("new_rank <= 10").join(wide, "query_id").select("vec_id", F.col("mean").alias("centre"))


def cycle(spark: SparkSession, collection: DataFrame, log: DataFrame, least: int, mode: str, epochs: int, rate: float, noise: float = 0.0, fails: str = "false") -> tuple[DataFrame, DataFrame, L.LowRank | None]:
    """A training cycle: the collection after it, the log after it (emptied), and the adapter; None where nothing collapsed.

    ``collection`` has vec_id, v, q (the teacher's vector) and label as payload.  The vectors are written back in one
    table and only if every write is good (``fails`` marks those that are not, for tests); else the collection and the
    adapter stay as they were, from a checkpoint.
    """
    targets = written(L.collapse_targets(log, least), "targets")
    empty = log.limit(0)
    if epochs == 0 or targets.isEmpty():
        return collection, empty, None
    chosen = collection.join(targets, "vec_id")
    chosen = L.with_targets(chosen, mode, A.homeostatic_target(F.col("v"), F.col("noise")), F.col("q"))
    if noise > 0:
        chosen = L.noisy(chosen, "v", "entries", noise, 0.1, "vec_id")
    chosen = written(chosen, "training")
    dim = chosen.select(F.size("v")).first()[0]
    adapter = L.LowRank.seeded(dim, RANK).trained(L.moments(chosen)[None], epochs, rate)
    store = Checkpoints(spark, new_path(spark, "cycles"))
    store.create(collection, "before")
    new = adapter.apply(collection.join(targets.select("vec_id"), "vec_id", "left_semi"), "v", "v", "vec_id").withColumn("version", F.lit(1))
    new = new.withColumn("v", F.when(F.expr(fails), F.slice("v", 1, 1)).otherwise(F.col("v")))
    bad = new.where(~V.valid(F.col("v"), dim)).count()
    if bad:
        return store.restore("before"), log, None
    payload = collection.drop("v")
    updates = new.join(payload, "vec_id")
    return written(C.upserted(collection, updates.select(*collection.columns, "version"), "vec_id"), "collection"), empty, adapter


@query("LEARN-1-CYCLE")
def sedimentation_cycle(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: a whole cycle of each mode over the collection; the test does the same with plain numpy.

    Rows that were logged twice or more are collapse targets; the others keep their vectors.
    """
    collection = written(paired(spark, d).select("vec_id", "label", "v", "q"), "collection")
    log = written(chelation_log(B.scout(spark, d)), "log")
    out = None
    for mode in MODES:
        after, _, adapter = cycle(spark, collection, log, 2, mode, EPOCHS, RATE, noise=0.02 if mode == "hybrid" else 0.0)
        old = collection.select("vec_id", F.col("v").alias("old"))
        losses = adapter.losses if adapter else [0.0]
        one = after.join(old, "vec_id").select(F.lit(mode).alias("mode"), "vec_id", (F.col("v") != F.col("old")).alias("updated"), r6(V.norm(V.subtract(F.col("v"), F.col("old")))).alias("moved"), F.lit(round(losses[0], 9)).alias("first_loss"), F.lit(round(losses[-1], 9)).alias("last_loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query("LEARN-2", sql(f"{PAIRED}, mixed AS (SELECT vec_id, list_transform(list_zip(v, q), lambda z: 0.5::DOUBLE * z[1] + 0.5::DOUBLE * z[2]) AS t FROM paired)", f"SELECT vec_id, {R('sqrt(list_inner_product(t, t))')} AS length, {R('t[1] / greatest(sqrt(list_inner_product(t, t)), 1e-9)')} AS first_value FROM mixed"))
def offline_targets(spark: SparkSession, d: str) -> DataFrame:
    """Distillation targets of the whole corpus: half student, half teacher (the cluster's centre)."""
    mixed = F.zip_with("v", "q", lambda s, t: 0.5 * s + 0.5 * t)
    return paired(spark, d).select("vec_id", r6(V.norm(mixed)).alias("length"), r6(F.element_at(A.blend(F.col("v"), F.col("q"), 0.5), 1)).alias("first_value"))


@query("LEARN-2-CYCLE")
def offline_distillation(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: the fit of the whole corpus to its distillation targets, and every vector through the adapter; tested with numpy."""
    rows = written(paired(spark, d).withColumn("t", A.blend(F.col("v"), F.col("q"), 0.5)), "training")
    dim = rows.select(F.size("v")).first()[0]
    adapter = L.LowRank.seeded(dim, RANK).trained(L.moments(rows)[None], EPOCHS, RATE)
    moved = adapter.apply(rows, "v", "y", "vec_id", "v", "t")
    return moved.select("vec_id", r6(V.cosine(F.col("v"), F.col("t"))).alias("before"), r6(V.cosine(F.col("y"), F.col("t"))).alias("after"), F.lit(round(adapter.losses[0], 9)).alias("first_loss"), F.lit(round(adapter.losses[-1], 9)).alias("last_loss"))


@query("LEARN-3", sql(TARGETS, f"SELECT label, count(*) AS n, {R('avg(list_inner_product(list_transform(list_zip(v, t), lambda z: z[1] - z[2]), list_transform(list_zip(v, t), lambda z: z[1] - z[2])) / 64)', 9)} AS loss FROM modes WHERE mode = 'baseline' GROUP BY label"))
def cluster_losses(spark: SparkSession, d: str) -> DataFrame:
    """The mean squared error that each cluster's pass starts from."""
    error = V.subtract(F.col("v"), F.col("t"))
    return _with_target(paired(spark, d), "baseline").groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(V.dot(error, error) / 64), 9).alias("loss"))


CLUSTERS = 8


@query("LEARN-3-CYCLE")
def hierarchical_sedimentation(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: one adapter, trained on one cluster after another and then on all rows at a tenth of the rate; tested with numpy.

    Clusters are those of the variance-median partition.  Their number is a parameter, since the passes follow one another;
    each cluster's moments come from one pass over all rows.
    """
    rows = written(_with_target(paired(spark, d), "baseline").select("vec_id", "v", "t"), "training")
    cells = graph.variance_median_partition(rows.select("vec_id", "v"), CLUSTERS, "vec_id", "v").withColumnRenamed("id", "vec_id")
    clustered = written(rows.join(cells, "vec_id"), "clustered")
    by_cluster, whole = L.moments(clustered, group="cluster"), L.moments(rows)[None]
    adapter = L.LowRank.seeded(len(whole.xx), RANK)
    found = []
    for name in sorted(by_cluster):
        trained = L.LowRank(adapter.u, adapter.v).trained(by_cluster[name], EPOCHS, RATE)
        found.append((name, by_cluster[name].n, by_cluster[name].loss(adapter.matrix), by_cluster[name].loss(trained.matrix)))
        adapter = trained
    last = L.LowRank(adapter.u, adapter.v).trained(whole, EPOCHS, RATE * 0.1)
    found.append(("*", whole.n, whole.loss(adapter.matrix), whole.loss(last.matrix)))
    return spark.createDataFrame([(c, n, round(a, 9), round(b, 9)) for c, n, a, b in found], "cluster string, n long, before double, after double")


_WRITTEN = f"{TARGETS}, new AS (SELECT vec_id, label, v, CASE WHEN vec_id % 97 = 0 THEN t[1:3] WHEN vec_id % 89 = 0 THEN list_transform(t, lambda x: 'nan'::DOUBLE) ELSE t END AS t FROM modes WHERE mode = 'baseline'), checked AS (SELECT *, len(t) = 64 AND len(list_filter(t, lambda x: NOT isfinite(x))) = 0 AS good FROM new)"


@query("LEARN-4", sql(_WRITTEN, f"SELECT vec_id, label, good AS updated, {R('CASE WHEN good THEN t[1] ELSE v[1] END')} AS first_value, (SELECT count(*) FILTER (NOT good) FROM checked) AS failures FROM checked"))
def write_back(spark: SparkSession, d: str) -> DataFrame:
    """New vectors replace old ones in one table and keep the payload; those of a wrong size or not finite fail and change nothing."""
    rows = _with_target(paired(spark, d), "baseline")
    base = written(rows.select("vec_id", "label", "v"), "collection")
    bad = F.when(F.col("vec_id") % 97 == 0, F.slice("t", 1, 3)).when(F.col("vec_id") % 89 == 0, F.transform("t", lambda x: F.lit(float("nan")))).otherwise(F.col("t"))
    new = written(rows.select("vec_id", "label", bad.alias("v")).withColumn("good", V.valid(F.col("v"), 64)), "updates")
    updated = C.upserted(base, new.where("good").drop("good").withColumn("version", F.lit(1)), "vec_id")
    failures = F.broadcast(new.agg(F.count_if(~F.col("good")).alias("failures")))
    return updated.join(new.select("vec_id", F.col("good").alias("updated")), "vec_id").crossJoin(failures).select("vec_id", "label", "updated", r6(F.element_at("v", 1)).alias("first_value"), "failures")


@query("LEARN-7", sql(B.TO_SCOUT, "SELECT query_id, vec_id AS negative, n::INTEGER AS place FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM scout WHERE label <> query_label) WHERE n <= 3"))
def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = B.scout(spark, d).where("label <> query_label").withColumnRenamed("rank", "scout_rank")
    return ranked(rows, 3, ["query_id"], "scout_rank").select("query_id", F.col("vec_id").alias("negative"), F.col("rank").alias("place"))


# ---------------------------------------------------------------- losses

_LOSS = f"{B.QUERIES}, pairs AS (SELECT c.vec_id, c.label, q.query_id, list_cosine_similarity(c.v, q.q) AS s FROM corpus c CROSS JOIN centroids q), mse AS (SELECT c.vec_id, list_inner_product(list_transform(list_zip(c.v, q.q), lambda z: z[1] - z[2]), list_transform(list_zip(c.v, q.q), lambda z: z[1] - z[2])) / 64 AS mse FROM corpus c JOIN centroids q ON c.label = q.query_id)"
_PER_ROW = "per AS (SELECT p.vec_id, any_value(label) AS label, ln(sum(exp(s / 0.07))) - max(CASE WHEN label = query_id THEN s / 0.07 END) AS nce, max(CASE WHEN label = query_id THEN s END) AS good, max(CASE WHEN label <> query_id THEN s END) AS bad, any_value(m.mse) AS mse FROM pairs p JOIN mse m ON p.vec_id = m.vec_id GROUP BY p.vec_id)"


def _route_losses(spark: SparkSession, d: str) -> DataFrame:
    """label, good (own centroid), bad (best other), nce, mse of each row: one pass over the rows, centroids in blocks."""
    rows = B.corpus(spark, d)
    targets = written(B.centroids(rows), "centroids")
    scores = route_scores(rows, targets).select(F.col("id").alias("vec_id"), F.col("own").alias("good"), F.col("other").alias("bad"), (F.col("log_sum") - F.col("own") / 0.07).alias("nce"))
    error = V.subtract(F.col("v"), F.col("q"))
    mse = rows.join(targets.withColumnRenamed("query_id", "label"), "label").select("vec_id", "label", (V.dot(error, error) / 64).alias("mse"))
    return mse.join(scores, "vec_id")


@query("LEARN-5", sql(f"{_LOSS}, {_PER_ROW}", f"SELECT label, {R('avg(mse)', 9)} AS mse, {R('avg(nce)')} AS info_nce, {R('0.5 * avg(mse) + 0.5 * avg(nce)')} AS hybrid FROM per GROUP BY label"))
def training_losses(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared error to the target, InfoNCE with all other targets as negatives (temperature 0.07), and half of each."""
    mse, nce = F.avg("mse"), F.avg("nce")
    return _route_losses(spark, d).groupBy("label").agg(r6(mse, 9).alias("mse"), r6(nce).alias("info_nce"), r6(0.5 * mse + 0.5 * nce).alias("hybrid"))


@query("LEARN-6", sql(f"{_LOSS}, {_PER_ROW}", f"SELECT label, {R('avg(greatest(0, 0.3 - good + bad))')} AS triplet_pairs, {R('greatest(0, 0.3 - avg(good) + avg(bad))')} AS triplet_mean, {R('avg(-ln(exp(good / 0.07) / (exp(good / 0.07) + exp(bad / 0.07))))')} AS info_nce, {R('avg(1 - good)')} AS cosine_loss FROM per GROUP BY label"))
def online_losses(spark: SparkSession, d: str) -> DataFrame:
    """Triplet margin by pairs and of the means, InfoNCE of one positive and one negative, cosine."""
    good, bad = F.col("good"), F.col("bad")
    nce = F.ln(1 + F.exp((bad - good) / 0.07))
    clip = lambda x: F.greatest(F.lit(0.0), x)
    return _route_losses(spark, d).groupBy("label").agg(r6(F.avg(clip(0.3 - good + bad))).alias("triplet_pairs"), r6(clip(0.3 - F.avg(good) + F.avg(bad))).alias("triplet_mean"), r6(F.avg(nce)).alias("info_nce"), r6(F.avg(1 - good)).alias("cosine_loss"))


# ---------------------------------------------------------------- evolution

def _history(spark: SparkSession, history: list[L.Generation], name: str) -> DataFrame:
    rows = [(name, g.number, *(round(x, 9) for x in (g.mean, g.best, g.fitness, g.elite)), g.rolled_back) for g in history]
    return spark.createDataFrame(rows, "run string, generation int, mean double, best double, fitness double, elite double, rolled_back boolean")


SHAPINGS = ("zscore", "centered_rank", "linear_rank")


@query("LEARN-8")
def evolution(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: seeded noise.  An adapter's first factor evolves towards the targets of the whole corpus, once for each shaping.

    A member's fitness is the negative squared error from the moments of all rows, so a generation reads no rows again; the
    test does the same on plain arrays.
    """
    rows = _with_target(paired(spark, d), "baseline").select("vec_id", "v", "t")
    m = L.moments(rows)[None]
    start = L.LowRank.seeded(len(m.xx), RANK)
    fitness = lambda u: -m.loss(L.LowRank(u, start.v).matrix)
    score = lambda u, steps: np.array([fitness(u + s) for s in steps] + [fitness(u)])
    out = None
    for shaping in SHAPINGS:
        _, history = L.evolve(start.u, score, 5, seed=42, shaping=shaping, antithetic=shaping == "zscore")
        one = _history(spark, history, shaping)
        out = one if out is None else out.unionByName(one)
    return out


def online_candidates(hits: DataFrame) -> DataFrame:
    """The scouted rows of queries with four or more, the first half positive."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 4")
    return hits.join(n, "query_id").select("query_id", "q", "v", (F.col("rank") - 1 < F.floor(F.col("n") / 2)).alias("positive"), "n")


@query("LEARN-9", sql(B.TO_SCOUT, f"SELECT query_id, {R('avg(score) FILTER (rank <= 25) - avg(score) FILTER (rank > 25)')} AS fitness FROM scout GROUP BY query_id"))
def online_fitness(spark: SparkSession, d: str) -> DataFrame:
    """Positive minus negative similarity of each query: what an online update starts from."""
    half = lambda c: F.avg(F.when(c, F.col("score")))
    return B.scout(spark, d).groupBy("query_id").agg(r6(half(F.col("rank") <= 25) - half(F.col("rank") > 25)).alias("fitness"))


def _similarity_gap(batch, matrix: np.ndarray) -> np.ndarray:
    """Signed similarities of adapted rows to adapted queries; their mean is half the gap of the two sides."""
    q, v = (L.unit_rows(matrix_of(batch.column(c)) @ matrix) for c in ("q", "v"))
    sign = np.where(batch.column("positive").to_numpy(zero_copy_only=False), 1.0, -1.0)
    return sign * np.sum(q * v, axis=1)


@query("LEARN-9-EVOLVED")
def online_evolution(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: seeded noise.  The adapter evolves on positive minus negative similarity; a population is one pass over the scouted rows."""
    rows = written(online_candidates(B.scout(spark, d)), "candidates")
    dim = rows.select(F.size("v")).first()[0]
    start = L.LowRank.seeded(dim, RANK)
    matrix = lambda u: L.LowRank(u, start.v).matrix
    score = lambda u, steps: L.population_means(rows, _similarity_gap, [matrix(x) for x in (*(u + s for s in steps), u)], ["q", "v", "positive"])
    _, history = L.evolve(start.u, score, 3, members=8, seed=7)
    return _history(spark, history, "online")


@query("LEARN-10", sql(B.TO_STATS, "SELECT query_id, (pos - 1)::INTEGER AS pos, var < cut AS target FROM stats JOIN cuts USING (query_id)"))
def mask_examples(spark: SparkSession, d: str) -> DataFrame:
    masks = N.variance_mask(N.dimension_stats(B.scout(spark, d)))
    return masks.select("query_id", F.posexplode("mask").alias("pos", "m")).select("query_id", "pos", (F.col("m") > 0).alias("target"))


BUFFER = 1000  # examples that the predictor keeps: the newest


@query("LEARN-10-TRAINED")
def mask_pretraining(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: gradient steps.  The predictor learns the masks of the newest neighbourhoods in its buffer; tested with numpy."""
    stats = N.dimension_stats(B.scout(spark, d))
    spread = V.assembled(stats, "var", "vars", "query_id")
    rows = N.variance_mask(stats).join(spread, "query_id").orderBy(F.col("query_id").desc()).limit(BUFFER).collect()
    features = np.array([[*r["mean"], *r["vars"]] for r in rows])
    masks = np.array([r["mask"] for r in rows])
    predict, losses = L.fit_mask_predictor(features, masks)
    found = predict(features)
    out = [(p, round(float(masks[:, p].mean()), 6), round(float((found[:, p] >= 0.5).mean()), 6), round(losses[0], 6), round(losses[-1], 6)) for p in range(masks.shape[1])]
    return spark.createDataFrame(out, "pos int, target double, predicted double, first_loss double, last_loss double")


_MEMBERS = f"""{PAIRED}, parts AS (SELECT vec_id, unnest(v) AS x, unnest(q) AS y, generate_subscripts(v, 1) AS pos, list_inner_product(v, q) AS dot, list_inner_product(v, v) AS vv, sqrt(list_inner_product(q, q)) AS qn FROM paired),
members AS (SELECT (pos - 1)::BIGINT AS member, avg(CASE WHEN vv - x * x > 1e-24 THEN (dot - x * y) / (sqrt(vv - x * x) * qn) ELSE 0.0::DOUBLE END) AS fitness FROM parts GROUP BY pos),
queues AS (SELECT member % 4 AS drive, count(*) AS depth FROM members GROUP BY 1)"""


@query("LEARN-12", sql(_MEMBERS, f"SELECT member, {R('fitness', 9)} AS fitness, (member % 4)::BIGINT AS drive, (row_number() OVER (ORDER BY round(fitness, 12) DESC, member) = 1) AS best, {R('(SELECT (1 + least(max(depth), 16) * 100 + greatest(max(depth) - 16, 0) * 200) / 1000.0::DOUBLE FROM queues)')} AS latency_ms FROM members"))
def population_evaluator(spark: SparkSession, d: str) -> DataFrame:
    """A population of masks, member i without dimension i, evaluated over all rows: mean cosine to the centroid.

    Members are dealt to four drives in turn; the latency is that of the longest queue.
    """
    rows = paired(spark, d).select(F.arrays_zip("v", "q").alias("z"), V.dot(F.col("v"), F.col("q")).alias("dot"), V.dot(F.col("v"), F.col("v")).alias("vv"), V.norm(F.col("q")).alias("qn"))
    flat = rows.select("dot", "vv", "qn", F.posexplode("z").alias("member", "c"))
    rest = F.col("vv") - F.col("c.v") * F.col("c.v")
    members = written(flat.groupBy(F.col("member").cast("long").alias("member")).agg(F.avg(F.when(rest > 1e-24, (F.col("dot") - F.col("c.v") * F.col("c.q")) / (F.sqrt(rest) * F.col("qn"))).otherwise(0.0)).alias("fitness")), "members")
    best = F.broadcast(members.agg(F.min(F.struct((-F.round("fitness", 12)).alias("low"), "member")).alias("top")))
    depth = F.broadcast(members.groupBy(F.col("member") % 4).agg(F.count("*").alias("depth")).agg(F.max("depth").alias("depth")))
    latency = storage.latency_us(F.lit(100.0), F.lit(1.0), F.lit(16), F.col("depth")) / 1000
    return members.crossJoin(best).crossJoin(depth).select("member", r6("fitness", 9).alias("fitness"), (F.col("member") % 4).alias("drive"), (F.col("member") == F.col("top.member")).alias("best"), r6(latency).alias("latency_ms"))


def _retrieval_fitness(batch, matrix: np.ndarray) -> np.ndarray:
    """0.6 NDCG + 0.2 MRR + 0.2 recall at ten of each query in the batch, after its scouted rows went through the adapter."""
    out = []
    for row in batch.to_pylist():
        q, v = L.unit_rows(np.array([row["q"]]) @ matrix)[0], L.unit_rows(np.array(row["vs"]).reshape(len(row["grades"]), -1) @ matrix)
        grades = np.array(row["grades"])[np.argsort(-np.round(v @ q, 12), kind="stable")]
        top, discount = grades[:10], 1 / np.log2(np.arange(2, 2 + len(grades[:10])))
        ideal = float(np.sort(top)[::-1] @ discount)
        hit = np.flatnonzero(top > 0)
        ndcg = float(top @ discount) / ideal if ideal else 0.0
        out.append(0.6 * ndcg + 0.2 * (1 / (hit[0] + 1) if len(hit) else 0.0) + 0.2 * (float(top.sum() / grades.sum()) if grades.sum() else 0.0))
    return np.array(out)


@query("LEARN-13")
def retrieval_fitness_cycles(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: seeded noise.  Three cycles evolve an adapter directly on retrieval fitness; a population is one pass over the queries.

    A query's scouted rows are one row of fifty vectors; the test scores the same with plain loops.
    """
    hits = B.scout(spark, d)
    packed = hits.groupBy("query_id").agg(F.any_value("q").alias("q"), F.array_sort(F.collect_list(F.struct("rank", "v", F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(0.0).alias("g")))).alias("r"))
    rows = written(packed.select("q", F.flatten(F.transform("r", lambda x: x["v"])).alias("vs"), F.transform("r", lambda x: x["g"]).alias("grades")), "rounds")
    dim = hits.select(F.size("v")).first()[0]
    adapter = L.LowRank.seeded(dim, RANK)
    matrix = lambda u: L.LowRank(u, adapter.v).matrix
    score = lambda u, steps: L.population_means(rows, _retrieval_fitness, [matrix(x) for x in (*(u + s for s in steps), u)], ["q", "vs", "grades"])
    u, out = adapter.u, None
    for number in range(3):
        u, history = L.evolve(u, score, 1, members=8, sigma=0.2, rate=0.5, seed=11 + number)
        one = _history(spark, history, f"cycle-{number}")
        out = one if out is None else out.unionByName(one)
    return out
