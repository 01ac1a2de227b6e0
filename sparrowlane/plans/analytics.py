"""Queries: event log, windows, aggregates and joins over experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V
from ..operators import events as E
from ..operators import gates, graph, storage
from ..operators import neighborhood as N
from ..operators import windows as W
from ..operators.ordering import consecutive
from ..operators.topk import ranked, similar_pairs
from ..registry import query
from . import base as B
from .base import r6, sql
from .base import r6_sql as R

# ---------------------------------------------------------------- event log

def _events(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "events")


@query("PRJ-7", "SELECT event_type, count(*) AS n, count(*) FILTER (json_exists(props, '$.k')) AS with_key FROM events GROUP BY event_type")
def event_filter(spark: SparkSession, d: str) -> DataFrame:
    has = F.array_contains(F.json_object_keys("props"), "k")
    return _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(has).alias("with_key"))


_SUMMARY = """p AS (SELECT event_id, event_type, user_id, value, epoch_us(ts) AS us, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, (SELECT min(event_type) FROM events) AS first FROM events),
l AS (SELECT value, row_number() OVER (ORDER BY value, us) - 1 AS pl, count(*) OVER () AS n, us FROM p WHERE value IS NOT NULL)"""


@query("AGG-8", sql(_SUMMARY, f"""SELECT 'count' AS section, 'total' AS name, count(*)::DOUBLE AS value FROM p
 UNION ALL SELECT 'count', 'queries', count(*)::DOUBLE FROM p WHERE k IS NOT NULL HAVING count(*) > 0
 UNION ALL SELECT 'count', 'errors', count(*)::DOUBLE FROM p WHERE event_type = first HAVING count(*) > 0
 UNION ALL SELECT 'action', event_type, count(*)::DOUBLE FROM p GROUP BY event_type
 UNION ALL SELECT 'gate_action', a, count(*)::DOUBLE FROM (SELECT unnest(list_concat(CASE WHEN event_type = first THEN ['watch', 'step' || (user_id % 3)] ELSE []::VARCHAR[] END, CASE WHEN k IS NOT NULL THEN ['gate' || (k % 2)] ELSE []::VARCHAR[] END)) AS a FROM p) GROUP BY a
 UNION ALL SELECT 'route', r, count(*)::DOUBLE FROM (SELECT unnest(list_concat(['user' || (user_id % 4)], CASE WHEN k IS NOT NULL THEN ['key' || (k % 5)] ELSE []::VARCHAR[] END)) AS r FROM p) GROUP BY r
 UNION ALL SELECT 'latency', 'mean', {R('avg(value)')} FROM l
 UNION ALL SELECT 'latency', 'p50', {R('max(value) FILTER (pl = round_even((n - 1) * 0.5::DOUBLE, 0))')} FROM l
 UNION ALL SELECT 'latency', 'p95', {R('max(value) FILTER (pl = round_even((n - 1) * 0.95::DOUBLE, 0))')} FROM l
 UNION ALL SELECT 'time', 'earliest', min(us)::DOUBLE FROM l UNION ALL SELECT 'time', 'latest', max(us)::DOUBLE FROM l"""))
def event_summary(spark: SparkSession, d: str) -> DataFrame:
    """Gate actions come from two places (an event of the first type, and the key in props), and so do routes."""
    e = _events(spark, d).withColumn("k", F.from_json("props", "k long")["k"])
    e = e.crossJoin(F.broadcast(e.agg(F.min("event_type").alias("first"))))
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    k, none = F.col("k"), F.array().cast("array<string>")
    names = {
        "action": F.array("event_type"),
        "gate_action": F.concat(F.when(F.col("event_type") == F.col("first"), F.array(F.lit("watch"), text("step", F.col("user_id") % 3))).otherwise(none), F.when(k.isNotNull(), F.array(text("gate", k % 2))).otherwise(none)),
        "route": F.concat(F.array(text("user", F.col("user_id") % 4)), F.when(k.isNotNull(), F.array(text("key", k % 5))).otherwise(none)),
    }
    counts = {"queries": k.isNotNull(), "errors": F.col("event_type") == F.col("first")}
    return E.summary(e, counts, names, F.col("value"), F.unix_micros(F.col("ts").cast("timestamp"))).select("section", "name", r6("value").alias("value"))


@query("AGG-9", f"SELECT user_id, {R('p50')} AS p50, {R('p95')} AS p95 FROM (SELECT user_id, list(value ORDER BY value)[(round_even((count(*) - 1) * 0.5::DOUBLE, 0) + 1)::BIGINT] AS p50, list(value ORDER BY value)[(round_even((count(*) - 1) * 0.95::DOUBLE, 0) + 1)::BIGINT] AS p95 FROM events GROUP BY user_id)")
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """By place in the sorted values, not by arrays of them."""
    e = _events(spark, d)
    sizes = e.groupBy("user_id").agg(F.count("value").alias("n"))
    rows = e.where("value is not null").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("value"))).join(sizes, "user_id")
    at = lambda p: F.max(F.when(F.col("place") == E.nearest_place(F.col("n"), p), F.col("value")))
    return rows.groupBy("user_id").agg(r6(at(0.5)).alias("p50"), r6(at(0.95)).alias("p95"))


@query("MAP-1", "SELECT event_type, (user_id % 4)::BIGINT AS task, count(*) AS n FROM events GROUP BY ALL")
def histograms(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("task", F.pmod("user_id", F.lit(4)).cast("long"))
    return E.histogram(rows, "event_type", "task").select("event_type", "task", "n")


@query("STREAM-4", "SELECT event_type AS status, count(*) AS n, max_by(event_id, (ts, event_id)) AS last_event FROM events GROUP BY event_type")
def telemetry(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("STREAM-9", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0::DOUBLE AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.rollups import tumbling

    rows = tumbling(_events(spark, d), "1 day")
    return rows.select(F.unix_micros(F.col("start")).alias("start"), "event_type", "n", r6("total", 4).alias("total"))


@query("STREAM-9-SLIDING", "WITH s AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) SELECT epoch_us(start) AS start, count(*) AS n FROM s GROUP BY 1")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.unix_micros("w.start").alias("start"), "n")


@query("STREAM-9-SESSION", """WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM o) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.unix_micros("w.start").alias("start"), "n")


# ---------------------------------------------------------------- windows over series

_FRAME = "OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
_THRESHOLD = f"CASE WHEN count(v) {_FRAME} >= 20 THEN least(greatest(quantile_cont(v, 0.75) {_FRAME}, 1e-4::DOUBLE), 1e-2::DOUBLE) END"


@query("WIN-1", sql(B.SERIES, f"SELECT key, seq, {R(_THRESHOLD, 9)} AS threshold FROM series"))
def adaptive_thresholds(spark: SparkSession, d: str) -> DataFrame:
    rows = B.series(spark, d)
    return rows.select("key", "seq", r6(W.adaptive_threshold(F.col("v"), W.last_rows(100)), 9).alias("threshold"))


@query("STREAM-3", sql(f"{B.SERIES}, t AS (SELECT key, seq, {_THRESHOLD} AS threshold FROM series)", f"SELECT key, {R('list_reduce(list_concat([0.0004::DOUBLE], coalesce(list(threshold ORDER BY seq) FILTER (threshold IS NOT NULL), [])), lambda s, x: CASE WHEN abs(x - s) > 1e-6 THEN x ELSE s END)', 9)} AS threshold FROM t GROUP BY key"))
def settled_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The threshold of each key after all its events; it moves only by more than the dead band."""
    rows = B.series(spark, d).withColumn("t", W.adaptive_threshold(F.col("v"), W.last_rows(100)))
    return W.dead_band(rows, "t", 0.0004).select("key", r6("threshold", 9).alias("threshold"))


@query("WIN-2", sql(B.SERIES, f"SELECT key, seq, count(v) {_FRAME} AS n, {R(f'min(v) {_FRAME}', 9)} AS low, {R(f'max(v) {_FRAME}', 9)} AS high, {R(f'avg(v) {_FRAME}', 8)} AS mean, {R(f'median(v) {_FRAME}', 9)} AS median FROM series"))
def threshold_statistics(spark: SparkSession, d: str) -> DataFrame:
    w, v = W.last_rows(100), F.col("v")
    return B.series(spark, d).select("key", "seq", F.count(v).over(w).alias("n"), r6(F.min(v).over(w), 9).alias("low"), r6(F.max(v).over(w), 9).alias("high"), r6(F.avg(v).over(w), 8).alias("mean"), r6(F.percentile(v, F.lit(0.5)).over(w), 9).alias("median"))


def _masks(spark: SparkSession, d: str) -> DataFrame:
    return N.variance_mask(N.dimension_stats(B.scout(spark, d)))


@query("WIN-3", sql(B.TO_STATS, f"""SELECT a.query_id, {R('CASE WHEN u = 0 THEN 1 ELSE i / u END')} AS jaccard FROM (SELECT b.query_id,
  list_sum(list_transform(list_zip(a.mask, b.mask), lambda z: least(z[1], z[2]))) AS i, list_sum(list_transform(list_zip(a.mask, b.mask), lambda z: greatest(z[1], z[2]))) AS u
  FROM (SELECT *, row_number() OVER (ORDER BY query_id) AS n FROM masks) a JOIN (SELECT *, row_number() OVER (ORDER BY query_id) AS n FROM masks) b ON b.n = a.n + 1) a"""))
def mask_stability(spark: SparkSession, d: str) -> DataFrame:
    rows = consecutive(_masks(spark, d), "query_id", "mask")
    both = V.total(F.zip_with("before_mask", "mask", lambda x, y: F.least(x, y)))
    either = V.total(F.zip_with("before_mask", "mask", lambda x, y: F.greatest(x, y)))
    return rows.select("query_id", r6(F.when(either == 0, 1.0).otherwise(both / either)).alias("jaccard"))


@query("WIN-4", sql(f"{B.TO_STATS}, numbered AS (SELECT query_id, pos, var, dense_rank() OVER (ORDER BY query_id) AS n FROM stats)", f"SELECT b.query_id, {R('corr(a.var, b.var)')} AS correlation FROM numbered a JOIN numbered b ON b.n = a.n + 1 AND a.pos = b.pos GROUP BY b.query_id"))
def variance_convergence(spark: SparkSession, d: str) -> DataFrame:
    spread = V.assembled(N.dimension_stats(B.scout(spark, d)), "var", "vars", "query_id")
    pairs = consecutive(spread, "query_id", "vars").select("query_id", F.inline(F.arrays_zip("before_vars", "vars")))
    rows = pairs.toDF("query_id", "before", "var")
    flat = (F.stddev_pop("before") < 1e-12) | (F.stddev_pop("var") < 1e-12)
    close = F.when(F.max(F.abs(F.col("before") - F.col("var"))) < 1e-8, 1.0).otherwise(0.0)
    return rows.groupBy("query_id").agg(r6(F.when(flat, close).otherwise(F.corr("before", "var"))).alias("correlation"))


@query("WIN-5", sql(f"{B.QUERIES}, steps AS (SELECT query_id, list_distance(q, before) AS drift FROM (SELECT query_id, q, lag(q) OVER (ORDER BY query_id) AS before FROM queries) WHERE before IS NOT NULL)", f"SELECT query_id, {R('drift')} AS drift, {R('(SELECT avg(drift) FROM steps)')} AS mean_drift, {R('(SELECT sum(drift) FROM steps)')} AS total_drift FROM steps"))
def snapshot_drift(spark: SparkSession, d: str) -> DataFrame:
    """The queries' vectors as snapshots in order: distance of each to the one before, with the mean and the total of all."""
    steps = consecutive(B.queries(B.corpus(spark, d)), "query_id", "q").select("query_id", V.norm(V.subtract(F.col("q"), F.col("before_q"))).alias("drift"))
    whole = F.broadcast(steps.agg(F.avg("drift").alias("mean"), F.sum("drift").alias("sum")))
    return steps.crossJoin(whole).select("query_id", r6("drift").alias("drift"), r6("mean").alias("mean_drift"), r6("sum").alias("total_drift"))


@query("WIN-6", sql(B.SERIES, f"SELECT key, {R('CASE WHEN count(v) >= 2 THEN arg_max(v, seq) - arg_min(v, seq) END', 9)} AS delta, {R('arg_max(v, seq)', 9)} AS latest, {R('avg(v)', 8)} AS mean FROM series GROUP BY key"))
def norm_drift(spark: SparkSession, d: str) -> DataFrame:
    first, last = F.min_by("v", "seq"), F.max_by("v", "seq")
    return B.series(spark, d).groupBy("key").agg(r6(F.when(F.count("v") >= 2, last - first), 9).alias("delta"), r6(last, 9).alias("latest"), r6(F.avg("v"), 8).alias("mean"))


@query("WIN-7", sql(B.SERIES, f"SELECT key, {R('stddev_pop(v)', 8)} AS oscillation, {R('arg_max(v, seq) - arg_min(v, seq)', 9)} AS delta, count(*) AS n FROM series GROUP BY key"))
def stability_report(spark: SparkSession, d: str) -> DataFrame:
    return B.series(spark, d).groupBy("key").agg(r6(F.stddev_pop("v"), 8).alias("oscillation"), r6(F.max_by("v", "seq") - F.min_by("v", "seq"), 9).alias("delta"), F.count("*").alias("n"))


@query("WIN-8", sql(B.SERIES, "SELECT key, ((seq - 1) // 5)::BIGINT AS win, count(*) AS n FROM series GROUP BY 1, 2"))
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return B.series(spark, d).groupBy("key", F.floor((F.col("seq") - 1) / 5).alias("win")).agg(F.count("*").alias("n"))


@query("WIN-9", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10")
def newest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return ranked(_events(spark, d), 10, ["user_id"], F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id")


_GAP = f"{B.SERIES}, g AS (SELECT key, seq, avg(v * 100 - 0.2) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gap FROM series)"


@query("WIN-10", sql(_GAP, f"SELECT key, {R('list_reduce(list_concat([0.3::DOUBLE], list(gap ORDER BY seq)), lambda s, g: least(greatest(0.9::DOUBLE * s + 0.1::DOUBLE * CASE WHEN g > 0 THEN 0.3::DOUBLE / (1 + g) ELSE 1.0::DOUBLE END, 0.05::DOUBLE), 1.0::DOUBLE))')} AS margin FROM g GROUP BY key"))
def rolling_margin(spark: SparkSession, d: str) -> DataFrame:
    rows = B.series(spark, d).withColumn("gap", F.avg(F.col("v") * 100 - 0.2).over(W.last_rows(50)))
    return W.margins(rows, "gap").select("key", r6("margin").alias("margin"))


_TEN = "OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("WIN-11", sql(B.SERIES, f"SELECT key, seq, {R(f'CASE WHEN count(v) {_TEN} < 2 THEN 0.001 ELSE least(greatest(0.001 * (0.01 / (0.01 + var_pop(v * 100) {_TEN} + 1e-10)), 1e-6), 0.1) END::DOUBLE', 8)} AS rate FROM series"))
def kalman_rates(spark: SparkSession, d: str) -> DataFrame:
    return B.series(spark, d).select("key", "seq", r6(W.kalman_rate(F.col("v") * 100, W.last_rows(10)), 8).alias("rate"))


@query("WIN-12", sql(B.EXPERIMENTS, f"SELECT win, {R('0.1 * (0.01 / (0.01 + var_pop(ndcg) + 1e-10))', 8)} AS sigma FROM experiments GROUP BY win"))
def generation_sigma(spark: SparkSession, d: str) -> DataFrame:
    return B.experiments(spark, d).groupBy("win").agg(r6(0.1 * (0.01 / (0.01 + F.var_pop("ndcg") + 1e-10)), 8).alias("sigma"))


@query("WIN-13", f"""SELECT s AS step, 1.0::DOUBLE AS constant, {R('greatest(1 - 0.9::DOUBLE * least(s / 100.0::DOUBLE, 1), 0.01)')} AS linear_decay,
 {R('greatest(0.1 + 0.45::DOUBLE * (1 + cos(pi() * least(s / 100.0::DOUBLE, 1))), 0.01)')} AS cosine_annealing, {R('greatest(pow(0.5::DOUBLE, s // 20), 0.01)')} AS step_decay,
 {R('CASE WHEN s <= 10 THEN s / 10.0::DOUBLE ELSE greatest(1 - 0.9::DOUBLE * least((s - 10) / 90.0::DOUBLE, 1), 0.01) END')} AS warmed FROM (SELECT unnest(range(1, 121)) AS s)""")
def weight_schedules(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("id")
    kinds = ("linear_decay", "cosine_annealing", "step_decay")
    return spark.range(1, 121).select(s.alias("step"), W.schedule(s, "constant").alias("constant"), *(r6(W.schedule(s, k)).alias(k) for k in kinds), r6(W.schedule(s, "linear_decay", warmup=10)).alias("warmed"))


@query("WIN-14")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: a fold with several states; the test compares with a plain loop."""
    return W.early_stops(B.series(spark, d), "v")


@query("WIN-13-ADAPTIVE")
def adaptive_weight(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: a fold; the teacher's weight after each key's values as losses, compared with a plain loop in the test."""
    return W.adaptive_weights(B.series(spark, d), "v").select("key", r6("weight", 9).alias("weight"))


@query("WIN-15", f"WITH daily AS (SELECT event_type, ts::DATE::VARCHAR AS day, avg(value) AS mean FROM events GROUP BY 1, 2) SELECT event_type, day, {R('mean - lag(mean) OVER (PARTITION BY event_type ORDER BY day)')} AS change, {R('avg(mean) OVER (PARTITION BY event_type)')} AS history_mean, count(*) OVER (PARTITION BY event_type) AS snapshots, day = max(day) OVER (PARTITION BY event_type) AS latest FROM daily")
def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    """Each day's snapshot: change to the one before, mean of the history, and whether it is the latest."""
    daily = _events(spark, d).groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.avg("value").alias("mean"))
    by = Window.partitionBy("event_type")
    return daily.select("event_type", "day", r6(F.col("mean") - F.lag("mean").over(by.orderBy("day"))).alias("change"), r6(F.avg("mean").over(by)).alias("history_mean"), F.count("*").over(by).alias("snapshots"), (F.col("day") == F.max("day").over(by)).alias("latest"))


@query("WIN-16", sql(B.SERIES, "SELECT s.key, c.cycle, count(*) AS n FROM series s JOIN (SELECT key, count(*) AS total FROM series GROUP BY key) t ON s.key = t.key JOIN (SELECT unnest(range(0, 5)) AS cycle) c ON s.seq - 1 >= (c.cycle * 10) % total AND s.seq - 1 < (c.cycle * 10) % total + 10 GROUP BY s.key, c.cycle"))
def cycle_windows(spark: SparkSession, d: str) -> DataFrame:
    """Ten rows from (cycle * 10) modulo the key's length, for five cycles; no wrap at the end."""
    rows = B.series(spark, d).withColumn("total", F.count("*").over(Window.partitionBy("key")))
    rows = rows.select("key", F.col("seq") - 1, "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("cycle")).toDF("key", "at", "total", "cycle")
    start = (F.col("cycle") * 10) % F.col("total")
    return rows.where((F.col("at") >= start) & (F.col("at") < start + 10)).groupBy("key", "cycle").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- aggregates over experiments

@query("AGG-6", sql(B.EXPERIMENTS, f"SELECT coalesce(profile, 'all') AS profile, coalesce(task, -1)::BIGINT AS task, {R('avg(ndcg)')} AS ndcg, count(*) AS n FROM experiments GROUP BY GROUPING SETS ((experiments.profile, experiments.task), (experiments.profile), (experiments.task))"))
def config_dataset_means(spark: SparkSession, d: str) -> DataFrame:
    rows = B.experiments(spark, d)
    sets = rows.groupingSets([["profile", "task"], ["profile"], ["task"]], "profile", "task").agg(r6(F.avg("ndcg")).alias("ndcg"), F.count("*").alias("n"))
    return sets.select(F.coalesce("profile", F.lit("all")).alias("profile"), F.coalesce("task", F.lit(-1)).cast("long").alias("task"), "ndcg", "n")


@query("AGG-7", sql(B.EXPERIMENTS, f"SELECT profile, {', '.join(R(f'coalesce(avg(ndcg) FILTER (task = {t}), 0)') + f' AS task{t}' for t in range(4))} FROM experiments GROUP BY profile"))
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    rows = B.experiments(spark, d).groupBy("profile").pivot("task", [0, 1, 2, 3]).agg(F.avg("ndcg"))
    return rows.select("profile", *(r6(F.coalesce(F.col(str(t)), F.lit(0.0))).alias(f"task{t}") for t in range(4)))


_OUT = "count(*) AS windows, count(*) FILTER (delta > 0.001) AS improved, count(*) FILTER (delta < -0.001) AS regressed, count(*) FILTER (abs(delta) <= 0.001) AS tied"


def _outcomes() -> list:
    x = F.col("delta")
    return [F.count("*").alias("windows"), F.count_if(x > 0.001).alias("improved"), F.count_if(x < -0.001).alias("regressed"), F.count_if(F.abs(x) <= 0.001).alias("tied")]


@query("AGG-10", sql(B.EXPERIMENTS, f"SELECT profile, {_OUT}, {R('avg(delta)')} AS mean, {R('max(delta)')} AS best, {R('min(delta)')} AS worst, sum(n)::BIGINT AS actions, array_to_string(list_sort(list(DISTINCT task)), ',') AS tasks FROM experiments GROUP BY profile"))
def profile_outcomes(spark: SparkSession, d: str) -> DataFrame:
    tasks = F.array_join(F.transform(F.array_sort(F.collect_set("task")), lambda t: t.cast("string")), ",")
    return B.experiments(spark, d).groupBy("profile").agg(*_outcomes(), r6(F.avg("delta")).alias("mean"), r6(F.max("delta")).alias("best"), r6(F.min("delta")).alias("worst"), F.sum("n").alias("actions"), tasks.alias("tasks"))


@query("AGG-11", sql(B.EXPERIMENTS, f"SELECT profile, task, {_OUT}, bool_and(delta >= -0.001) AND avg(delta) > 0.001 AS shippable FROM experiments GROUP BY profile, task"))
def gate_subsets(spark: SparkSession, d: str) -> DataFrame:
    ship = F.bool_and(F.col("delta") >= -0.001) & (F.avg("delta") > 0.001)
    return B.experiments(spark, d).groupBy("profile", "task").agg(*_outcomes(), ship.alias("shippable"))


_CUTS = {"n": 3, "ndcg": 0.5, "base": 0.5}
_KEYS = ", ".join(["'all'", "'task:' || task", *(f"CASE WHEN {c} < {x} THEN '{c}<{x}' ELSE '{c}>={x}' END" for c, x in _CUTS.items()), "CASE WHEN n % 2 = 0 THEN 'unchanged' ELSE 'changed' END"])
_CUBE = f"""{B.EXPERIMENTS}, keyed AS (SELECT profile, delta, unnest([{_KEYS}]) AS gate FROM experiments WHERE profile <> baseline_name),
cells AS (SELECT profile, gate, count(*) AS windows, round(avg(delta), 9) AS mean, count(*) FILTER (delta < -0.001) AS regressed, bool_and(delta >= -0.001) AND avg(delta) > 0.001 AS shippable FROM keyed GROUP BY profile, gate),
placed AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY NOT shippable, mean DESC, gate) AS place FROM cells)"""


@query("AGG-12", sql(_CUBE, f"SELECT profile, gate, windows, {R('mean')} AS mean, regressed, shippable, place::INTEGER AS place, place = 1 AS best FROM placed"))
def gate_cube(spark: SparkSession, d: str) -> DataFrame:
    """Each row goes to its gates (all, task, either side of three features, changed or not); one aggregation serves them all."""
    rows = B.experiments(spark, d).where("profile <> baseline_name")
    sides = [F.when(F.col(c) < x, f"{c}<{x}").otherwise(f"{c}>={x}") for c, x in _CUTS.items()]
    gates_ = F.array(F.lit("all"), F.concat(F.lit("task:"), F.col("task").cast("string")), *sides, F.when(F.col("n") % 2 == 0, "unchanged").otherwise("changed"))
    x = F.col("delta")
    cells = rows.select("profile", "delta", F.explode(gates_).alias("gate")).groupBy("profile", "gate").agg(F.count("*").alias("windows"), F.round(F.avg(x), 9).alias("mean"), F.count_if(x < -0.001).alias("regressed"), (F.bool_and(x >= -0.001) & (F.avg(x) > 0.001)).alias("shippable"))
    out = ranked(cells, None, ["profile"], ~F.col("shippable"), F.col("mean").desc(), "gate")
    return out.select("profile", "gate", "windows", r6("mean").alias("mean"), "regressed", "shippable", F.col("rank").alias("place"), (F.col("rank") == 1).alias("best"))


@query("AGG-14", sql(B.EXPERIMENTS, f"SELECT task, profile, count(*) AS runs, {R('avg(ndcg)')} AS mean, {R('avg(delta)')} AS mean_delta FROM experiments GROUP BY task, profile"))
def family_summary(spark: SparkSession, d: str) -> DataFrame:
    return B.experiments(spark, d).groupBy("task", "profile").agg(F.count("*").alias("runs"), r6(F.avg("ndcg")).alias("mean"), r6(F.avg("delta")).alias("mean_delta"))


@query("AGG-15", f"SELECT event_type AS route, count(*) AS n, {R('avg(value) / 100')} AS mean_jaccard, {R('sum(CASE WHEN event_id % 3 <> 0 THEN value END) / count(*)')} AS mean_latency FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 256 GROUP BY event_type")
def route_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    """The last 256 outcomes of each user; a latency that is missing counts in the divisor."""
    last = ranked(_events(spark, d), 256, ["user_id"], F.col("ts").desc(), F.col("event_id").desc())
    latency = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    return last.groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("n"), r6(F.avg("value") / 100).alias("mean_jaccard"), r6(F.sum(latency) / F.count("*")).alias("mean_latency"))


@query("AGG-16", f"WITH q AS (SELECT user_id, count(*) AS n, 1 / (1 + (1 - pow(0.9::DOUBLE, count(*))) / (1 - 0.9::DOUBLE)) AS quality FROM events GROUP BY user_id) SELECT user_id, n, {R('quality')} AS quality, CASE WHEN quality >= 0.8 THEN 'high' WHEN quality <= 0.3 THEN 'low' ELSE 'medium' END AS class FROM q")
def log_quality(spark: SparkSession, d: str) -> DataFrame:
    q = 1.0 / (1.0 + (1.0 - F.pow(F.lit(0.9), F.col("n"))) / (1 - 0.9))
    kind = F.when(F.col("q") >= 0.8, "high").when(F.col("q") <= 0.3, "low").otherwise("medium")
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("q", q).select("user_id", "n", r6("q").alias("quality"), kind.alias("class"))


@query("MATH-8", f"WITH q AS (SELECT user_id, 1 / (1 + (1 - pow(0.9::DOUBLE, count(*))) / (1 - 0.9::DOUBLE)) AS quality FROM events GROUP BY user_id) SELECT user_id, {R('0.01 * (1 + 2 * (1 - quality))')} AS threshold FROM q")
def document_thresholds(spark: SparkSession, d: str) -> DataFrame:
    q = 1.0 / (1.0 + (1.0 - F.pow(F.lit(0.9), F.col("n"))) / (1 - 0.9))
    return _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", r6(0.01 * (1 + 2 * (1 - q))).alias("threshold"))


_CYCLES = "cycles AS (SELECT DISTINCT ts::DATE AS cycle, user_id FROM events), totals AS (SELECT count(DISTINCT cycle) AS n FROM cycles)"


@query("AGG-17", f"WITH {_CYCLES}, per AS (SELECT user_id, count(*) AS c FROM cycles GROUP BY user_id) SELECT {R('avg(CASE WHEN c > n / 2.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS ratio, count(*) AS users FROM per CROSS JOIN totals")
def persistent_ratio(spark: SparkSession, d: str) -> DataFrame:
    pairs = _events(spark, d).select(F.to_date("ts").alias("cycle"), "user_id").distinct()
    total = F.broadcast(pairs.agg(F.countDistinct("cycle").alias("n")))
    per = pairs.groupBy("user_id").agg(F.count("*").alias("c")).crossJoin(total)
    return per.agg(r6(F.avg(F.when(F.col("c") > F.col("n") / 2, 1.0).otherwise(0.0))).alias("ratio"), F.count("*").alias("users"))


@query("AGG-18", sql(B.SERIES, f"SELECT key, {R('CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(v) END', 8)} AS oscillation FROM series GROUP BY key"))
def threshold_oscillation(spark: SparkSession, d: str) -> DataFrame:
    return B.series(spark, d).groupBy("key").agg(r6(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("v")), 8).alias("oscillation"))


@query("AGG-19", sql(B.TO_SCOUT, f"SELECT query_id, {R('avg(sqrt(list_inner_product(v, v)))')} AS mean, {R('stddev_pop(sqrt(list_inner_product(v, v)))')} AS std, count(*) AS n, {R('any_value(sqrt(list_inner_product(q, q)))')} AS query_norm FROM scout GROUP BY query_id"))
def norm_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = B.scout(spark, d).select("query_id", V.norm(F.col("v")).alias("n"), V.norm(F.col("q")).alias("qn"))
    return rows.groupBy("query_id").agg(r6(F.avg("n")).alias("mean"), r6(F.stddev_pop("n")).alias("std"), F.count("*").alias("n"), r6(F.any_value("qn")).alias("query_norm"))


@query("AGG-23", sql(f"{B.EXPERIMENTS}, results AS (SELECT *, CASE WHEN greatest(ndcg, base) = 0 THEN 1.0::DOUBLE ELSE least(ndcg, base) / greatest(ndcg, base) END AS stability, CASE WHEN base = 0 THEN 0.0::DOUBLE ELSE delta / base * 100 END AS percent FROM experiments)", f"""SELECT count(*) AS tasks, count(*) FILTER (n >= 2) AS successful, count(*) FILTER (n < 2) AS failed,
 {', '.join(f'{R(f"{f}({c}) FILTER (n >= 2)")} AS {c}_{k}' for c in ('ndcg', 'stability') for k, f in (('mean', 'avg'), ('std', 'stddev_pop'), ('low', 'min'), ('high', 'max')))},
 {R('avg(delta) FILTER (n >= 2)')} AS gain_mean, {R('stddev_pop(delta) FILTER (n >= 2)')} AS gain_std, {R('avg(percent) FILTER (n >= 2)', 4)} AS gain_percent, count(*) FILTER (n >= 2 AND delta > 0) AS gains, count(*) FILTER (n >= 2 AND delta < 0) AS losses FROM results"""))
def multitask_summary(spark: SparkSession, d: str) -> DataFrame:
    """Runs of fewer than two measurements count as failed and enter no mean; stability is the ratio of the two scores."""
    high = F.greatest("ndcg", "base")
    rows = B.experiments(spark, d).withColumns({"stability": F.when(high == 0, 1.0).otherwise(F.least("ndcg", "base") / high), "percent": F.when(F.col("base") == 0, 0.0).otherwise(F.col("delta") / F.col("base") * 100), "ok": F.col("n") >= 2})
    on = lambda c: F.when(F.col("ok"), F.col(c))
    stats = [r6(f(on(c))).alias(f"{c}_{k}") for c in ("ndcg", "stability") for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("low", F.min), ("high", F.max))]
    return rows.agg(F.count("*").alias("tasks"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"), *stats, r6(F.avg(on("delta"))).alias("gain_mean"), r6(F.stddev_pop(on("delta"))).alias("gain_std"), r6(F.avg(on("percent")), 4).alias("gain_percent"), F.count_if(on("delta") > 0).alias("gains"), F.count_if(on("delta") < 0).alias("losses"))


@query("AGG-24", sql(B.EXPERIMENTS, f"SELECT profile, {R('avg(ndcg)')} AS mean, {R('max(ndcg) - min(ndcg)')} AS spread, max(ndcg) - min(ndcg) <= 0.9 AS passed FROM experiments GROUP BY profile"))
def seed_gate(spark: SparkSession, d: str) -> DataFrame:
    spread = F.max("ndcg") - F.min("ndcg")
    return B.experiments(spark, d).groupBy("profile").agg(r6(F.avg("ndcg")).alias("mean"), r6(spread).alias("spread"), (spread <= 0.9).alias("passed"))


@query("AGG-25", sql(f"{B.EXPERIMENTS}, tasks AS (SELECT profile, task, avg(delta) AS gain FROM experiments GROUP BY profile, task)", f"SELECT profile, bool_and(gain >= 0) AND avg(gain) >= 0.001 AS passed, {R('avg(gain)')} AS mean_gain, coalesce(array_to_string(list_sort(list(task) FILTER (gain < 0)), ','), '') AS failures FROM tasks GROUP BY profile"))
def transfer_gate(spark: SparkSession, d: str) -> DataFrame:
    tasks = B.experiments(spark, d).groupBy("profile", "task").agg(F.avg("delta").alias("gain"))
    failures = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("gain") < 0, F.col("task")))), lambda t: t.cast("string")), ",")
    return tasks.groupBy("profile").agg((F.bool_and(F.col("gain") >= 0) & (F.avg("gain") >= 0.001)).alias("passed"), r6(F.avg("gain")).alias("mean_gain"), failures.alias("failures"))


_SEEDS = f"""{B.EXPERIMENTS}, best AS (SELECT task, win, max(ndcg) AS hybrid FROM experiments WHERE profile <> baseline_name GROUP BY task, win),
seeds AS (SELECT b.task, b.win, ndcg AS baseline, hybrid, hybrid - ndcg AS gain, CASE WHEN ndcg = 0 THEN 0.0::DOUBLE ELSE (hybrid - ndcg) / ndcg * 100 END AS percent, hybrid - 0.5 AS to_reference, abs(ndcg - 0.5) <= 0.3 AS in_band, abs(ndcg - 0.5) <= 0.3 AND hybrid > ndcg AS passes
 FROM experiments e JOIN best b ON e.task = b.task AND e.win = b.win WHERE profile = baseline_name),
every AS (SELECT task, '*' AS win, avg(baseline) AS baseline, avg(hybrid) AS hybrid, avg(gain) AS gain, max(hybrid) - min(hybrid) AS spread, bool_and(in_band) AS in_band, bool_and(passes) AND max(hybrid) - min(hybrid) <= 0.9 AS passes FROM seeds GROUP BY task)"""
_NEXT = "CASE WHEN passes THEN 'run-multitask-gate' ELSE 'stop-and-review' END AS next_step"


@query("AGG-26", sql(_SEEDS, f"SELECT task, win, {R('baseline')} AS baseline, {R('hybrid')} AS hybrid, {R('gain')} AS gain, {R('percent', 3)} AS percent, {R('to_reference')} AS to_reference, in_band, passes, {_NEXT} FROM seeds UNION ALL SELECT task, win, {R('baseline')}, {R('hybrid')}, {R('gain')}, NULL, {R('spread')}, in_band, passes, {_NEXT} FROM every"))
def repeatability(spark: SparkSession, d: str) -> DataFrame:
    """Each day is a seed: its baseline against the reference band, the best other profile against it; and all seeds of a task.

    In the rows of all seeds (``win`` is ``*``) to_reference is the spread of the seeds, which must stay within 0.9.
    """
    rows = B.experiments(spark, d)
    best = rows.where("profile <> baseline_name").groupBy("task", "win").agg(F.max("ndcg").alias("hybrid"))
    seeds = rows.where("profile = baseline_name").select("task", "win", F.col("ndcg").alias("baseline")).join(best, ["task", "win"])
    b, gain = F.col("baseline"), F.col("hybrid") - F.col("baseline")
    seeds = seeds.withColumns({"gain": gain, "percent": F.when(b == 0, 0.0).otherwise(gain / b * 100), "to_reference": F.col("hybrid") - 0.5, "in_band": F.abs(b - 0.5) <= 0.3}).withColumn("passes", F.col("in_band") & (gain > 0))
    spread = F.max("hybrid") - F.min("hybrid")
    every = seeds.groupBy("task").agg(F.lit("*").alias("win"), F.avg("baseline").alias("baseline"), F.avg("hybrid").alias("hybrid"), F.avg("gain").alias("gain"), F.lit(None).cast("double").alias("percent"), spread.alias("to_reference"), F.bool_and("in_band").alias("in_band"), (F.bool_and("passes") & (spread <= 0.9)).alias("passes"))
    out = seeds.unionByName(every)
    step = F.when(F.col("passes"), "run-multitask-gate").otherwise("stop-and-review")
    return out.select("task", "win", *(r6(c).alias(c) for c in ("baseline", "hybrid", "gain")), r6("percent", 3).alias("percent"), r6("to_reference").alias("to_reference"), "in_band", "passes", step.alias("next_step"))


@query("AGG-28", sql(B.EXPERIMENTS, "SELECT task, n > 2 AS decomposed, count(*) FILTER (delta > 1e-9) AS improved, count(*) FILTER (delta < -1e-9) AS degraded, count(*) FILTER (abs(delta) <= 1e-9) AS unchanged FROM experiments GROUP BY ALL"))
def recursive_comparison(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("delta")
    return B.experiments(spark, d).groupBy("task", (F.col("n") > 2).alias("decomposed")).agg(F.count_if(x > 1e-9).alias("improved"), F.count_if(x < -1e-9).alias("degraded"), F.count_if(F.abs(x) <= 1e-9).alias("unchanged"))


@query("AGG-29", sql(f"{B.SERIES}, drives AS (SELECT key, ((seq - 1) % 4)::BIGINT AS drive, count(*) AS depth FROM series GROUP BY 1, 2), tops AS (SELECT key, arg_min(event_id, (-v, seq)) AS best, max(v) AS fitness FROM series GROUP BY key), slow AS (SELECT key, max(depth) AS slowest FROM drives GROUP BY key)", f"SELECT d.key, drive, depth, slowest, best, {R('fitness')} AS fitness, {R('(1 + least(slowest, 16) * 100 + greatest(slowest - 16, 0) * 200) / 1000.0::DOUBLE')} AS latency_ms FROM drives d JOIN tops t ON d.key = t.key JOIN slow s ON d.key = s.key"))
def sharded_population(spark: SparkSession, d: str) -> DataFrame:
    """Round robin by dispatch order to four drives; the first of the best; latency by the slowest queue."""
    rows = B.series(spark, d)
    drives = rows.groupBy("key", F.pmod(F.col("seq") - 1, F.lit(4)).cast("long").alias("drive")).agg(F.count("*").alias("depth"), F.min(F.struct((-F.col("v")).alias("low"), "seq", "event_id")).alias("top"))
    whole = drives.groupBy("key").agg(F.max("depth").alias("slowest"), F.min("top").alias("top"))
    latency = storage.latency_us(F.lit(100.0), F.lit(1.0), F.lit(16), F.col("slowest")) / 1000
    return drives.drop("top").join(whole, "key").select("key", "drive", "depth", "slowest", F.col("top.event_id").alias("best"), r6(-F.col("top.low")).alias("fitness"), r6(latency).alias("latency_ms"))


@query("AGG-30", "WITH s(severity) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) SELECT severity, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS closed FROM s LEFT JOIN orders ON o_orderpriority = severity GROUP BY severity")
def closure_counts(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")], "severity string")
    counts = B.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))
    return names.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("closed", F.lit(0)).alias("closed"))


@query("AGG-31", sql(f"{B.CORPUS}, {B.DIMS}, norms AS (SELECT sqrt(list_inner_product(v, v)) AS n FROM corpus), health AS (SELECT avg(n) AS mean_norm, max(n) AS max_norm, min(n) AS min_norm, CASE WHEN count(*) > 1 THEN stddev_pop(n) ELSE 0 END AS std_norm FROM norms)", f"SELECT (pos - 1)::INTEGER AS pos, {R('avg(x)', 8)} AS mean, {R('sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0))')} AS std, count(*) AS n, {', '.join(R(f'any_value({c})') + f' AS {c}' for c in ('mean_norm', 'max_norm', 'min_norm', 'std_norm'))}, any_value(mean_norm) < 1e-7 AS vanishing, any_value(mean_norm) > 100 AS exploding FROM dims CROSS JOIN health GROUP BY pos"))
def gradient_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of each dimension from running sums, and the health of the norms: vanishing or exploding."""
    x = F.col("x")
    rows = B.corpus(spark, d)
    std = F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0)))
    n = V.norm(F.col("v"))
    health = rows.select(n.alias("n")).agg(F.avg("n").alias("mean_norm"), F.max("n").alias("max_norm"), F.min("n").alias("min_norm"), F.when(F.count("*") > 1, F.stddev_pop("n")).otherwise(0.0).alias("std_norm"))
    dims = V.exploded(rows, "v").groupBy("pos").agg(r6(F.avg(x), 8).alias("mean"), r6(std).alias("std"), F.count("*").alias("n"))
    flags = [(F.col("mean_norm") < 1e-7).alias("vanishing"), (F.col("mean_norm") > 100).alias("exploding")]
    return dims.crossJoin(F.broadcast(health)).select("pos", "mean", "std", "n", *(r6(c).alias(c) for c in ("mean_norm", "max_norm", "min_norm", "std_norm")), *flags)


@query("AGG-32", sql(f"{B.SERIES}, t AS (SELECT *, count(*) OVER (PARTITION BY key) AS total FROM series)", f"SELECT key, {R('regr_slope(v, seq)', 8)} AS slope, {R('avg(v) FILTER (seq > total - 10)', 8)} AS recent FROM t GROUP BY key"))
def loss_trend(spark: SparkSession, d: str) -> DataFrame:
    rows = B.series(spark, d).withColumn("total", F.count("*").over(Window.partitionBy("key")))
    return rows.groupBy("key").agg(r6(F.regr_slope("v", "seq"), 8).alias("slope"), r6(F.avg(F.when(F.col("seq") > F.col("total") - 10, F.col("v"))), 8).alias("recent"))


@query("AGG-33", sql(B.EXPERIMENTS, f"SELECT task, win, profile, row_number() OVER (PARTITION BY task, win ORDER BY round(ndcg, 9) DESC, profile)::INTEGER AS place, {R('delta')} AS delta, count(*) FILTER (delta < -0.001 AND profile <> baseline_name) OVER (PARTITION BY task, win) AS regressions FROM experiments"))
def round_summary(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("task", "win")
    worse = F.sum(F.when((F.col("delta") < -0.001) & (F.col("profile") != F.col("baseline_name")), 1).otherwise(0)).over(by)
    place = F.row_number().over(by.orderBy(F.round("ndcg", 9).desc(), "profile"))
    return B.experiments(spark, d).select("task", "win", "profile", place.alias("place"), r6("delta").alias("delta"), worse.alias("regressions"))


# ---------------------------------------------------------------- joins

@query("JOIN-6", sql(B.QUERIES, f"SELECT a.query_id AS a, b.query_id AS b, {R('list_cosine_similarity(a.q, b.q)')} AS similarity FROM queries a JOIN queries b ON a.query_id < b.query_id WHERE list_cosine_similarity(a.q, b.q) >= 0.15"))
def unordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of queries of similar vectors, each pair once; blocks of queries pass by the rows and only links leave a task."""
    return similar_pairs(B.queries(B.corpus(spark, d)), 0.15, "query_id", "q").select("a", "b", r6("similarity").alias("similarity"))


@query("JOIN-8", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def judged_documents(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("JOIN-11", "WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier) SELECT coalesce(a.k, b.k) AS k, coalesce(a.v::VARCHAR, '-') AS expected, coalesce(b.v::VARCHAR, '-') AS observed FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def record_diff(spark: SparkSession, d: str) -> DataFrame:
    a = B.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("expected"))
    b = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("observed"))
    rows = a.join(b, "k", "full_outer").where(~F.col("expected").eqNullSafe(F.col("observed")))
    return rows.select("k", *(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in ("expected", "observed")))


@query("JOIN-12", "SELECT o.o_orderkey, bool_or(l.l_linestatus <> 'F') AS blocked, count(*) AS dependencies FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey")
def blocked_items(spark: SparkSession, d: str) -> DataFrame:
    deps = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_linestatus") != "F").alias("blocked"), F.count("*").alias("dependencies"))
    return B.table(spark, d, "orders").select("o_orderkey").join(deps, "o_orderkey")


@query("SET-9", sql(B.EXPERIMENTS, "SELECT task, profile FROM (SELECT task, profile, avg(delta) AS m FROM experiments GROUP BY task, profile) WHERE m > 0.001 UNION SELECT task, baseline_name FROM experiments"))
def chosen_profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = B.experiments(spark, d)
    better = rows.groupBy("task", "profile").agg(F.avg("delta").alias("m")).where("m > 0.001").select("task", "profile")
    return better.unionByName(rows.select("task", F.col("baseline_name").alias("profile"))).distinct()


@query("SET-10", "SELECT * FROM ((SELECT c_nationkey AS k, 'left' AS side FROM customer EXCEPT ALL SELECT s_nationkey, 'left' FROM supplier) UNION ALL (SELECT s_nationkey, 'right' FROM supplier EXCEPT ALL SELECT c_nationkey, 'right' FROM customer))")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    a = B.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = B.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


# ---------------------------------------------------------------- graphs

_PAIRS = f"{B.CORPUS}, pairs AS (SELECT a.label AS la, b.label AS lb, least(greatest(list_cosine_similarity(a.v, b.v), -1), 1) AS s FROM corpus a JOIN corpus b ON a.vec_id < b.vec_id), bonded AS (SELECT *, CASE WHEN s >= 0.3 THEN 'covalent' WHEN s >= 0.2 THEN 'hydrogen' WHEN s >= 0.1 THEN 'vdw' ELSE 'none' END AS bond FROM pairs)"
_THRESHOLDS = (0.1, 0.2, 0.3)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.pair_counts(B.corpus(spark, d), "v", "v", "label", _THRESHOLDS)


@query("GRAPH-1", f"SELECT query_id, vec_id, CASE WHEN score >= 0.9 THEN 'covalent' WHEN score >= 0.7 THEN 'hydrogen' WHEN score >= 0.4 THEN 'vdw' ELSE 'none' END AS bond FROM (WITH {B.TO_SCOUT} SELECT * FROM scout)")
def bonds_of_hits(spark: SparkSession, d: str) -> DataFrame:
    return B.scout(spark, d).select("query_id", "vec_id", graph.bond(F.col("score")).alias("bond"))


@query("GRAPH-2", sql(_PAIRS, f"SELECT b.bond, (2 * count(s))::BIGINT AS pairs, {R('2 * count(s) / (SELECT greatest(count(*) * (count(*) - 1), 1)::DOUBLE FROM corpus)')} AS ratio FROM (VALUES ('none'), ('vdw'), ('hydrogen'), ('covalent')) b(bond) LEFT JOIN bonded ON bonded.bond = b.bond GROUP BY b.bond"))
def bond_counts(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs, zero counts included."""
    rows = B.corpus(spark, d)
    names = spark.createDataFrame([(b,) for b in graph.BONDS], "bond string")
    found = _pairs(spark, d).groupBy("bond").agg(F.sum("pairs").alias("p"))
    n = F.broadcast(rows.agg(F.greatest(F.count("*") * (F.count("*") - 1), F.lit(1)).alias("all")))
    out = names.join(found, "bond", "left").crossJoin(n)
    pairs = 2 * F.coalesce("p", F.lit(0))
    return out.select("bond", pairs.alias("pairs"), r6(pairs / F.col("all")).alias("ratio"))


@query("GRAPH-3", sql(_PAIRS, "SELECT la = lb AS same_cluster, bond, count(*) AS pairs FROM bonded GROUP BY 1, 2"))
def cluster_connectivity(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy(F.col("label").isNotNull().alias("same_cluster"), "bond").agg(F.sum("pairs").alias("pairs"))


@query("GRAPH-3-COHESION", sql(_PAIRS, f"SELECT l.label, {R('coalesce(avg(s), 1)')} AS cohesion FROM (SELECT DISTINCT label FROM corpus) l LEFT JOIN pairs ON la = l.label AND lb = l.label GROUP BY l.label"))
def cluster_cohesion(spark: SparkSession, d: str) -> DataFrame:
    means = _pairs(spark, d).where("label is not null").groupBy("label").agg((F.sum("total") / F.sum("pairs")).alias("m"))
    return B.corpus(spark, d).select("label").distinct().join(means, "label", "left").select("label", r6(F.coalesce("m", F.lit(1.0))).alias("cohesion"))


_CHANGE = f"""{B.CORPUS}, moved AS (SELECT vec_id, v, list_transform(v, lambda x, i: x * CASE WHEN i % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS w FROM corpus),
pairs AS (SELECT list_cosine_similarity(a.v, b.v) AS s, list_cosine_similarity(a.w, b.w) AS t FROM moved a JOIN moved b ON a.vec_id < b.vec_id),
coded AS (SELECT CASE WHEN s >= 0.3 THEN 3 WHEN s >= 0.2 THEN 2 WHEN s >= 0.1 THEN 1 ELSE 0 END AS x, CASE WHEN t >= 0.3 THEN 3 WHEN t >= 0.2 THEN 2 WHEN t >= 0.1 THEN 1 ELSE 0 END AS y FROM pairs)"""


@query("GRAPH-4", sql(_CHANGE, f"SELECT {R('(count(*) FILTER (y = 3) - count(*) FILTER (x = 3)) / count(*)::DOUBLE')} AS collapse_pressure, {R('sqrt(2 * sum((x - y) * (x - y))) / (3 * (SELECT count(*) FROM corpus))')} AS distance FROM coded"))
def topology_change(spark: SparkSession, d: str) -> DataFrame:
    rows = B.corpus(spark, d).withColumn("w", F.transform("v", lambda x, i: x * F.when((i + 1) % 3 == 0, 0.0).otherwise(1.0)))
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    code = lambda c: F.array_position(F.array(*(F.lit(b) for b in graph.BONDS)), F.col(c)) - 1
    step = code("bond") - code("bond_after")
    pairs = F.col("pairs")
    covalent = F.sum(F.when(F.col("bond_after") == "covalent", pairs).otherwise(0)) - F.sum(F.when(F.col("bond") == "covalent", pairs).otherwise(0))
    found = graph.pair_counts(rows, "v", "w", "label", _THRESHOLDS).agg((covalent / F.sum("pairs")).alias("pressure"), F.sum(step * step * pairs).alias("squares"))
    return found.crossJoin(n).select(r6("pressure").alias("collapse_pressure"), r6(F.sqrt(2 * F.col("squares")) / (3 * F.col("n"))).alias("distance"))


@query("GRAPH-5", sql(_PAIRS, f"SELECT {R('avg(s)')} AS mean, {R('stddev_pop(s)')} AS std, {R('min(s)')} AS low, {R('max(s)')} AS high FROM pairs"))
def topology_report(spark: SparkSession, d: str) -> DataFrame:
    s = _pairs(spark, d).agg(F.sum("pairs").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("q"), F.min("low").alias("low"), F.max("high").alias("high"))
    mean = F.col("t") / F.col("n")
    return s.select(r6(mean).alias("mean"), r6(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))).alias("std"), r6("low").alias("low"), r6("high").alias("high"))


@query("GRAPH-7")
def median_partition(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: a loop over levels; the test compares with a plain recursion."""
    return graph.variance_median_partition(B.corpus(spark, d), 8, "vec_id", "v").withColumnRenamed("id", "vec_id")


_SIGNALS = f"""{B.EXPERIMENTS}, means AS (SELECT profile, win, avg(ndcg) AS m FROM experiments GROUP BY profile, win),
steps AS (SELECT profile, m - lag(m) OVER (PARTITION BY profile ORDER BY win) AS step, row_number() OVER (PARTITION BY profile ORDER BY win DESC) AS r FROM means),
last AS (SELECT profile, step FROM steps WHERE r = 1),
signals AS (SELECT e.profile, avg(CASE WHEN delta < -0.001 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS collapse, stddev_pop(ndcg) AS oscillation, avg(abs(delta)) AS isomer, any_value(coalesce(step, 0.0::DOUBLE)) AS step FROM experiments e LEFT JOIN last ON e.profile = last.profile GROUP BY e.profile)"""


@query("GRAPH-8", sql(_SIGNALS, f"SELECT profile, {R('collapse')} AS collapse, {R('oscillation')} AS oscillation, {R('step')} AS covalent_change, {R('isomer')} AS isomer, {R('0.4 * (1 - least(greatest(collapse, 0), 1)) + 0.3 * (1 - least(greatest(isomer, 0), 1)) + 0.3 * (1 - least(greatest(abs(step), 0), 1))')} AS score, CASE WHEN collapse > 0.5 OR step > 0.1 OR isomer > 0.6 THEN 'critical' WHEN collapse > 0.2 OR oscillation > 0.005 OR step > 0.05 OR isomer > 0.3 THEN 'degrading' ELSE 'healthy' END AS class FROM signals"))
def structural_health(spark: SparkSession, d: str) -> DataFrame:
    """Per profile: persistent collapse, oscillation, change between the last two snapshots and isomer strength; score and class."""
    rows = B.experiments(spark, d)
    means = rows.groupBy("profile", "win").agg(F.avg("ndcg").alias("m"))
    step = F.col("m") - F.lag("m").over(Window.partitionBy("profile").orderBy("win"))
    last = ranked(means.withColumn("step", step), 1, ["profile"], F.col("win").desc()).select("profile", "step")
    found = rows.groupBy("profile").agg(F.avg(F.when(F.col("delta") < -0.001, 1.0).otherwise(0.0)).alias("collapse"), F.stddev_pop("ndcg").alias("oscillation"), F.avg(F.abs("delta")).alias("isomer")).join(last, "profile", "left").withColumn("step", F.coalesce("step", F.lit(0.0)))
    kind = gates.health_class(F.col("collapse"), F.col("oscillation"), F.col("step"), F.col("isomer"))
    score = gates.health(F.col("collapse"), F.col("isomer"), F.abs("step"))
    return found.select("profile", r6("collapse").alias("collapse"), r6("oscillation").alias("oscillation"), r6("step").alias("covalent_change"), r6("isomer").alias("isomer"), r6(score).alias("score"), kind.alias("class"))
