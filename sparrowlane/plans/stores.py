"""Queries: ingest and refresh of collections, embedding requests, read API, block images, presets, samples, self-edits, findings."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import presets as P
from ..functions import text as T
from ..functions import vector as V
from ..operators import adapters as A
from ..operators import events as E
from ..operators import gates as G
from ..operators import sampling, storage
from ..operators.ordering import numbered
from ..operators.topk import ranked
from ..registry import query
from ..session import new_path, written
from ..sources import collection as C
from ..sources.api import ReadApi
from . import base as B
from .base import r6, sql
from .base import r6_sql as R
from .evaluation import _unit_sql
from .language import _FAMILIES, _START, _family_sql
from .retrieval import _BOUNDED, _LOW, _MLP, _matvec

# ---------------------------------------------------------------- ingest and refresh

BATCH, START = 64, 5000


@query("SRC-7", f"WITH o AS (SELECT doc_id, source, lang, row_number() OVER (ORDER BY doc_id) - 1 AS at_ FROM documents) SELECT doc_id, (at_ + {START})::BIGINT AS point_id, (at_ // {BATCH})::BIGINT AS batch, CASE WHEN doc_id % 5 = 0 THEN '{{}}' ELSE '{{\"source\":\"' || source || '\",\"lang\":\"' || lang || '\"}}' END AS payload, (SELECT count(*) FROM o) AS total, (SELECT ceil(count(*) / {BATCH}.0)::BIGINT FROM o) AS batches, ({START} + (SELECT count(*) FROM o) - 1)::BIGINT AS end_id FROM o")
def streamed_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Micro-batches with ids that run on from a start; every fifth document comes without payload.  Totals are in each row."""
    rows = B.table(spark, d, "documents").select("doc_id", "source", "lang")
    payload = F.when(F.col("doc_id") % 5 != 0, F.to_json(F.struct("source", "lang")))
    placed = written(C.streamed(rows, "doc_id", BATCH, START, payload), "points")
    n = F.count("*")
    totals = F.broadcast(placed.agg(n.alias("total"), F.ceil(n / BATCH).alias("batches"), (F.lit(START) + n - 1).alias("end_id")))
    return placed.crossJoin(totals).select("doc_id", "point_id", "batch", "payload", "total", "batches", "end_id")


_KEYWORDS = rf"texts AS (SELECT doc_id, {_unit_sql('e')} AS v FROM (SELECT doc_id, {_family_sql()} AS e FROM (SELECT doc_id, regexp_split_to_array(translate(lower(text), '-', ' '), '\s+') AS w FROM documents)))"
_ADAPTED = f"{_KEYWORDS}, moved AS (SELECT doc_id, list_transform(list_zip(v, list_reverse(v)), lambda z: z[1] + 0.1::DOUBLE * z[2]) AS m FROM texts), fresh AS (SELECT doc_id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS v FROM moved), flat AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM fresh), scale AS (SELECT quantile_cont(abs(x), 0.99) / 127 AS s FROM flat)"


@query("SRC-8", sql(_ADAPTED, f"SELECT doc_id, {R('sum(x)')} AS total, {R('sum(x * pos)')} AS weighted, sum(least(greatest(round_even(x / s, 0), -127), 127))::BIGINT AS levels FROM flat CROSS JOIN scale GROUP BY doc_id"))
def refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Every stored vector again from its text through the adapter in use, plain and rounded to 127 levels."""
    rows = B.table(spark, d, "documents").select("doc_id", "text")
    base = V.unit(T.keyword_embedding(F.col("text"), _FAMILIES, _START))
    adapter = V.let(base, lambda v: V.unit(F.zip_with(v, F.reverse(v), lambda a, b: a + 0.1 * b)))
    plain = written(C.refreshed(rows, "text", "doc_id", adapter), "refreshed")
    coded = C.quantized(plain)
    place = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return coded.select(F.col("id").alias("doc_id"), r6(V.total(F.col("vector"))).alias("total"), r6(place).alias("weighted"), F.aggregate("levels", F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("levels"))


LENGTHS = (6000, 2000, 500)
SERVED_BYTES = 1600


def _sent_sql() -> str:
    out = "NULL"
    for n in reversed(LENGTHS):
        out = f"CASE WHEN octet_length(encode(substr(text, 1, {n}))) <= {SERVED_BYTES} THEN substr(text, 1, {n}) ELSE {out} END"
    return out


@query("SRC-15", rf"WITH s AS (SELECT doc_id, text, {_sent_sql()} AS sent FROM documents), e AS (SELECT doc_id, text, sent, CASE WHEN sent IS NULL THEN [0.0::DOUBLE, 0, 0, 0] ELSE {_unit_sql('raw')} END AS v FROM (SELECT *, {_family_sql()} AS raw FROM (SELECT *, regexp_split_to_array(translate(lower(coalesce(sent, '')), '-', ' '), '\s+') AS w FROM s))) SELECT doc_id, length(sent)::INTEGER AS sent, sent IS NULL AS failed, coalesce(length(sent) < length(text), true) AS truncated, {R('v[1]')} AS x1, {R('v[2]')} AS x2 FROM e")
def embedding_requests(spark: SparkSession, d: str) -> DataFrame:
    """Texts go to a server cut to 6,000 characters, then shorter where it refuses them; a text refused at every length is a zero vector.

    The server of the query takes 1,600 bytes and embeds by keywords.
    """
    rows = C.embedded(B.table(spark, d, "documents").select("doc_id", "text"), "text", LENGTHS, lambda t: F.octet_length(t) <= SERVED_BYTES, lambda t: V.unit(T.keyword_embedding(t, _FAMILIES, _START)), 4)
    return rows.select("doc_id", F.length("sent").alias("sent"), F.col("sent").isNull().alias("failed"), F.coalesce(F.length("sent") < F.length("text"), F.lit(True)).alias("truncated"), r6(F.element_at("vector", 1)).alias("x1"), r6(F.element_at("vector", 2)).alias("x2"))


@query("SRC-11", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def read_log(spark: SparkSession, d: str) -> DataFrame:
    """The events as lines of a log with blank lines between them, written and read again by lines."""
    path = new_path(spark, "lines")
    lines = B.table(spark, d, "events").select(F.explode(F.array(F.to_json(F.struct("event_id", F.from_json("props", "k long")["k"].alias("k"))), F.lit(""))).alias("value"))
    lines.write.text(path)
    return E.read_jsonl(spark, path, "event_id long, k long")


_API = """e AS (SELECT event_id, event_type, user_id, row_number() OVER (ORDER BY coalesce(epoch_us(ts), 0) DESC, event_id) AS r FROM events)
SELECT 'events' AS endpoint, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS json FROM e WHERE r <= 100
UNION ALL SELECT 'summary', '{"event_type":"' || event_type || '","n":' || count(*) || ',"users":' || count(DISTINCT user_id) || '}' FROM events GROUP BY event_type
UNION ALL SELECT 'sweep_results', '{"profile":"' || event_type || '","task":' || (user_id % 4) || ',"runs":' || count(*) || '}' FROM events GROUP BY event_type, user_id % 4
UNION ALL SELECT 'test_results', '{"priority":"' || o_orderpriority || '","passed":' || count(*) FILTER (o_orderstatus = 'F') || ',"total":' || count(*) || '}' FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'beir_results', '{"dataset":"' || source || '","num_docs":' || count(*) || '}' FROM documents GROUP BY source"""


@query("SRC-19", f"WITH {_API}")
def read_api(spark: SparkSession, d: str) -> DataFrame:
    """The bodies of the five endpoints."""
    events = B.table(spark, d, "events")
    orders, docs = B.table(spark, d, "orders"), B.table(spark, d, "documents")
    tables = {
        "events": events,
        "sweep_results": events.groupBy(F.col("event_type").alias("profile"), (F.col("user_id") % 4).alias("task")).agg(F.count("*").alias("runs")),
        "test_results": orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("passed"), F.count("*").alias("total")),
        "beir_results": docs.groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("num_docs")),
    }
    api, out = ReadApi(tables), None
    for name in ("events", "summary", "sweep_results", "test_results", "beir_results"):
        one = api.get(f"/api/{name}").select(F.lit(name).alias("endpoint"), "json")
        out = one if out is None else out.unionByName(one)
    return out


SIDE = 8
BLOCK = SIDE * SIDE * 2 + 8


@query("SRC-20", f"WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS at_, count(*) OVER () AS n FROM embeddings) SELECT vec_id, (at_ * {BLOCK})::BIGINT AS start, {BLOCK} AS bytes, CASE WHEN at_ = n - 1 THEN 0 ELSE (at_ + 1) * {BLOCK} END::BIGINT AS following, true AS inside, true AS close FROM o")
def block_image(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a block of half floats with the place of the next, written, read again and checked.

    A block lies inside the image if it and what it points to do; its numbers are close if they are the vector's within
    the precision of half floats.
    """
    rows = numbered(B.corpus(spark, d).select("vec_id", "v"), "vec_id")
    n = F.broadcast(rows.agg(F.count("*").alias("n")))
    rows = rows.crossJoin(n).withColumn("following", F.when(F.col("at") == F.col("n") - 1, 0).otherwise((F.col("at") + 1) * BLOCK).cast("long"))

    def pack(batches):
        for batch in batches:
            blocks = [storage.pack_block(np.array(v).reshape(SIDE, SIDE), f) for v, f in zip(batch.column("v").to_pylist(), batch.column("following").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "at", "n")), pa.array(blocks, pa.binary())], ["vec_id", "v", "at", "n", "block"])

    def check(batches):
        for batch in batches:
            following, inside, close = [], [], []
            for v, at, n, block in zip(*(batch.column(c).to_pylist() for c in ("v", "at", "n", "block")), strict=True):
                (f,) = struct.unpack_from("<Q", block, BLOCK - 8)
                following.append(f)
                inside.append(len(block) == BLOCK and 0 <= at * BLOCK <= (n - 1) * BLOCK and 0 <= f <= (n - 1) * BLOCK)
                close.append(bool(np.abs(np.frombuffer(block, "<f2", SIDE * SIDE).astype(float) - np.array(v)).max() < 1e-3))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("at"), pa.array(following, pa.int64()), pa.array(inside), pa.array(close)], ["vec_id", "at", "following", "inside", "close"])

    image = written(rows.select("vec_id", "v", "at", "n", "following").mapInArrow(pack, "vec_id long, v array<double>, at long, n long, block binary"), "image")
    back = image.mapInArrow(check, "vec_id long, at long, following long, inside boolean, close boolean")
    return back.select("vec_id", (F.col("at") * BLOCK).alias("start"), F.lit(BLOCK).alias("bytes"), "following", "inside", "close")


# ---------------------------------------------------------------- presets and adapters

_CHELATION = "p(number, name, percentile, threshold) AS (VALUES " + ", ".join(f"({i}, '{k}', {v['chelation_p']}::DOUBLE, {v['chelation_threshold']}::DOUBLE)" for i, (k, v) in enumerate(P.PRESETS["chelation"].items())) + ")"


@query("PRJ-16", f"WITH {_CHELATION} SELECT user_id, name AS preset, percentile, threshold, count(*) AS n, count(*) FILTER (value / 10000.0::DOUBLE > threshold) AS above, 19 AS families FROM events JOIN p ON user_id % 3 = number GROUP BY ALL")
def presets(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events under one of the presets of a family, looked up by name."""
    rows = [(i, name, float(x["chelation_p"]), float(x["chelation_threshold"])) for i, name in enumerate(P.PRESETS["chelation"]) for x in (P.preset(name, "chelation"),)]
    table = F.broadcast(spark.createDataFrame(rows, "number int, preset string, percentile double, threshold double"))
    events = B.table(spark, d, "events").withColumn("number", (F.col("user_id") % 3).cast("int")).join(table, "number")
    return events.groupBy("user_id", "preset", "percentile", "threshold").agg(F.count("*").alias("n"), F.count_if(F.col("value") / 10000.0 > F.col("threshold")).alias("above")).withColumn("families", F.lit(len(P.PRESETS)))


_UNIT64 = "list_transform(y, lambda x: x / greatest(sqrt(list_inner_product(y, y)), 1e-12::DOUBLE))"
_KINDS = f"""{B.CORPUS}, {_MLP}, mlps AS (SELECT vec_id, {_UNIT64} AS y FROM moved), {_LOW.replace('moved AS', 'lowered AS')}, {_BOUNDED.replace('FROM moved', 'FROM lowered')},
limited AS (SELECT vec_id, list_transform(list_zip(v, y), lambda z: z[1] + (z[2] - z[1]) * f) AS y FROM factored),
made AS (SELECT 'mlp' AS adapter, vec_id, y FROM mlps UNION ALL SELECT 'low_rank', vec_id, {_UNIT64} FROM lowered UNION ALL SELECT 'bounded_low_rank', vec_id, y FROM limited UNION ALL SELECT 'projection', vec_id, {_matvec('v', 16, 5)} FROM corpus)"""


@query("VEC-12", sql(_KINDS, f"SELECT adapter, vec_id, {R('list_sum(y)')} AS total, len(y)::INTEGER AS dim FROM made"))
def made_adapters(spark: SparkSession, d: str) -> DataFrame:
    """Adapters by name from the factory, each applied to all vectors; the kind that needs a linear solve is tested apart."""
    rows, out = B.corpus(spark, d), None
    weights = {"mlp": (A.rule_matrix(8, 64, 1), A.rule_matrix(8, 1, 3)[:, 0], A.rule_matrix(64, 8, 2), A.rule_matrix(64, 1, 4)[:, 0]), "low_rank": (A.rule_matrix(64, 4, 8), A.rule_matrix(64, 4, 9), A.rule_matrix(64, 1, 6)[:, 0]), "projection": (A.rule_matrix(16, 64, 5),)}
    for name, w in weights.items():
        made = A.applied(rows, A.create(name, *w), "v", "y", "vec_id", "v")
        for label, y in ((name, F.col("y")), *([(f"bounded_{name}", A.bounded(F.col("v"), F.col("y")))] if name == "low_rank" else [])):
            one = made.select(F.lit(label).alias("adapter"), "vec_id", y.alias("y")).select("adapter", "vec_id", r6(V.total(F.col("y"))).alias("total"), F.size("y").alias("dim"))
            out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- samples and grids

_HASH = "('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 15))::BIGINT"


@query("SAMP-1", f"WITH judged AS (SELECT DISTINCT doc_id FROM labels), sized AS (SELECT (SELECT count(*) FROM documents) * 3 // 5 AS n, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM judged)) AS have), rest AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM judged)) SELECT doc_id, true AS judged FROM documents WHERE doc_id IN (SELECT doc_id FROM judged) UNION ALL SELECT doc_id, false FROM rest CROSS JOIN sized WHERE r <= n - have")
def judged_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three fifths of the documents: all judged ones, and the smallest hashes of the rest."""
    docs, judged = B.table(spark, d, "documents").select("doc_id"), B.table(spark, d, "labels")
    found = sampling.judged_sample(docs, judged, docs.count() * 3 // 5, 42, "doc_id")
    return found.join(judged.select("doc_id", F.lit(True).alias("judged")).distinct(), "doc_id", "left").select("doc_id", F.coalesce("judged", F.lit(False)).alias("judged"))


@query("SAMP-2", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS at_ FROM (SELECT DISTINCT doc_id FROM labels WHERE quality > 0)) SELECT 'slice' AS kind, doc_id, at_::BIGINT AS at FROM o WHERE at_ < 20 UNION ALL SELECT 'window', doc_id, at_ FROM o WHERE at_ >= 10 AND at_ < 25".replace(" AS at FROM", ' AS "at" FROM'))
def query_slices(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty judged queries, and a window of exactly fifteen from the tenth on."""
    judged = B.table(spark, d, "labels").where("quality > 0").select("doc_id").distinct()
    first = sampling.query_slice(judged, "doc_id", 0, 20)
    window = sampling.query_slice(judged, "doc_id", 10, 15, exact=True)
    return first.select(F.lit("slice").alias("kind"), "doc_id", "at").unionByName(window.select(F.lit("window").alias("kind"), "doc_id", "at"))


# fixed values: the two grids
GRIDS = {
    "small": {"rate": [0.001, 0.01, 0.1], "threshold": [1, 3, 5], "noise": [0.0, 0.1, 0.2], "epochs": [5, 10, 20], "push": [0.1]},
    "large": {"rate": [0.001, 0.005, 0.01, 0.05, 0.1, 0.2, 0.5], "threshold": [1, 2, 3, 4, 5], "noise": [0.0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5], "epochs": [1, 3, 5, 10, 20, 50], "push": [0.01, 0.05, 0.1, 0.2, 0.5]},
}


def _grid_sql(name: str) -> str:
    values = {k: f"[{', '.join(str(x) + ('::DOUBLE' if isinstance(x, float) else '') for x in v)}]" for k, v in GRIDS[name].items()}
    return f"SELECT '{name}' AS grid, {', '.join(values)} FROM " + ", ".join(f"(SELECT unnest({v}) AS {k})" for k, v in values.items())


@query("SAMP-4", " UNION ALL ".join(_grid_sql(g) for g in GRIDS))
def parameter_grids(spark: SparkSession, d: str) -> DataFrame:
    """All combinations: 81 of the small grid, 7,350 of the large one."""
    out = None
    for grid, values in GRIDS.items():
        rows = spark.range(1).select(F.lit(grid).alias("grid"))
        for name, options in values.items():
            rows = rows.withColumn(name, F.explode(F.array(*(F.lit(x) for x in options))))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- self-edits and findings

MOST_DIRECTIVES = 4
_EDITS = f"""{B.EXPERIMENTS}, runs AS (SELECT profile, task, win, ndcg, base, delta, n, 0.9 * ndcg - base < 0.8 * delta AS lost, 1 + delta AS health, dense_rank() OVER (ORDER BY win) AS round,
 coalesce(max(ndcg) OVER (PARTITION BY profile, task ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.3::DOUBLE) AS best FROM experiments),
listed AS (SELECT *, list_filter(['seal_implication_sft', CASE WHEN delta < -0.05 THEN 'seal_retrieval_ttt' END, 'eggroll_low_rank_self_edit', CASE WHEN lost THEN 'quantization_survival_self_edit' END, CASE WHEN health < 0.7 THEN 'structural_repair_self_edit' END, 'retention_replay_guard'], lambda x: x IS NOT NULL)[1:{MOST_DIRECTIVES}] AS ds FROM runs),
judged AS (SELECT *, list_filter([CASE WHEN ndcg - best <= 0 THEN 'reward_not_positive' END, CASE WHEN base > 0 AND ndcg / base < 0.9 THEN 'retention_below_threshold' END, CASE WHEN lost THEN 'quantization_gate_failed' END], lambda x: x IS NOT NULL) AS why FROM listed)"""


@query("GATE-11", sql(_EDITS, f"SELECT profile, task, win, round, array_to_string(ds, ',') AS directives, {R('ndcg - best')} AS reward, len(why) = 0 AS accepted, array_to_string(why, ',') AS reasons, {R('greatest(best, ndcg)')} AS ledger_best, (sum(CASE WHEN len(why) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY profile, task ORDER BY win))::BIGINT AS accepted_so_far FROM judged"))
def self_edits(spark: SparkSession, d: str) -> DataFrame:
    """Directives of each run from its diagnostics, four at most; accepted if the reward over the best round so far is positive
    and neither retention nor the quantisation gate objects.  The ledger carries the best and what was accepted from round to round."""
    rows = B.experiments(spark, d)
    rounds = numbered(rows.select("win").distinct(), "win").select("win", (F.col("at") + 1).alias("round"))
    by = Window.partitionBy("profile", "task").orderBy("win")
    best = F.coalesce(F.max("ndcg").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.3))
    x = F.col("delta")
    lost = 0.9 * F.col("ndcg") - F.col("base") < 0.8 * x
    found = G.listed((F.lit(True), "seal_implication_sft"), (x < -0.05, "seal_retrieval_ttt"), (F.lit(True), "eggroll_low_rank_self_edit"), (lost, "quantization_survival_self_edit"), (1 + x < 0.7, "structural_repair_self_edit"), (F.lit(True), "retention_replay_guard"))
    rows = rows.join(F.broadcast(rounds), "win").withColumn("best", best)
    reward = F.col("ndcg") - F.col("best")
    why = G.listed((reward <= 0, "reward_not_positive"), ((F.col("base") > 0) & (F.col("ndcg") / F.col("base") < 0.9), "retention_below_threshold"), (lost, "quantization_gate_failed"))
    rows = rows.withColumns({"why": why, "ds": F.slice(found, 1, MOST_DIRECTIVES)})
    accepted = F.size("why") == 0
    so_far = F.sum(F.when(accepted, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("profile", "task", "win", "round", F.array_join("ds", ",").alias("directives"), r6(reward).alias("reward"), accepted.alias("accepted"), F.array_join("why", ",").alias("reasons"), r6(F.greatest("best", "ndcg")).alias("ledger_best"), so_far.alias("accepted_so_far"))


_FINDINGS = """kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1),
deps AS (SELECT l_orderkey, bool_or(l_linestatus <> 'F') AS open, count(*) AS dependencies, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey),
f AS (SELECT k.o_orderkey, k.o_custkey, substr(o_orderpriority, 1, 1)::INTEGER AS tier, coalesce(open, false) AS blocked, coalesce(returned, false) AS returned, o_totalprice / (1 + coalesce(dependencies, 0)) AS score FROM kept k LEFT JOIN deps d ON d.l_orderkey = k.o_orderkey),
walls AS (SELECT o_custkey, min(tier) AS wall FROM f WHERE blocked GROUP BY o_custkey),
status AS (SELECT f.*, CASE WHEN wall IS NOT NULL AND tier > wall THEN 'open' WHEN blocked THEN 'blocked' WHEN returned THEN 'merged' ELSE 'closed' END AS status, row_number() OVER (PARTITION BY f.o_custkey ORDER BY tier, round(score, 6) DESC, o_orderkey) AS place FROM f LEFT JOIN walls w ON f.o_custkey = w.o_custkey)"""


@query("GATE-12", sql(_FINDINGS, "SELECT o_orderkey, o_custkey, tier, place::INTEGER AS place, status FROM status"))
def findings_workflow(spark: SparkSession, d: str) -> DataFrame:
    """Orders as findings of their customer: one for each day, ranked by tier and impact over effort, and remediated tier by tier.

    A finding with an open dependency is blocked; no tier after one with a blocked finding is begun.  What is remediated is
    merged, and closed where its verification (no returned line) passes.
    """
    kept = ranked(B.table(spark, d, "orders"), 1, ["o_custkey", "o_orderdate"], "o_orderkey").drop("rank")
    deps = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_linestatus") != "F").alias("open"), F.count("*").alias("dependencies"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    rows = kept.join(deps, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"), F.coalesce("open", F.lit(False)).alias("blocked"), F.coalesce("returned", F.lit(False)).alias("returned"), (F.col("o_totalprice") / (1 + F.coalesce("dependencies", F.lit(0)))).alias("score"))
    wall = F.min(F.when(F.col("blocked"), F.col("tier"))).over(Window.partitionBy("o_custkey"))
    status = F.when(F.col("tier") > F.col("wall"), "open").when(F.col("blocked"), "blocked").when(F.col("returned"), "merged").otherwise("closed")
    rows = ranked(rows.withColumn("wall", wall), None, ["o_custkey"], "tier", F.round("score", 6).desc(), "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "tier", F.col("rank").alias("place"), status.alias("status"))


# ---------------------------------------------------------------- teachers by language

TEACHERS = [("en", "minilm", 4, 1.0), ("de", "gbert", 4, 0.5), ("fr", "camembert", 4, 0.25)]
_TEACH = "CASE lang WHEN 'en' THEN 'minilm' WHEN 'de' THEN 'gbert' WHEN 'fr' THEN 'camembert' ELSE 'multilingual' END"
_SHIFT = "CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'de' THEN 0.5::DOUBLE WHEN 'fr' THEN 0.25::DOUBLE ELSE 0.125::DOUBLE END"


@query("RUN-5", rf"WITH k AS (SELECT doc_id, lang, {_family_sql()} AS e FROM (SELECT doc_id, lang, regexp_split_to_array(translate(lower(text), '-', ' '), '\s+') AS w FROM documents)), m AS (SELECT doc_id, {_TEACH} AS teacher, list_transform(e, lambda x, i: x + {_SHIFT} * (i - 1)) AS e FROM k) SELECT doc_id, teacher, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS place, {', '.join(f'{R(f'e[{i}] / sqrt(list_inner_product(e, e))')} AS x{i}' for i in range(1, 5))} FROM m")
def routed_teachers(spark: SparkSession, d: str) -> DataFrame:
    """Each text is encoded by the teacher of its language, and the vectors are put together again in the order of the texts."""
    table = spark.createDataFrame(TEACHERS, "lang string, teacher string, dim int, shift double")
    rows = C.routed(B.table(spark, d, "documents").select("doc_id", "lang", "text"), table, "lang", ("multilingual", 4, 0.125))
    encode = V.unit(F.transform(T.keyword_embedding(F.col("text"), _FAMILIES, [*_START]), lambda x, i: x + F.col("shift") * i))
    placed = numbered(rows.select("doc_id", "teacher", encode.alias("v")), "doc_id")
    return placed.select("doc_id", "teacher", F.col("at").alias("place"), *(r6(F.element_at("v", i)).alias(f"x{i}") for i in range(1, 5)))
