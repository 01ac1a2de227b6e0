"""Queries: evaluation of profiles, supervised masks and gates, campaigns, and retrieval by texts and their variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import adapters as A
from ..operators import campaigns, fusion, metrics
from ..operators import gates as G
from ..operators import neighborhood as N
from ..operators.ordering import numbered
from ..operators.topk import cosine_top_k, ranked, route_scores
from ..registry import query
from ..session import new_path, written
from ..sources.checkpoints import Checkpoints
from . import base as B
from .base import r6, sql
from .base import r6_sql as R
from .language import _FAMILIES, _NEG, _START, _STOP, _CUES, _TOKENS, _family_sql, _split_sql, _trees, _TREE, _atomic_sql
from .retrieval import _DELTAS, harmful_dimensions, metrics_of

# ---------------------------------------------------------------- profiles

_ACTS = "acts AS (SELECT query_id, global_variance, CASE WHEN global_variance > (SELECT quantile_cont(global_variance, 0.5) FROM spread) THEN 'CHELATE' ELSE 'FAST' END AS action FROM spread)"
_ACTION = "CASE r.profile WHEN 'masked' THEN a.action WHEN 'centered' THEN 'CHELATE_ALWAYS' ELSE 'FAST' END"


def _actions(spark: SparkSession, hits: DataFrame) -> DataFrame:
    """query_id, global_variance and the adaptive action: re-rank over the median spread."""
    s = N.spread(N.dimension_stats(hits))
    cut = F.broadcast(s.agg(F.percentile("global_variance", F.lit(0.5)).alias("cut")))
    return s.crossJoin(cut).select("query_id", "global_variance", N.decision(F.col("global_variance"), F.col("cut"), True, False).alias("action"))


def _profile_action(adaptive: str = "action"):
    return F.when(F.col("profile") == "masked", F.col(adaptive)).when(F.col("profile") == "centered", "CHELATE_ALWAYS").otherwise("FAST")


@query("AGG-13", sql(f"{_DELTAS}, {_ACTS}, tops AS (SELECT profile, query_id, vec_id FROM rankings WHERE rank = 1)", f"""SELECT r.profile, count(*) AS queries, {R('avg(delta)')} AS mean_delta, count(*) FILTER (round(delta, 9) > 0) AS positive, count(*) FILTER (round(delta, 9) < 0) AS negative, count(*) FILTER (round(delta, 9) = 0) AS unchanged,
 count(*) FILTER (t.vec_id <> b.vec_id) AS top_doc_changed, count(*) FILTER ({_ACTION} = 'CHELATE') AS chelate, count(*) FILTER ({_ACTION} = 'CHELATE_ALWAYS') AS chelate_always, count(*) FILTER ({_ACTION} = 'FAST') AS fast
 FROM attributed r JOIN acts a ON r.query_id = a.query_id JOIN tops t ON t.profile = r.profile AND t.query_id = r.query_id JOIN tops b ON b.profile = 'baseline' AND b.query_id = r.query_id WHERE r.profile <> 'baseline' GROUP BY r.profile"""))
def attribution_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per profile without the baseline: signs of the deltas, changed top documents, and the histogram of actions."""
    hits = B.scout(spark, d)
    rankings = B.rankings(hits)
    found = metrics_of(hits, rankings)
    tops = rankings.where("rank = 1").select("profile", "query_id", F.col("vec_id").alias("top"))
    base = found.where("profile = 'baseline'").select("query_id", F.col("ndcg").alias("base")).join(tops.where("profile = 'baseline'").select("query_id", F.col("top").alias("base_top")), "query_id")
    rows = found.where("profile <> 'baseline'").join(base, "query_id").join(tops, ["profile", "query_id"]).join(_actions(spark, hits), "query_id")
    x = F.col("ndcg") - F.col("base")
    sign, act = F.round(x, 9), _profile_action()
    return rows.groupBy("profile").agg(F.count("*").alias("queries"), r6(F.avg(x)).alias("mean_delta"), F.count_if(sign > 0).alias("positive"), F.count_if(sign < 0).alias("negative"), F.count_if(sign == 0).alias("unchanged"), F.count_if(F.col("top") != F.col("base_top")).alias("top_doc_changed"), *(F.count_if(act == a).alias(a.lower()) for a in ("CHELATE", "CHELATE_ALWAYS", "FAST")))


_CONTROL = f"""{B.TO_RANKINGS}, {_ACTS}, sets AS (SELECT profile, query_id, list(vec_id) AS s FROM rankings GROUP BY profile, query_id),
diag AS (SELECT r.profile, r.query_id, {_ACTION} AS action, global_variance, len(list_intersect(r.s, b.s)) / (20.0 - len(list_intersect(r.s, b.s))) AS jaccard, CASE r.profile WHEN 'masked' THEN list_avg(m.mask) ELSE 1.0::DOUBLE END AS density
 FROM sets r JOIN sets b ON b.profile = 'baseline' AND r.query_id = b.query_id JOIN acts a ON a.query_id = r.query_id JOIN masks m ON m.query_id = r.query_id)"""


@query("AGG-34", sql(_CONTROL, f"SELECT d.profile, d.action, count(*) AS n, any_value(p.queries) AS queries, any_value({R('variance')}) AS variance_mean, any_value({R('p.jaccard')}) AS jaccard_mean, any_value({R('p.density')}) AS mask_density_mean, any_value(changed) AS changed FROM diag d JOIN (SELECT profile, count(*) AS queries, avg(global_variance) AS variance, avg(jaccard) AS jaccard, avg(density) AS density, count(*) FILTER (jaccard < 1) AS changed FROM diag GROUP BY profile) p ON d.profile = p.profile GROUP BY d.profile, d.action"))
def control_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """The actions of each profile, and means of variance, overlap with the baseline, mask density; queries whose results changed."""
    hits = B.scout(spark, d)
    sets = B.rankings(hits).groupBy("profile", "query_id").agg(F.collect_set("vec_id").alias("s"))
    base = sets.where("profile = 'baseline'").select("query_id", F.col("s").alias("b"))
    masks = N.variance_mask(N.dimension_stats(hits)).select("query_id", (V.total(F.col("mask")) / F.size("mask")).alias("mask_density"))
    rows = sets.join(base, "query_id").join(masks, "query_id").join(_actions(spark, hits), "query_id")
    rows = rows.select("profile", _profile_action().alias("act"), "global_variance", N.jaccard(F.col("s"), F.col("b")).alias("jaccard"), F.when(F.col("profile") == "masked", F.col("mask_density")).otherwise(1.0).alias("density"))
    whole = rows.groupBy("profile").agg(F.count("*").alias("queries"), r6(F.avg("global_variance")).alias("variance_mean"), r6(F.avg("jaccard")).alias("jaccard_mean"), r6(F.avg("density")).alias("mask_density_mean"), F.count_if(F.col("jaccard") < 1).alias("changed"))
    return rows.groupBy("profile", F.col("act").alias("action")).agg(F.count("*").alias("n")).join(whole, "profile")


# fixed values: names of the compared configurations, and the ranking of each; adapters start as the identity and an option
# that is declared but read nowhere changes nothing
CONFIGURATIONS = [("baseline", "baseline"), ("chelation", "masked"), ("chelation+tempscale_0.5", "masked"), ("chelation+tempscale_2.0", "masked"), ("procrustes", "baseline"), ("low_rank_16", "baseline"), ("online_updates", "baseline"), ("random_mask_50pct", "baseline")]
_CONFIG_SQL = "configs(config, profile) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in CONFIGURATIONS) + ")"
_MEANS = "means AS (SELECT profile, round(avg(ndcg), 4) AS ndcg, round(avg(ap), 4) AS map, round(avg(rr), 4) AS mrr, round(avg(recall), 4) AS recall FROM metrics GROUP BY profile)"
_SHOWN = ("ndcg", "map", "mrr", "recall")


@query("AGG-35", sql(f"{B.TO_METRICS}, {_MEANS}, {_CONFIG_SQL}", "SELECT rpad(config, 25, ' ') || ' | ' || " + " || ' | ' || ".join(f"lpad(format('{{:.4f}}', {c} + 0.0::DOUBLE), 9, ' ')" for c in _SHOWN) + " AS line, '{\"config_name\":\"' || config || '\"' || " + " || ".join(f"',\"{c}\":\"' || format('{{:.4f}}', {c} + 0.0::DOUBLE) || '\"'" for c in _SHOWN) + " || '}' AS json FROM configs c JOIN means m ON c.profile = m.profile"))
def comparative_table(spark: SparkSession, d: str) -> DataFrame:
    """The eight named configurations, one scouting for all: as lines of a table and as JSON."""
    means = metrics_of(B.scout(spark, d)).groupBy("profile").agg(*(F.round(F.avg(c), 4).alias(n) for c, n in zip(("ndcg", "ap", "rr", "recall"), _SHOWN, strict=True)))
    rows = F.broadcast(spark.createDataFrame(CONFIGURATIONS, "config string, profile string")).join(means, "profile")
    shown = [F.format_string("%.4f", F.col(c)) for c in _SHOWN]
    line = F.concat_ws(" | ", F.rpad("config", 25, " "), *(F.lpad(c, 9, " ") for c in shown))
    return rows.select(line.alias("line"), F.to_json(F.struct(F.col("config").alias("config_name"), *(c.alias(n) for c, n in zip(shown, _SHOWN, strict=True)))).alias("json"))


_LIVE = f"""{B.TO_METRICS}, {_ACTS}, fit AS (SELECT profile, 0.6 * avg(ndcg) + 0.2 * avg(rr) + 0.2 * avg(recall) AS fitness FROM metrics GROUP BY profile),
vals AS (SELECT (SELECT fitness FROM fit WHERE profile = 'baseline') AS base, (SELECT fitness FROM fit WHERE profile = 'masked') AS live, (SELECT avg(CASE WHEN action LIKE 'CHELATE%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM acts) AS rate, (SELECT avg(sqrt(list_inner_product(v, v))) FROM scout) AS norm),
checks AS (SELECT unnest([{{'name': 'baseline_retrieval_fitness', 'value': base, 'low': 0.3, 'high': NULL}}, {{'name': 'live_retrieval_fitness', 'value': live, 'low': 0.3, 'high': NULL}}, {{'name': 'chelate_rate', 'value': rate, 'low': 0.0, 'high': 1.0}}, {{'name': 'norm_ratio_hard_band', 'value': norm, 'low': 0.5, 'high': 2.0}}, {{'name': 'convergence_guard', 'value': live / greatest(base, 1e-12), 'low': 0.95, 'high': NULL}}], recursive := true) FROM vals)"""


@query("AGG-36", sql(_LIVE, f"SELECT name AS \"check\", {R('value')} AS value, CASE WHEN value < low OR value > high THEN 'fail' ELSE 'pass' END AS status FROM checks"))
def live_checks(spark: SparkSession, d: str) -> DataFrame:
    """The rate of re-ranked queries and the table of checks: each value in its band passes."""
    hits = B.scout(spark, d)
    fitness = 0.6 * F.avg("ndcg") + 0.2 * F.avg("rr") + 0.2 * F.avg("recall")
    of = lambda p: F.max(F.when(F.col("profile") == p, F.col("f")))
    fit = metrics_of(hits).groupBy("profile").agg(fitness.alias("f")).agg(of("baseline").alias("base"), of("masked").alias("live"))
    rate = _actions(spark, hits).agg(F.avg(F.col("action").startswith("CHELATE").cast("double")).alias("rate"))
    norm = hits.agg(F.avg(V.norm(F.col("v"))).alias("norm"))
    one = lambda name, value, low, high: F.struct(F.lit(name).alias("check"), value.alias("value"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"))
    base, live = F.col("base"), F.col("live")
    rows = fit.crossJoin(rate).crossJoin(norm).select(F.inline(F.array(one("baseline_retrieval_fitness", base, 0.3, None), one("live_retrieval_fitness", live, 0.3, None), one("chelate_rate", F.col("rate"), 0.0, 1.0), one("norm_ratio_hard_band", F.col("norm"), 0.5, 2.0), one("convergence_guard", live / F.greatest(base, F.lit(1e-12)), 0.95, None))))
    bad = F.coalesce(F.col("value") < F.col("low"), F.lit(False)) | F.coalesce(F.col("value") > F.col("high"), F.lit(False))
    return rows.select("check", r6("value").alias("value"), F.when(bad, "fail").otherwise("pass").alias("status"))


# ---------------------------------------------------------------- supervised mask and its probe

MASKED_DIMS = 6


def _ndcg_sql(name: str, source: str) -> str:
    """``name(query_id, ndcg)`` of ``source(query_id, rank, grade)`` at ten; the ideal is that of the retrieved grades."""
    return f"""{name} AS (SELECT query_id, CASE WHEN sum(grade / log2(ideal + 1)) > 0 THEN sum(grade / log2(rank + 1)) / sum(grade / log2(ideal + 1)) ELSE 0.0::DOUBLE END AS ndcg
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM {source} WHERE rank <= 10) GROUP BY query_id)"""


_PROBE = f"""{B.TO_SCOUT}, split AS (SELECT query_id, 2 * (row_number() OVER (ORDER BY query_id) - 1) < count(*) OVER () AS train FROM queries),
rel AS (SELECT label, pos, avg(x) AS m FROM dims GROUP BY label, pos),
noise AS (SELECT query_id, v FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY rank) AS n FROM scout s JOIN split t ON s.query_id = t.query_id AND t.train WHERE label <> query_label) WHERE n <= 5),
bad AS (SELECT query_id, pos, avg(x) AS m FROM (SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM noise) GROUP BY query_id, pos),
qd AS (SELECT query_id, query_label, unnest(q) AS x, generate_subscripts(q, 1) AS pos FROM queries),
harm AS (SELECT qd.pos, sum(greatest(0.0::DOUBLE, qd.x * bad.m - qd.x * rel.m)) AS harm FROM qd JOIN bad ON qd.query_id = bad.query_id AND qd.pos = bad.pos JOIN rel ON qd.query_label = rel.label AND qd.pos = rel.pos GROUP BY qd.pos),
gone AS (SELECT coalesce(list(pos), []) AS dims FROM (SELECT pos FROM harm WHERE harm > 0 ORDER BY harm DESC, pos LIMIT {MASKED_DIMS})),
zeroed AS (SELECT vec_id, label, list_transform(v, lambda x, i: CASE WHEN list_contains(dims, i) THEN 0.0::DOUBLE ELSE x END) AS v FROM corpus CROSS JOIN gone),
asked AS (SELECT q.query_id, q.query_label, z.v AS q FROM queries q JOIN zeroed z ON q.query_id = z.vec_id),
found AS (SELECT query_id, CASE WHEN label = query_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grade, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(z.v, a.q), 12) DESC, z.vec_id) AS rank FROM zeroed z CROSS JOIN asked a WHERE z.vec_id <> a.query_id),
plain AS (SELECT query_id, rank, CASE WHEN label = query_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS grade FROM scout),
{_ndcg_sql('before', 'plain')}, {_ndcg_sql('after', 'found')},
sides AS (SELECT CASE WHEN train THEN 'train' ELSE 'holdout' END AS split, count(*) AS queries, avg(b.ndcg) AS baseline, avg(a.ndcg) AS masked FROM split s JOIN before b ON s.query_id = b.query_id JOIN after a ON s.query_id = a.query_id GROUP BY train)"""


def _graded(rows: DataFrame) -> DataFrame:
    return metrics.per_query(rows, rows.where("label = query_label").select("query_id", "vec_id", F.lit(1.0).alias("grade")))


def learned_dims(hits: DataFrame, rows: DataFrame, queries: DataFrame, most: int) -> list[int]:
    """Positions of the ``most`` most harmful dimensions, as learned from the scouted rows of ``queries``."""
    harm = harmful_dimensions(hits.join(queries.select("query_id"), "query_id", "left_semi"), B.centroids(rows), queries)
    return [r["pos"] for r in harm.where("harm > 0").orderBy(F.col("harm").desc(), "pos").limit(most).collect()]


def _masked(c: str, gone: list[int]):
    return F.transform(c, lambda x, i: F.when(i.isin(gone), 0.0).otherwise(x)) if gone else F.col(c)


@query("MASK-6", sql(_PROBE, f"SELECT split, queries, {R('baseline')} AS baseline, {R('masked')} AS masked, {R('masked - baseline')} AS delta, (SELECT max(masked - baseline) FILTER (split = 'holdout') > 0.001 AND min(masked - baseline) FILTER (split = 'train') >= 0 FROM sides) AS promotion_candidate, (SELECT array_to_string(list_sort(list_transform(dims, lambda x: x - 1)), ',') FROM gone) AS dims FROM sides"))
def mask_probe(spark: SparkSession, d: str) -> DataFrame:
    """A mask learned from the first half of the queries, and what it does to them and to the half held out."""
    rows, hits = B.corpus(spark, d), B.scout(spark, d)
    asked = written(numbered(B.queries(rows), "query_id"), "split")
    n = asked.count()
    asked = asked.withColumn("train", 2 * F.col("at") < n)
    gone = learned_dims(hits, rows, asked.where("train"), MASKED_DIMS)
    masked = cosine_top_k(rows.withColumn("v", _masked("v", gone)), asked.withColumn("q", _masked("q", gone)), B.RESULT_K, own=False, keep=("label",)).join(F.broadcast(asked.select("query_id", "query_label")), "query_id")
    before, after = (_graded(x).select("query_id", F.col("ndcg").alias(k)) for k, x in (("before", hits), ("after", masked)))
    split = F.when(F.col("train"), "train").otherwise("holdout").alias("split")
    sides = asked.select("query_id", "train").join(before, "query_id").join(after, "query_id").groupBy(split).agg(F.count("*").alias("queries"), F.avg("before").alias("baseline"), F.avg("after").alias("masked"))
    delta = F.col("masked") - F.col("baseline")
    of = lambda s: F.max(F.when(F.col("split") == s, delta))
    verdict = F.broadcast(sides.agg(((of("holdout") > 0.001) & (of("train") >= 0)).alias("promotion_candidate")))
    return sides.crossJoin(verdict).select("split", "queries", r6("baseline").alias("baseline"), r6("masked").alias("masked"), r6(delta).alias("delta"), "promotion_candidate", F.lit(",".join(map(str, sorted(gone)))).alias("dims"))


# ---------------------------------------------------------------- gates from examples

_LEXICAL = f"""lexical AS (SELECT item_id, len(w)::BIGINT AS tokens, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains({_STOP}, x))) / len(w)::DOUBLE ELSE 0.0::DOUBLE END AS stopwords,
 len(list_filter(w, lambda x: list_contains({_NEG}, x)))::BIGINT AS negations, len(list_filter(w, lambda x: list_contains({_CUES}, x)))::BIGINT AS cues FROM (SELECT item_id, {_TOKENS.format('text')} AS w FROM benchmark))"""


@query("GATE-7", sql(f"{B.TO_METRICS}, {_LEXICAL}, tops AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top, max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) AS margin, any_value(sqrt(list_inner_product(q, q))) AS norm FROM scout GROUP BY query_id)", f"SELECT b.query_id, {R('m.ndcg - b.ndcg')} AS delta, {R('m.rr - b.rr')} AS delta_mrr, b.first_rank::INTEGER AS baseline_rank, m.first_rank::INTEGER AS masked_rank, {R('margin')} AS margin, {R('top')} AS top_score, {R('norm')} AS query_norm, tokens, {R('stopwords')} AS stopword_ratio, negations, cues FROM metrics b JOIN metrics m ON b.query_id = m.query_id AND m.profile = 'masked' JOIN tops t ON t.query_id = b.query_id LEFT JOIN lexical l ON l.item_id = b.query_id % 40 WHERE b.profile = 'baseline'"))
def conditional_examples(spark: SparkSession, d: str) -> DataFrame:
    """What the mask does to each query, with the features that a gate may look at; the texts are the benchmark's."""
    hits = B.scout(spark, d)
    found = metrics_of(hits)
    side = lambda p, k: found.where(F.col("profile") == p).select("query_id", F.col("ndcg").alias(f"ndcg_{k}"), F.col("rr").alias(f"rr_{k}"), F.col("first_relevant_rank").alias(f"rank_{k}"))
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    tops = hits.groupBy("query_id").agg(at(1).alias("top"), (at(1) - at(2)).alias("margin"), F.any_value(V.norm(F.col("q"))).alias("norm"))
    f = T.lexical_features(F.col("text"))
    texts = B.table(spark, d, "benchmark").select("item_id", f["token_count"].alias("tokens"), f["stopword_ratio"].alias("stopwords"), f["negation_count"].alias("negations"), f["claim_cue_count"].alias("cues"))
    rows = side("baseline", "b").join(side("masked", "m"), "query_id").join(tops, "query_id").withColumn("item_id", F.col("query_id") % 40).join(texts, "item_id", "left")
    return rows.select("query_id", r6(F.col("ndcg_m") - F.col("ndcg_b")).alias("delta"), r6(F.col("rr_m") - F.col("rr_b")).alias("delta_mrr"), F.col("rank_b").alias("baseline_rank"), F.col("rank_m").alias("masked_rank"), r6("margin").alias("margin"), r6("top").alias("top_score"), r6("norm").alias("query_norm"), "tokens", r6("stopwords").alias("stopword_ratio"), "negations", "cues")


FEATURES = ("base", "n", "ndcg")
_EXAMPLES = f"""{B.EXPERIMENTS}, ex AS (SELECT base, n::DOUBLE AS n, ndcg, delta, row_number() OVER (ORDER BY win, task, profile) - 1 AS place, count(*) OVER () AS total FROM experiments),
split AS (SELECT *, place < greatest(1, round_even(total * 0.6::DOUBLE, 0)) AS train FROM ex),
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS x, delta, train FROM split" for c in FEATURES)}),
cuts AS (SELECT feature, unnest([quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75)]) AS cut, unnest([25, 50, 75]) AS quartile FROM long WHERE train GROUP BY feature),
cells AS (SELECT l.feature, quartile, op, count(*) FILTER (train) AS support, avg(delta) FILTER (train) AS mean, count(*) FILTER (train AND delta < 0) AS negative, count(*) FILTER (NOT train) AS held, avg(delta) FILTER (NOT train) AS held_mean, count(*) FILTER (NOT train AND delta < 0) AS held_negative
 FROM long l JOIN cuts c ON l.feature = c.feature CROSS JOIN (VALUES ('<='), ('>=')) o(op) WHERE CASE op WHEN '<=' THEN x <= cut ELSE x >= cut END GROUP BY ALL),
judged AS (SELECT *, support >= 3 AND coalesce(mean >= 0.001, false) AND negative <= 0.6::DOUBLE * support AS accepted, support >= 3 AND coalesce(mean >= 0.001, false) AND negative <= 0.6::DOUBLE * support AND held >= 1 AND coalesce(held_mean >= 0, false) AND held_negative <= 0.6::DOUBLE * held AS validated FROM cells)"""


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """Experiments in order, the first six tenths to train on."""
    rows = numbered(B.experiments(spark, d).withColumn("n", F.col("n").cast("double")), "win", "task", "profile")
    total = F.broadcast(rows.agg(F.greatest(F.lit(1.0), F.rint(F.count("*") * 0.6)).alias("first")))
    return rows.crossJoin(total).withColumn("train", F.col("at") < F.col("first"))


@query("GATE-6", sql(_EXAMPLES, f"SELECT feature, quartile, op, support, {R('mean')} AS mean, negative, held, {R('held_mean')} AS held_mean, held_negative, accepted, validated FROM judged"))
def conditional_gates(spark: SparkSession, d: str) -> DataFrame:
    """One-feature gates at the quartiles with both operators: accepted by the training rows, validated by those held out.

    Both ask for a share of losses of three fifths at most.
    """
    rows = _examples(spark, d)
    long = rows.select("delta", "train", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in FEATURES))))
    cuts = long.where("train").groupBy("feature").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("c"))
    cuts = cuts.select("feature", F.posexplode("c").alias("i", "cut")).select("feature", "cut", ((F.col("i") + 1) * 25).alias("quartile"))
    matched = long.join(F.broadcast(cuts), "feature").withColumn("op", F.explode(F.array(F.lit("<="), F.lit(">=")))).where(G.holds(F.col("x"), F.col("op"), F.col("cut")))
    on = lambda train: F.when(F.col("train") == train, F.col("delta"))
    cells = matched.groupBy("feature", "quartile", "op").agg(F.count(on(True)).alias("support"), F.avg(on(True)).alias("mean"), F.count_if(on(True) < 0).alias("negative"), F.count(on(False)).alias("held"), F.avg(on(False)).alias("held_mean"), F.count_if(on(False) < 0).alias("held_negative"))
    accepted = (F.col("support") >= 3) & F.coalesce(F.col("mean") >= 0.001, F.lit(False)) & (F.col("negative") <= 0.6 * F.col("support"))
    validated = accepted & (F.col("held") >= 1) & F.coalesce(F.col("held_mean") >= 0, F.lit(False)) & (F.col("held_negative") <= 0.6 * F.col("held"))
    return cells.select("feature", "quartile", "op", "support", r6("mean").alias("mean"), "negative", "held", r6("held_mean").alias("held_mean"), "held_negative", accepted.alias("accepted"), validated.alias("validated"))


@query("GATE-6-CLASSIFIER")
def classifier_gate(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: gradient steps; a regularised classifier of gains as gate, with its support and mean on both splits.

    The fit reads one row per profile, task and day; the test compares it with plain numpy.
    """
    rows = written(_examples(spark, d), "examples")
    train = rows.where("train").select(*FEATURES, (F.col("delta") > 0.001).cast("double").alias("y"))
    weights, bias, centre, scale = A.fit_standardised(train, list(FEATURES), "y", l2=0.08)
    z = sum(((F.col(c) - float(m)) / float(s) * float(w) for c, w, m, s in zip(FEATURES, weights, centre, scale, strict=True)), F.lit(float(bias)))
    chosen = rows.withColumn("p", G.logistic(z)).where("p >= 0.5")
    out = chosen.groupBy(F.when(F.col("train"), "train").otherwise("validation").alias("split")).agg(F.count("*").alias("support"), r6(F.avg("delta")).alias("mean"), F.count_if(F.col("delta") < 0).alias("negative"))
    return out


# ---------------------------------------------------------------- campaigns

_CAMPAIGN = f"{B.TO_METRICS}, placed AS (SELECT query_id, ((row_number() OVER (ORDER BY query_id) - 1) // 4)::BIGINT AS win FROM queries)"


@query("RUN-1", sql(_CAMPAIGN, f"SELECT win AS \"window\", profile, CASE WHEN win % 2 = 0 THEN 'calibration' ELSE 'confirmation' END AS phase, count(*) AS queries, {R('avg(ndcg)')} AS ndcg, {R('avg(ap)')} AS map, {R('avg(rr)')} AS mrr, {R('avg(recall)')} AS recall FROM metrics m JOIN placed p ON m.query_id = p.query_id GROUP BY win, profile"))
def campaign(spark: SparkSession, d: str) -> DataFrame:
    """All profiles over windows of four queries in two runs: the first stops after one window, the second does the rest.

    What a run finishes is a version of a store with digests; the second run finds it there and leaves it alone.  Even
    windows calibrate, odd ones confirm.
    """
    hits = B.scout(spark, d)
    windows = written(campaigns.windows_of(B.queries(B.corpus(spark, d)).select("query_id"), "query_id", 4), "windows")
    store = Checkpoints(spark, new_path(spark, "campaign"))

    def evaluate(open_: DataFrame) -> DataFrame:
        found = metrics_of(hits.join(F.broadcast(open_.select("query_id")), "query_id", "left_semi")).join(open_, "query_id")
        means = [r6(F.avg(c)).alias(n) for c, n in (("ndcg", "ndcg"), ("ap", "map"), ("rr", "mrr"), ("recall", "recall"))]
        return found.groupBy("window", "profile").agg(F.count("*").alias("queries"), *means)

    campaigns.resumed(windows, evaluate, store, most=1)
    out = campaigns.resumed(windows, evaluate, store)
    return out.withColumn("phase", F.when(F.col("window") % 2 == 0, "calibration").otherwise("confirmation"))


# ---------------------------------------------------------------- retrieval by texts

def _embedded(text: str = "text"):
    return V.unit(T.keyword_embedding(F.col(text), _FAMILIES, _START))


def _unit_sql(e: str) -> str:
    return f"list_transform({e}, lambda x: x / sqrt(list_inner_product({e}, {e})))"


_DOC_VECTORS = rf"docs AS (SELECT doc_id, {_unit_sql('e')} AS v FROM (SELECT doc_id, {_family_sql()} AS e FROM (SELECT doc_id, regexp_split_to_array(translate(lower(text), '-', ' '), '\s+') AS w FROM documents)))"
_VARIANTS_SQL = f"""kw AS (SELECT item_id, trim(text) AS original, list_filter({_TOKENS.format('text')}, lambda x: NOT list_contains({_STOP}, x)) AS k FROM benchmark),
vt AS (SELECT item_id, original, array_to_string(k, ' ') AS plain, array_to_string(k[1:2], ' ') AS focused, len(k) AS n FROM kw),
variants AS (SELECT item_id, 0 AS place, original AS t FROM vt UNION ALL SELECT item_id, 1, plain FROM vt WHERE n > 0 AND lower(original) <> plain UNION ALL SELECT item_id, 2, focused FROM vt WHERE n > 2 AND lower(original) <> focused)"""
_REFORM = rf"""{_DOC_VECTORS}, {_VARIANTS_SQL},
asked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY place) - 1 AS variant, {_unit_sql('e')} AS q FROM (SELECT item_id, place, {_family_sql()} AS e FROM (SELECT item_id, place, regexp_split_to_array(translate(lower(t), '-', ' '), '\s+') AS w FROM variants))),
hits AS (SELECT item_id, variant, doc_id, rank FROM (SELECT a.item_id, variant, doc_id, row_number() OVER (PARTITION BY a.item_id, variant ORDER BY round(list_cosine_similarity(v, q), 9) DESC, doc_id) AS rank FROM docs CROSS JOIN asked a) WHERE rank <= 10),
fused AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS rank FROM (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(variant * 1000 + rank) AS first FROM hits GROUP BY item_id, doc_id)),
kept AS (SELECT * FROM fused WHERE rank <= 10),
overlap AS (SELECT k.item_id, count(*) FILTER (h.doc_id IS NOT NULL) AS c FROM kept k LEFT JOIN hits h ON h.item_id = k.item_id AND h.variant = 0 AND h.doc_id = k.doc_id GROUP BY k.item_id),
numbers AS (SELECT item_id, count(*) AS variants FROM asked GROUP BY item_id)"""


def _keyword_hits(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best documents of each distinct query vector, once for all that ask it; there are two to the number of families."""
    vectors = asked.select("q").distinct().withColumn("query_id", F.xxhash64("q"))
    scored = cosine_top_k(docs, vectors, k, "doc_id")
    return asked.withColumn("vector", F.xxhash64("q")).join(F.broadcast(scored.withColumnRenamed("query_id", "vector")), "vector").drop("vector", "q")


@query("RUN-2-REFORMULATED", sql(_REFORM, f"SELECT k.item_id, k.rank::INTEGER AS rank, k.doc_id, {R('k.score', 9)} AS score, variants, {R('c / (20.0 - c)')} AS original_overlap, 'REFORMULATE' AS action, 'multi_variant_merge' AS policy FROM kept k JOIN overlap o ON k.item_id = o.item_id JOIN numbers n ON n.item_id = k.item_id"))
def reformulated_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Every variant of a query's text is searched, and the rankings fused; overlap with the original text's own results."""
    docs = B.table(spark, d, "documents").select("doc_id", _embedded().alias("v"))
    variants = B.table(spark, d, "benchmark").select("item_id", F.posexplode(T.variants(F.col("text"))).alias("variant", "t")).select("item_id", "variant", F.col("t.text").alias("text"))
    asked = variants.select("item_id", "variant", _embedded().alias("q"))
    hits = written(_keyword_hits(docs, asked, B.RESULT_K), "variant-hits")
    fused = hits.groupBy("item_id", "doc_id").agg(F.round(F.sum(1.0 / (60.0 + F.col("rank"))), 12).alias("score"), F.min(F.struct("variant", "rank")).alias("first"), F.bool_or(F.col("variant") == 0).alias("original"))
    kept = ranked(fused, B.RESULT_K, ["item_id"], F.col("score").desc(), "first")
    common = kept.groupBy("item_id").agg(F.count_if("original").alias("c"))
    numbers = variants.groupBy("item_id").agg(F.count("*").alias("variants"))
    out = kept.join(common, "item_id").join(numbers, "item_id")
    return out.select("item_id", "rank", "doc_id", r6("score", 9).alias("score"), "variants", r6(F.col("c") / (20.0 - F.col("c"))).alias("original_overlap"), F.lit("REFORMULATE").alias("action"), F.lit("multi_variant_merge").alias("policy"))


_RECURSIVE = rf"""{_DOC_VECTORS}, leaves AS (SELECT conv_id, turn, node, text FROM tree WHERE depth = 3 OR {_atomic_sql('text')} OR len({_split_sql('text')}) < 2),
asked AS (SELECT conv_id, turn, node, {_unit_sql('e')} AS q FROM (SELECT conv_id, turn, node, {_family_sql()} AS e FROM (SELECT conv_id, turn, node, regexp_split_to_array(translate(lower(text), '-', ' '), '\s+') AS w FROM leaves))),
vectors AS (SELECT DISTINCT q FROM asked),
hits AS (SELECT q, doc_id, rank FROM (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(v, q), 9) DESC, doc_id) AS rank FROM docs CROSS JOIN vectors) WHERE rank <= 10),
fused AS (SELECT conv_id, turn, doc_id, round(sum(1.0::DOUBLE / (59 + rank)), 12) AS score, min((node, rank)) AS first FROM asked a JOIN hits h ON a.q = h.q GROUP BY conv_id, turn, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, first) AS rank FROM fused)"""


@query("RUN-3", f"{_TREE}, {_RECURSIVE} SELECT conv_id, turn, rank::INTEGER AS rank, doc_id, {R('score')} AS score FROM placed WHERE rank <= 10")
def recursive_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Each leaf of a decomposition is searched, and the rankings of a root's leaves fused by reciprocal ranks (from 0)."""
    leaves = _trees(spark, d).where(F.coalesce("is_leaf", F.lit(True))).select(F.col("root").alias("query_id"), F.col("node").alias("variant"), _embedded().alias("q"))
    docs = B.table(spark, d, "documents").select("doc_id", _embedded().alias("v"))
    hits = _keyword_hits(docs, leaves, B.RESULT_K)
    out = fusion.reciprocal_rank_fusion(hits, 59.0, "doc_id")
    return out.select("query_id.conv_id", "query_id.turn", "rank", "doc_id", r6("score").alias("score"))


_ROUTED = f"""{B.TO_STATS}, {B.RERANKED}, {_ACTS}, cuts2 AS (SELECT quantile_cont(global_variance, 0.5) AS cut FROM spread),
final AS (SELECT m.query_id, a.action, a.global_variance, m.vec_id, m.rank AS scout_rank, CASE WHEN a.action = 'CHELATE' THEN m.new_rank ELSE m.rank END AS rank FROM masked m JOIN acts a ON m.query_id = a.query_id),
summary AS (SELECT query_id, any_value(action) AS action, any_value(global_variance) AS variance, count(*) FILTER (rank <= 10 AND scout_rank <= 10) / count(*) FILTER (rank <= 10 OR scout_rank <= 10)::DOUBLE AS jaccard, array_to_string(list(vec_id ORDER BY rank) FILTER (rank <= 10), ',') AS final_top, array_to_string(list(vec_id ORDER BY scout_rank) FILTER (scout_rank <= 10), ',') AS std_top, count(*) FILTER (scout_rank <= 10) AS results FROM final GROUP BY query_id),
routes AS (SELECT query_id, route, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, route) AS r FROM (SELECT q.query_id, c.query_id AS route, list_cosine_similarity(q.q, c.q) AS score FROM queries q CROSS JOIN centroids c)),
outcomes AS (SELECT route, avg(jaccard) AS effectiveness, count(*) AS outcomes FROM summary s JOIN routes r ON s.query_id = r.query_id AND r.r = 1 GROUP BY route)"""


@query("RUN-2-DIAGNOSTICS", sql(_ROUTED, f"SELECT s.query_id, 'ok' AS status, action, {R('variance', 9)} AS global_variance, {R('cut', 9)} AS active_threshold, variance > cut AS variance_above_threshold, {R('jaccard')} AS jaccard, results, std_top, final_top, r.route, {R('r.score')} AS route_score, {R('effectiveness')} AS route_effectiveness, outcomes AS route_outcomes, CASE WHEN action = 'CHELATE' THEN 'quantized_adaptive_rerank' ELSE 'quantized_fast_path' END AS policy, 50 AS scout_limit FROM summary s CROSS JOIN cuts2 JOIN routes r ON r.query_id = s.query_id AND r.r = 1 JOIN outcomes o ON o.route = r.route"))
def inference_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """The record of each query: action, variance and threshold, results before and after, its route and how that fares."""
    rows, hits = B.corpus(spark, d), B.scout(spark, d)
    stats = N.dimension_stats(hits)
    s = N.spread(stats)
    cut = F.broadcast(s.agg(F.percentile("global_variance", F.lit(0.5)).alias("cut")))
    actions = s.crossJoin(cut).withColumn("action", N.decision(F.col("global_variance"), F.col("cut"), True, False))
    final = N.rerank(hits, N.variance_mask(stats)).join(actions, "query_id").withColumn("place", F.when(F.col("action") == "CHELATE", F.col("new_rank")).otherwise(F.col("rank")))
    old, new = F.col("rank") <= 10, F.col("place") <= 10
    listed = lambda c, on: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.struct(F.col(c).alias("at"), "vec_id")))), lambda x: x["vec_id"].cast("string")), ",")
    summary = final.groupBy("query_id").agg(F.any_value("action").alias("action"), F.any_value("global_variance").alias("variance"), F.any_value("cut").alias("cut"), (F.count_if(old & new) / F.count_if(old | new)).alias("jaccard"), listed("place", new).alias("final_top"), listed("rank", old).alias("std_top"), F.count_if(old).alias("results"))
    asked = B.queries(rows).select(F.col("query_id").alias("vec_id"), F.col("query_label").alias("label"), F.col("q").alias("v"))
    routes = route_scores(asked, B.centroids(rows)).select(F.col("id").alias("query_id"), "route", F.col("score").alias("route_score"))
    routed = summary.join(routes, "query_id")
    fare = routed.groupBy("route").agg(F.avg("jaccard").alias("effectiveness"), F.count("*").alias("route_outcomes"))
    policy = F.when(F.col("action") == "CHELATE", "quantized_adaptive_rerank").otherwise("quantized_fast_path")
    return routed.join(fare, "route").select("query_id", F.lit("ok").alias("status"), "action", r6("variance", 9).alias("global_variance"), r6("cut", 9).alias("active_threshold"), (F.col("variance") > F.col("cut")).alias("variance_above_threshold"), r6("jaccard").alias("jaccard"), "results", "std_top", "final_top", "route", r6("route_score").alias("route_score"), r6("effectiveness").alias("route_effectiveness"), "route_outcomes", policy.alias("policy"), F.lit(B.SCOUT_K).alias("scout_limit"))
