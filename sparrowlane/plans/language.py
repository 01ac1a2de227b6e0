"""Queries: text functions over documents, benchmark items and conversations, in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import graph as G
from ..operators.topk import ranked
from ..registry import query
from . import base as B
from .base import r6
from .base import r6_sql as R

_TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9_+-]+')"
_STOP = "['the', 'a', 'an', 'of', 'to', 'and', 'or', 'for', 'in']"
_NEG = "['no', 'not', 'without', 'lack', 'lacks', 'never']"
_CUES = "['increase', 'increased', 'decrease', 'decreased', 'risk', 'treat', 'treats', 'used', 'associated', 'affect', 'facilitates']"
_FEATURES = f"""t AS (SELECT doc_id, text, {_TOKENS.format('text')} AS w FROM documents),
features AS (SELECT doc_id, len(w)::BIGINT AS token_count, length(text)::BIGINT AS char_count,
 CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains({_STOP}, x))) / len(w)::DOUBLE ELSE 0.0::DOUBLE END AS stopword_ratio,
 len(list_filter(w, lambda x: regexp_matches(x, '[0-9]')))::BIGINT AS numeric_token_count, len(list_filter(w, lambda x: list_contains({_NEG}, x)))::BIGINT AS negation_count,
 len(list_filter(w, lambda x: list_contains({_CUES}, x)))::BIGINT AS claim_cue_count FROM t)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", "text")


@query("STR-1", f"""WITH t AS (SELECT item_id, trim(text) AS original, list_filter({_TOKENS.format('text')}, lambda x: NOT list_contains({_STOP}, x)) AS k FROM benchmark),
 v AS (SELECT item_id, original, array_to_string(k, ' ') AS plain, array_to_string(k[1:2], ' ') AS focused, len(k) AS n FROM t)
 SELECT item_id, unnest(list_filter([{{'place': 0, 'strategy': 'original', 'text': original}},
   CASE WHEN n > 0 AND lower(original) <> plain THEN {{'place': 1, 'strategy': 'stopword_removed', 'text': plain}} END,
   CASE WHEN n > 2 AND lower(original) <> focused THEN {{'place': 2, 'strategy': 'focused_prefix', 'text': focused}} END], lambda x: x IS NOT NULL), recursive := true) FROM v""".replace("'place': 0, ", "").replace("'place': 1, ", "").replace("'place': 2, ", ""))
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "benchmark").select("item_id", F.explode(T.variants(F.col("text"))).alias("v"))
    return rows.select("item_id", "v.strategy", "v.text")


@query("STR-2", f"WITH {_FEATURES} SELECT doc_id, token_count, char_count, {R('stopword_ratio')} AS stopword_ratio, numeric_token_count, negation_count, claim_cue_count FROM features")
def lexical_features(spark: SparkSession, d: str) -> DataFrame:
    f = T.lexical_features(F.col("text"))
    f["stopword_ratio"] = r6(f["stopword_ratio"])
    return _docs(spark, d).select("doc_id", *(c.alias(n) for n, c in f.items()))


@query("STR-3", f"""WITH {_FEATURES} SELECT doc_id, token_count > 0 AND (token_count <= 6 OR stopword_ratio >= 0.35) AS low_specificity,
 token_count >= 8 AND stopword_ratio <= 0.25 AS high_specificity, claim_cue_count > 0 OR negation_count > 0 OR numeric_token_count > 0 AS claim_cue, true AS always, false AS never FROM features""")
def policies(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", *(c.alias(n) for n, c in T.lexical_features(F.col("text")).items()))
    f = {c: F.col(c) for c in rows.columns}
    names = {"low_specificity": "selective_low_specificity", "high_specificity": "selective_high_specificity", "claim_cue": "selective_claim_cue", "always": "always", "never": "never"}
    return rows.select("doc_id", *(T.applies(f, p).alias(n) for n, p in names.items()))


def _split_sql(t: str) -> str:
    out = f"[{t}]"
    for word in reversed(T.CONJUNCTIONS):
        at = f"strpos(lower({t}), '{word}')"
        left, right = f"trim(substr({t}, 1, {at} - 1))", f"trim(substr({t}, {at} + {len(word)}))"
        out = f"CASE WHEN {at} > 0 AND {left} <> '' AND {right} <> '' THEN [{left}, {right}] ELSE {out} END"
    return out


def _atomic_sql(t: str) -> str:
    return f"(length({t}) < 20 OR NOT (" + " OR ".join(f"strpos(lower({t}), '{w}') > 0" for w in T.CONJUNCTIONS) + "))"


@query("STR-4", f"SELECT conv_id, turn, {_atomic_sql('text')} AS atomic, len(p)::INTEGER AS parts, p[1] AS first_part FROM (SELECT conv_id, turn, text, {_split_sql('text')} AS p FROM conversations)")
def conjunction_split(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "conversations").select("conv_id", "turn", T.is_atomic(F.col("text")).alias("atomic"), T.split_conjunction(F.col("text")).alias("p"))
    return rows.select("conv_id", "turn", "atomic", F.size("p").alias("parts"), F.element_at("p", 1).alias("first_part"))


@query("STR-5", f"""WITH s AS (SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), '\\s+', ' ', 'g')), 1, 2000) AS q FROM conversations),
 p AS (SELECT conv_id, turn, q, {_split_sql('q')} AS parts FROM s), u AS (SELECT conv_id, turn, q, unnest(parts) AS part FROM p),
 o AS (SELECT *, regexp_extract_all(lower(part), '[a-z0-9]+') AS own, regexp_extract_all(lower(q), '[a-z0-9]+') AS have FROM u)
 SELECT conv_id, turn, part, {R('CASE WHEN len(own) > 0 THEN len(list_filter(own, lambda x: list_contains(have, x))) / len(own)::DOUBLE ELSE 0 END')} AS overlap FROM o""")
def sanitized_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "conversations").select("conv_id", "turn", T.sanitized(F.col("text")).alias("q"))
    rows = rows.select("conv_id", "turn", "q", F.explode(T.split_conjunction(F.col("q"))).alias("part"))
    return rows.select("conv_id", "turn", "part", r6(T.overlap(F.col("q"), F.col("part"))).alias("overlap"))


@query("STR-6", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^[0-9]+[.)]\s*', ''), '^[-*]\s*', ''))), lambda x: x <> '') AS items FROM documents)
 SELECT doc_id, CASE WHEN len(items) > 0 THEN len(items) ELSE 1 END::INTEGER AS items FROM l""")
def parsed_lists(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(T.list_items(F.col("text"))).alias("items"))


_LATIN = r"length(regexp_replace(text, '[^A-Za-z\x{00C0}-\x{024F}]', '', 'g'))"


@query("STR-7", f"SELECT doc_id, 'en' AS language, {R(f'CASE WHEN {_LATIN} > 0 THEN 0.6 ELSE 0 END')} AS confidence FROM documents")
def detected_languages(spark: SparkSession, d: str) -> DataFrame:
    """All texts of the tables are Latin; the other scripts are tested on literal rows."""
    found = _docs(spark, d).select("doc_id", T.language_and_confidence(F.col("text")).alias("found"))
    return found.select("doc_id", "found.language", r6("found.confidence").alias("confidence"))


@query("AGG-27", "SELECT 'en' AS language, count(*) AS n FROM documents")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy(T.detected_language(F.col("text"))[0].alias("language")).agg(F.count("*").alias("n"))


@query("JOIN-10", "SELECT lang, CASE lang WHEN 'en' THEN 'minilm' WHEN 'de' THEN 'gbert' WHEN 'fr' THEN 'camembert' ELSE 'multilingual' END AS teacher, CASE lang WHEN 'en' THEN 384 WHEN 'de' THEN 768 WHEN 'fr' THEN 768 ELSE 512 END AS dim, count(*) AS n FROM documents GROUP BY ALL")
def teachers_of_languages(spark: SparkSession, d: str) -> DataFrame:
    teachers = spark.createDataFrame([("en", "minilm", 384), ("de", "gbert", 768), ("fr", "camembert", 768)], "lang string, teacher string, dim int")
    rows = B.table(spark, d, "documents").join(F.broadcast(teachers), "lang", "left")
    return rows.groupBy("lang", F.coalesce("teacher", F.lit("multilingual")).alias("teacher"), F.coalesce("dim", F.lit(512)).alias("dim")).agg(F.count("*").alias("n"))


_WORD_LIST = r"list_filter(list_transform(regexp_split_to_array(translate(lower(text), '-_', '  '), '\s+'), lambda t: regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')), lambda t: length(t) >= 4)"


@query("STR-8", f"""WITH k AS (SELECT doc_id, {_WORD_LIST} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM k),
 f AS (SELECT doc_id, t, min(i) AS i FROM u GROUP BY doc_id, t), g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f) WHERE n <= 5 GROUP BY doc_id)
 SELECT d.doc_id, coalesce(terms, 'retrieval') AS terms FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""")
def keyword_terms(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(T.keyword_terms(F.col("text")), " ").alias("terms"))


@query("STR-9", "SELECT doc_id, substr(sha256(text), 1, 12) AS short_hash, substr(sha256(text), 1, 16) AS long_hash FROM documents")
def stable_hashes(spark: SparkSession, d: str) -> DataFrame:
    h = F.sha2("text", 256)
    return _docs(spark, d).select("doc_id", F.substring(h, 1, 12).alias("short_hash"), F.substring(h, 1, 16).alias("long_hash"))


@query("STR-10", "SELECT page_id, substr(trim(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '-'), 1, 64) AS label FROM pages")
def run_labels(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "pages").select("page_id", T.run_label(F.col("url")).alias("label"))


@query("STR-11", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS context FROM conversations")
def contexts(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("context"))


@query("PRJ-1", "SELECT doc_id::VARCHAR AS canonical_id FROM documents")
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.col("doc_id").cast("string").alias("canonical_id"))


@query("PRJ-2", "SELECT l.doc_id, coalesce(nullif(d.source, ''), nullif(d.lang, ''), l.doc_id::VARCHAR) AS source_id FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def mapped_ids(spark: SparkSession, d: str) -> DataFrame:
    """The first id that is not empty, else the internal one; unknown ids stay."""
    rows = B.table(spark, d, "labels").select("doc_id").join(B.table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id", "left")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select("doc_id", F.coalesce(filled("source"), filled("lang"), F.col("doc_id").cast("string")).alias("source_id"))


@query("PRJ-3", "SELECT doc_id, n_chars FROM documents")
def pruned_payload(spark: SparkSession, d: str) -> DataFrame:
    """Texts are not read."""
    return B.table(spark, d, "documents").select("doc_id", "n_chars")


@query("PRJ-4", r"SELECT doc_id, length(regexp_replace(substr(text, 1, 10000), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]', ' ', 'g'))::INTEGER AS kept, sha256(regexp_replace(substr(text, 1, 10000), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]', ' ', 'g')) AS hash FROM documents")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts as an embedder takes them: 10,000 characters at most, control characters as spaces (the cap is the operator)."""
    clean = F.regexp_replace(F.substring("text", 1, 10000), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", " ")
    return _docs(spark, d).select("doc_id", F.length(clean).alias("kept"), F.sha2(clean, 256).alias("hash"))


@query("PRJ-5", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), '[\x00-\x08\x0B-\x1F\x7F-\x9F]', '', 'g'), '\s+', ' ', 'g')) AS snippet FROM documents")
def log_snippets(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.log_snippet(F.col("text")).alias("snippet"))


@query("PRJ-9", r"SELECT conv_id, turn, substr(sha256(text), 1, 16) AS query_hash, length(text)::INTEGER AS chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS tokens FROM conversations")
def query_summary(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return B.table(spark, d, "conversations").select("conv_id", "turn", F.substring(F.sha2("text", 256), 1, 16).alias("query_hash"), F.length("text").alias("chars"), F.size(words).alias("tokens"))


@query("PRJ-10", "SELECT doc_id, '{\"quality\":' || quality || ',\"toxic\":' || toxic || '}' AS json FROM labels")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "labels").select("doc_id", F.to_json(F.struct("quality", "toxic")).alias("json"))


@query("PRJ-14", r"SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) IN ('localhost', '127.0.0.1') AS local_host, contains(url, '..') AS traversal, regexp_matches(url, '^https?://[A-Za-z0-9._-]+') AS allowed FROM pages")
def url_validation(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, "://([^/?#]*)", 1))
    return B.table(spark, d, "pages").select("page_id", host.isin("localhost", "127.0.0.1").alias("local_host"), url.contains("..").alias("traversal"), url.rlike("^https?://[A-Za-z0-9._-]+").alias("allowed"))


_FAMILIES = [(["the", "of", "and"], [1.0, 0.35, 0.05, 0.05]), (["de", "la", "el"], [0.05, 1.0, 0.35, 0.05]), (["der", "die", "und"], [0.05, 0.05, 1.0, 0.35])]
_START = [0.05, 0.05, 0.05, 0.05]


def _family_sql() -> str:
    parts = []
    for i in range(4):
        terms = [f"{_START[i]}::DOUBLE"] + [f"CASE WHEN list_has_any(w, {keys}) THEN {vector[i]}::DOUBLE ELSE 0.0::DOUBLE END" for keys, vector in _FAMILIES]
        parts.append(" + ".join(terms))
    return "[" + ", ".join(parts) + "]"


@query("SRC-16", rf"WITH w AS (SELECT doc_id, regexp_split_to_array(translate(lower(text), '-', ' '), '\s+') AS w FROM documents), e AS (SELECT doc_id, {_family_sql()} AS v FROM w) SELECT doc_id, {', '.join(f'{R(f'v[{i}] / sqrt(list_inner_product(v, v))')} AS x{i}' for i in range(1, 5))} FROM e")
def keyword_embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", V.unit(T.keyword_embedding(F.col("text"), _FAMILIES, _START)).alias("v"))
    return rows.select("doc_id", *(r6(F.element_at("v", i)).alias(f"x{i}") for i in range(1, 5)))


_TREE = f"""WITH RECURSIVE tree AS (
  SELECT conv_id, turn, '0' AS node, 0 AS depth, text FROM conversations
  UNION ALL
  SELECT conv_id, turn, node || '.' || k, depth + 1, {_split_sql('text')}[k] FROM tree, (VALUES (1), (2)) AS h(k)
  WHERE depth < 3 AND NOT {_atomic_sql('text')} AND len({_split_sql('text')}) > 1)
"""


def _trees(spark: SparkSession, d: str) -> DataFrame:
    rows = B.table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("root"), "text")
    return G.decomposition_tree(rows, "root", "text")


@query("GRAPH-6", _TREE + "SELECT conv_id, turn, node, depth, text FROM tree")
def decomposition(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d).select("root.conv_id", "root.turn", "node", "depth", "text")


@query("RUN-3-TREE", _TREE + f", leaves AS (SELECT *, depth = 3 OR {_atomic_sql('text')} OR len({_split_sql('text')}) < 2 AS leaf FROM tree) SELECT conv_id, turn, count(*) AS nodes, count(*) FILTER (leaf) AS leaves, max(depth)::INTEGER AS deepest FROM leaves GROUP BY conv_id, turn")
def decomposition_summary(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d).groupBy("root.conv_id", "root.turn").agg(F.count("*").alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.max("depth").alias("deepest"))


@query("SET-8", "SELECT item_id, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY item_id) AS r FROM benchmark) WHERE r = 1")
def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ranked(B.table(spark, d, "benchmark").withColumn("low", F.lower("text")), 1, ["low"], "item_id").select("item_id", "text")



@query("MATH-6", f"SELECT item_id, {R('length(text) / (1 + item_id % 4)::DOUBLE')} AS score FROM benchmark")
def impact_effort(spark: SparkSession, d: str) -> DataFrame:
    return B.table(spark, d, "benchmark").select("item_id", r6(F.length("text") / (1 + F.col("item_id") % 4)).alias("score"))
