"""The registered queries of this subpackage: one per operator over its whole table, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bbit, bytebpe, common, kneserney, linefreq, packing, tokencount, topk, toxicity, urlfilter, warc

OP3_MEMO_BYTES = 240 << 20
URL_RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(spark, common.read_table(spark, sf_dir, "pages"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.judged(common.read_table(spark, sf_dir, "documents")).drop("host", "text_hash", "removed")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), memo_bytes=OP3_MEMO_BYTES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.id_remainder(F.col("doc_id"), 3) == 1
    lexicon = toxicity.fit(docs.where(~held_out), common.read_table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.scored(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The listing of the query: canonical URLs under which some page came from a feed (``utm_source=feed``)."""
    host, path = urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url"))
    return pages.where(F.col("url").contains("utm_source=feed")).select(urlfilter.canonical(host, path).alias("url"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, listed_urls(pages), URL_RULES)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read_table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = common.id_remainder(F.col("doc_id"), 7) == 2
    model = kneserney.train(docs.where(~held_out), order=3)
    return kneserney.score(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit.near_duplicates(common.read_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip_digests(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_line_frequency": op2_line_frequency,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_url_filter": op6_url_filter,
    "op7_top_k": op7_top_k,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_byte_bpe": op10_byte_bpe,
    "pipeline": pipeline,
}

_OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), newest AS (
  SELECT payload, max(page_id) AS newest FROM p GROUP BY payload
), digits AS (
  SELECT p.page_id, octet_length(encode(p.payload)) AS payload_bytes, newest.newest,
         translate(upper(string_agg(lpad(to_base(('0x' || substr(p.hex, k * 10 + 1, 10))::BIGINT, 32), 8, '0'), '' ORDER BY k)),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p JOIN newest ON p.payload = newest.payload CROSS JOIN range(4) AS r(k)
  GROUP BY p.page_id, p.payload, newest.newest
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM digits
"""

_OP2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS pos FROM d WHERE len(words) >= 8
), keyed AS (
  SELECT doc_id, pos, array_to_string(words[pos : pos + 7], ' ') AS gram FROM windows
), repeated AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again FROM keyed
), positions AS (
  SELECT DISTINCT doc_id, pos + unnest(range(8)) AS place FROM repeated WHERE again
), repeats AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM positions GROUP BY doc_id
), raw_lines AS (
  SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT doc_id, host, text, line,
         regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS line_words
  FROM raw_lines
), worded AS (
  SELECT doc_id, host, text, line, array_to_string(line_words, ' ') AS norm, len(line_words) AS words FROM lines WHERE len(line_words) > 0
), duplicates AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id
), document_lines AS (
  SELECT doc_id, host, norm, sum(words) AS words FROM worded GROUP BY doc_id, host, norm
), frequent AS (
  SELECT host, norm FROM document_lines GROUP BY host, norm HAVING count(DISTINCT doc_id) > 20
), removed AS (
  SELECT l.doc_id, sum(l.words) AS removed_words
  FROM document_lines l JOIN frequent f ON l.host = f.host AND l.norm = f.norm
  GROUP BY l.doc_id
), stats AS (
  SELECT d.doc_id, len(d.words)::BIGINT AS n_words, length(array_to_string(d.words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(u.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(m.removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN duplicates u ON d.doc_id = u.doc_id LEFT JOIN repeats r ON d.doc_id = r.doc_id
         LEFT JOIN removed m ON d.doc_id = m.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, removed_words,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= 20
         AND removed_words <= 0.8::DOUBLE * n_words AS kept
FROM stats
"""

_OP6 = r"""
WITH u AS (
  SELECT page_id, url, strpos(url, '://') AS pos FROM pages
), split AS (
  SELECT page_id, url,
         CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM u
), named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':\d*$', ''), '^(www|m)\.', '')
                 || regexp_replace(regexp_replace(path, '(\.html?|/index\.html?)$', ''), '/+$', '') END AS canonical
  FROM split
), listed AS (
  SELECT DISTINCT canonical FROM named WHERE contains(url, 'utm_source=feed') AND canonical IS NOT NULL
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM named
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_OP7 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ') || chr(10)] ELSE []::VARCHAR[] END) AS g
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT least.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, least.doc_id = component_id AS kept
FROM least LEFT JOIN n ON n.doc_id = least.doc_id
"""

ORACLE_SQL = {"op1_warc": _OP1, "op2_line_frequency": _OP2, "op6_url_filter": _OP6, "op7_top_k": _OP7, "op9_near_duplicates": _OP9}
