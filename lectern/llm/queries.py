"""The thin digest queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    bpe,
    decontamination,
    html_extract,
    lm_mixing,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    token_counts,
    warc,
)
from lectern.llm._common import scratch_path, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    wanted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"]
    return quality_rules.judge(docs, rules).select(*wanted)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "archives")
    warc.write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.read_archives(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op7_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score_documents(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_bpe,
        op3_sharding,
        op4_token_counts,
        op5_simhash,
        op6_warc,
        op7_lm_mixing,
        op8_html_text,
        op9_secret_scan,
        op10_decontamination,
    )
}


def _span_sql(kind: str, rank: int, pattern: str, fits: str) -> str:
    quoted = pattern.replace("'", "''")
    size = "lambda x: length(x)"
    return f"""SELECT doc_id, source, '{kind}' AS kind, {rank} AS r, s, s + length(v) AS e, v FROM (
  SELECT doc_id, source, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i:
    CAST(list_sum(list_transform(p[1:i], {size})) + coalesce(list_sum(list_transform(m[1:i - 1], {size})), 0) AS BIGINT))) AS s
  FROM (SELECT doc_id, source, string_split_regex(text, '{quoted}') AS p, regexp_extract_all(text, '{quoted}') AS m
    FROM documents WHERE regexp_matches(text, '{quoted}'))) WHERE {fits}"""


_ASSIGN_SQL = secret_scan.ASSIGN.replace("'", "''")
_FIVES_OF_SHA1 = "list_transform(range(1, 41, 5), lambda i: CAST('0x' || substring(h, i, 5) AS INTEGER))"

#: Where DuckDB can express the query. The others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, array_to_string(list_transform({_FIVES_OF_SHA1}, lambda n:
    array_to_string(list_transform([15, 10, 5, 0], lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> k) % 32 + 1, 1)), '')), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS f FROM d)
""",
    # These pages mark their article; all else in it is paragraphs, headings, bold text and line breaks.
    "op8_html_text": r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM b
""",
    "op9_secret_scan": f"""
WITH base AS (
{_span_sql("assign", 0, secret_scan.ASSIGN, f"length(regexp_extract(v, '{_ASSIGN_SQL}', 2)) >= 6")}
UNION ALL {_span_sql("access", 1, secret_scan.ACCESS, "true")}
UNION ALL {_span_sql("hex", 2, secret_scan.HEX, "true")}
), wide AS (
  SELECT * FROM ({_span_sql("live", 3, secret_scan.WIDE, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")}) w
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s <= w.s AND w.e <= b.e)
), cand AS (
  SELECT *, CASE WHEN kind = 'assign' THEN regexp_extract(v, '{_ASSIGN_SQL}', 2) ELSE v END AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM wide)
), held AS (SELECT x, count(DISTINCT coalesce(source, '')) <= 1 AND count(DISTINCT doc_id) <= 8 AS alive FROM cand GROUP BY x),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (kind <> 'live') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, r) FILTER (kind <> 'live' OR alive) AS spans,
    count(*) FILTER (alive) AS n_live, count(*) FILTER (NOT alive) AS n_example
  FROM cand JOIN held USING (x) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN told USING (doc_id)
""",
    # Words lose ASCII punctuation; an item with fewer than five words is one shingle.
    "op10_decontamination": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', ' ', 'g'), '[ \t-\r]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), item_shingles AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS n,
    unnest(list_transform(range(1, CAST(len(w) - least(5, len(w)) + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s
  FROM items WHERE len(w) > 0
), doc_shingles AS (
  SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, CAST(len(w) - n + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
  FROM words, (SELECT DISTINCT n FROM item_shingles) WHERE len(w) >= n
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM item_shingles JOIN doc_shingles USING (n, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, n_shingles, CAST(shared AS DOUBLE) / n_shingles AS containment
FROM hits JOIN sizes USING (item_id) WHERE shared >= 0.8 * n_shingles - 1e-9
""",
}
