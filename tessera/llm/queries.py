"""The registered queries of the pipeline operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, covertree, decontaminate, langid, negatives, pii, planes, simhash, substrings, suffixes, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"), length=400)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(table(spark, sf_dir, "documents"), window=13)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"), modulus=4, rest=2)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3, seed=42)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=3, rest=1, threshold=0.7)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.captures(table(spark, sf_dir, "pages"), again=7))
    names = F.array_sort(F.map_keys("headers"))
    lines = F.transform(names, lambda k: F.concat(k, F.lit(": "), F.element_at("headers", k)))
    return found.select("record_id", "canonical_url", "captured_at", "ref_id", "ref_at", "outcome", F.sha2(F.array_join(lines, "\n"), 256).alias("headers_sha256"), "digest")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    kinds = F.transform(base, lambda s: s.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k_positive=5, k_negative=5, share=80, scale=256, label=moved)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_suffixes": op3_suffixes,
    "op4_substrings": op4_substrings,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_personal_data": op11_personal_data,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

OP1_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

OP4_SQL = r"""
WITH norm AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), seats AS (
  SELECT rid, doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM norm WHERE len(w) >= 13)
), least AS (SELECT h, min(doc_id) AS d FROM seats GROUP BY h
), gone AS (
  SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM seats JOIN least USING (h) WHERE doc_id > d) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ps, k)) END, ' ')) AS kept_sha256
FROM norm LEFT JOIN gone USING (rid)
"""

OP5_SQL = r"""
WITH norm AS (
  SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') FROM benchmark
), grams AS (
  SELECT DISTINCT id AS item_id, w[i : i + 9] AS gram FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM norm WHERE kind = 'b' AND len(w) > 0 AND id IS NOT NULL)
), sizes AS (SELECT DISTINCT len(gram) AS k FROM grams
), seats AS (
  SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM norm, sizes WHERE kind = 'd' AND len(w) >= k
), met AS (
  SELECT rid, i, k, item_id FROM (SELECT rid, i, k, w[i : i + k - 1] AS gram FROM seats) JOIN grams USING (gram)
), pos AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM met) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS list FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS t FROM met) GROUP BY rid
)
SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm d LEFT JOIN pos USING (rid) LEFT JOIN items USING (rid) WHERE d.kind = 'd'
"""

OP10_SQL = r"""
WITH bare AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages
), parts AS (
  SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(?:80|443)$', ''), '^www\d*\.', '') AS host,
         regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(u, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:utm_[a-z]+|gclid|fbclid|sessionid|jsessionid|phpsessid|sid|ref)(?:=|$)'))) AS q
  FROM bare
), pg AS (
  SELECT page_id, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS curl, sha256(html) AS sha, octet_length(encode(html)) AS n FROM parts
), revisit AS (
  SELECT 2 * page_id + 1 AS record_id, curl, page_id + 7 AS cap, '"' || substr(sha, 1, 16) || '"' AS tag FROM pg
), ref AS (
  SELECT r.record_id, max((p.page_id, 2 * p.page_id)) AS best FROM revisit r JOIN pg p ON p.curl = r.curl AND (p.page_id < r.cap OR (p.page_id = r.cap AND 2 * p.page_id < r.record_id)) GROUP BY r.record_id
), full_ref AS (
  SELECT r.*, p.page_id AS ref_at, 2 * p.page_id AS ref_id, p.sha, p.n FROM revisit r LEFT JOIN ref USING (record_id) LEFT JOIN pg p ON p.page_id = struct_extract(best, 1)
)
SELECT CAST(record_id AS BIGINT) AS record_id, curl AS canonical_url, CAST(cap AS BIGINT) AS captured_at, CAST(ref_id AS BIGINT) AS ref_id, CAST(ref_at AS BIGINT) AS ref_at,
       CASE WHEN ref_at IS NULL THEN 'no_response' WHEN substr(sha, 1, 16) = substr(tag, 2, 16) THEN 'resolved' ELSE 'mismatch' END AS outcome,
       sha256(CASE WHEN ref_at IS NOT NULL AND substr(sha, 1, 16) = substr(tag, 2, 16)
              THEN 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || cap || chr(10) || 'etag: W/' || tag
              ELSE 'content-length: 0' || chr(10) || 'date: ' || cap || chr(10) || 'etag: W/' || tag END) AS headers_sha256,
       CASE WHEN ref_at IS NOT NULL AND substr(sha, 1, 16) = substr(tag, 2, 16) THEN sha END AS digest
FROM full_ref
"""

OP11_SQL = r"""
WITH kinds(k, kind, pat, base) AS (VALUES
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', true), (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', true),
  (3, 'card', '[0-9](?:[\x20-]?[0-9])+', true), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]', true),
  (5, 'iban', '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b', false), (6, 'social', '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', false),
  (7, 'local_phone', '\b[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}\b', false)
), norm AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT rid, k, t, regexp_extract_all(t, pat, 0) AS m, list_transform(string_split_regex(t, pat), lambda x: length(x)) AS gap FROM norm, kinds
), met AS (
  SELECT rid, k, t, m[i] AS s, CAST(list_sum(gap[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut WHERE len(m) > 0)
), accounts AS (
  SELECT rid, k, t, a, list_filter(list_transform(range(len(string_split(s, ' ')), 0, -1), lambda n: array_to_string(string_split(s, ' ')[1:n], ' ')),
    lambda c: length(replace(c, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(substr(replace(c, ' ', ''), 5) || substr(replace(c, ' ', ''), 1, 4), ''),
      lambda d: CASE WHEN d BETWEEN '0' AND '9' THEN d ELSE CAST(ascii(d) - 55 AS VARCHAR) END), ''), ''), lambda d: CAST(d AS INTEGER))), lambda x, y: (x * 10 + y) % 97) = 1)[1] AS s
  FROM met WHERE k = 5
), digits AS (SELECT *, list_reverse(list_transform(string_split(regexp_replace(s, '[^0-9]', '', 'g'), ''), lambda d: try_cast(d AS INTEGER))) AS d FROM met WHERE k <> 5
), valid AS (
  SELECT rid, k, t, s, a, a + length(s) AS b FROM digits
  WHERE CASE k WHEN 2 THEN len(list_filter(string_split(s, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0
    WHEN 3 THEN len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(d, lambda v, i: CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END)) % 10 = 0
    WHEN 4 THEN len(d) BETWEEN 9 AND 15
    WHEN 6 THEN substr(s, 1, 3) NOT IN ('000', '666') AND substr(s, 1, 3) < '900' AND substr(s, 5, 2) <> '00' AND substr(s, 8) <> '0000' ELSE true END
  UNION ALL SELECT rid, k, t, s, a, a + length(s) FROM accounts WHERE s IS NOT NULL
), near AS (
  SELECT *, translate(substr(t, CAST(greatest(1, a - 39) AS BIGINT), CAST(least(40, a) AS BIGINT)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l, translate(substr(t, CAST(b + 1 AS BIGINT), 20), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM valid WHERE k >= 6
), words(k, pro, con) AS (VALUES (6, '\b(?:ssn|social|security|taxpayer)\b', '\b(?:order|invoice|part)\b'), (7, '\b(?:tel|telephone|phone|mobile|call|fax|whatsapp)\b', '\b(?:order|invoice|isbn)\b')
), further AS (
  SELECT rid, k, a, b FROM near JOIN words USING (k) WHERE (regexp_matches(l, pro) OR regexp_matches(r, pro)) AND NOT (regexp_matches(l, con) OR regexp_matches(r, con))
  UNION ALL SELECT rid, k, a, b FROM valid WHERE k = 5
), kept AS (
  SELECT rid, k, a, b FROM valid WHERE k <= 4
  UNION ALL SELECT f.rid, f.k, f.a, f.b FROM further f WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.k <= 4 AND v.rid = f.rid AND v.a < f.b AND f.a < v.b)
), lists AS (
  SELECT rid, count(*) FILTER (k = 1) AS n_email, count(*) FILTER (k = 2) AS n_ip, count(*) FILTER (k = 3) AS n_card, count(*) FILTER (k = 4) AS n_phone,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k <= 4) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans
  FROM kept JOIN kinds USING (k) GROUP BY rid
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM norm LEFT JOIN lists USING (rid)
"""

OP12_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.rid AS aid, a.vec_id AS anchor_id, c.rid, c.vec_id, c.label = a.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON c.rid <> a.rid WHERE a.vec_id % 100 = 0
), pos AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id) AS k FROM scored WHERE same AND vec_id <> anchor_id) WHERE k <= 5
), met AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.aid, p.rid ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos p JOIN scored s ON s.aid = p.aid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op11_personal_data": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op1_top_k": OP1_SQL, "op4_substrings": OP4_SQL, "op5_decontaminate": OP5_SQL, "op10_warc_revisits": OP10_SQL}
