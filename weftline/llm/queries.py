"""Queries of the corpus operators, with production parameters over whole tables, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import contamination
from .html_text import extract_main_text
from .language import language_of_documents
from .licence import licence_scan
from .mixing import temperature_mix
from .paragraphs import repeated_spans
from .pii import personal_data
from .quality import quality_verdicts
from .sharding import extendible_shards
from .simhash import simhash_near_duplicates


def op1_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temperature_mix(table(spark, sf_dir, "documents"), max_repetition=2.0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), confidence=0.8, seeds=5, turns=8)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(table(spark, sf_dir, "documents"), texts_per_lang=2000, grams_per_lang=4000)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), similarity=0.8, least=30).drop("row")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), sample_rows=2000)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"), limit=64 << 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL by query; hashes other than md5, components, models and parsers have none."""
    return dict(SQL)


SQL: dict[str, str] = {}

#: The first 24 bits of a doc_id's hash are enough here: ids are unique, and no bucket of the table is that deep.
SQL["op10_sharding"] = f"""
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, lpad(bin(('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT), 32, '0') AS bits
  FROM documents),
buckets AS (
  SELECT depth, bits[1:depth] AS prefix, sum(n_bytes) AS shard_bytes
  FROM sized, generate_series(0, 24) AS s(depth) GROUP BY ALL HAVING sum(n_bytes) <= {64 << 20}),
least AS (
  SELECT s.doc_id, s.n_bytes, s.bits, min(b.depth) AS depth
  FROM sized s JOIN buckets b ON s.bits[1:b.depth] = b.prefix GROUP BY ALL)
SELECT l.doc_id, l.n_bytes, 'b' || b.prefix AS shard, b.depth::INTEGER AS depth, b.shard_bytes::BIGINT AS shard_bytes
FROM least l JOIN buckets b ON b.depth = l.depth AND b.prefix = l.bits[1:l.depth]
"""

_WHITE = r"[^\x20\x09-\x0D]+"

SQL["op9_quality"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '{_WHITE}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WHITE}')) AS ls FROM docs),
windows AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS v FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM words)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + o) AS n FROM twice, range(5) AS r(o) GROUP BY rid),
signals AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters
  FROM words LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_upper > n_letters OR word_chars > 100 * n_words) AS kept
FROM signals
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op7_decontaminate"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark),
phrases AS (
  SELECT item, least(len(ws), 10) AS n, array_to_string(ws[i:i+9], ' ') AS v
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
places AS (
  SELECT rid, i, n, array_to_string(ws[i:i+n-1], ' ') AS v
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM phrases))),
hits AS (SELECT DISTINCT rid, i, n, item FROM places JOIN phrases USING (n, v)),
words AS (SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(w.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, w.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN words w USING (rid) LEFT JOIN found f USING (rid)
"""
