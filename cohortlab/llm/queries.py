"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import (decontaminate, html_text, license_scan, mask_search, packing, quality, secret_scan,
                            token_align, token_orc, url_filter, vector_search)
from cohortlab.llm.common import table
from cohortlab.llm.encoding import ALONE_BYTES
from cohortlab.llm.exact_dedup import exact_duplicates
from cohortlab.llm.near_dup import near_duplicates

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table_bytes=ALONE_BYTES)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"))


def op12_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


for _f in (op1_quality, op2_near_dup, op3_url_filter, op4_html_text, op5_token_orc, op6_secret_scan,
           op7_decontaminate, op8_packing, op9_license_scan, op10_exact_dedup, op11_token_align,
           op12_mask_search, op13_vector_search):
    REGISTRY[_f.__name__] = _f

_SPACE = r"[\x20\x09-\x0D]+"

ORACLE["op2_near_dup"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '{_SPACE}'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (
  SELECT DISTINCT doc_id, doc_id AS r FROM w
  UNION
  SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.doc_id),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id,
       w.doc_id = comp.component_id AS kept
FROM w JOIN comp ON comp.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""

ORACLE["op10_exact_dedup"] = rf"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS norm
  FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t"""

ORACLE["op3_url_filter"] = url_filter.oracle_sql()
ORACLE["op9_license_scan"] = license_scan.oracle_sql()
ORACLE["op12_mask_search"] = mask_search.oracle_sql()
ORACLE["op13_vector_search"] = vector_search.oracle_sql()
