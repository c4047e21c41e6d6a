"""Queries op1 to op10, each over a whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import exact_dedup, language, licenses, packing, quality, secrets, sentencepiece_viterbi, simhash, url_rules, warc

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents", "doc_id", "text"), f"{TOKENIZERS}/word_bpe_49k.json")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode_documents(_read(spark, sf_dir, "documents", "doc_id", "text"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op6_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")).drop("key")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_read(spark, sf_dir, "pages", "page_id", "url"))


def op10_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_predictions(_read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_vector_packing, op2_exact_dedup, op3_warc_transactions, op4_sentencepiece, op5_secret_ownership, op6_simhash_covering, op7_license_diagonals, op8_quality_outliers, op9_url_rules, op10_language_profiles)}


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


LETTERS = " || ".join(f"substr('{warc.BASE32}', ((h[{k + 1}] >> {s}) & 31)::INTEGER + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS keep FROM p),
x AS (SELECT *, [{", ".join(f"('0x' || substr(sha, {5 * k + 1}, 5))::BIGINT" for k in range(8))}] AS h FROM d)
SELECT page_id, payload_bytes, {LETTERS} AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != keep THEN keep END AS refers_to, true AS complete FROM x
"""


def _op9_sql() -> str:
    """Every rule against every url, without an index."""
    prefix = ", ".join(f"('{a}', '{h}', '{p}', '{h}{p}')" for a, h, p in url_rules.PREFIX_RULES)
    hits = {k: " OR ".join(f"regexp_matches(low, '{url_rules.compile_pattern(p.text)}')" for p in url_rules.PATTERNS if p.action == k) for k in ("allow", "block")}
    return rf"""
WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
r AS (SELECT * FROM (VALUES {prefix}) t(action, suffix, start, rule)),
b AS (SELECT page_id, first(r.rule ORDER BY length(r.rule) DESC) AS rule, first(action ORDER BY length(r.rule) DESC) AS action FROM u JOIN r ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, start) GROUP BY page_id),
m AS (SELECT *, coalesce({hits["allow"]}, false) AS good, coalesce({hits["block"]}, false) AS bad FROM u)
SELECT m.page_id, host, path, rule, coalesce(action, CASE WHEN bad AND NOT good THEN 'block' ELSE 'allow' END) AS verdict, good OR bad AS matched FROM m LEFT JOIN b USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op3_warc_transactions": OP3_SQL, "op9_url_rules": _op9_sql()}
