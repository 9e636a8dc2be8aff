"""The ten operators as queries over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, line_dedup, near_dedup, order_minhash, packing, pii, secrets, sql, token_counts, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.toxic_scores(docs, toxicity.learn_lexicon(docs, _read(spark, sf_dir, "labels")))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.arc_to_warc(warc.pages_as_arc(_read(spark, sf_dir, "pages"))).drop("error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_toxicity, op4_order_minhash, op5_packing, op6_simhash, op7_token_counts, op8_pii, op9_secrets, op10_warc)}

_HEX = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21)"
_FIELDS = {v: f.replace("'", "''") for v, f in warc.FIELDS.items()}

SQL: dict[str, str] = {
    "op1_decontamination": sql.decontamination(),
    "op2_line_dedup": sql.line_dedup(),
    "op5_packing": sql.packs(),
    "op6_simhash": sql.simhash_groups(),
    "op10_warc": f"""
WITH p AS (
  SELECT page_id AS k, 'page-' || page_id || '.arc' AS file, regexp_replace(coalesce(url, ''), '\\s', '%20', 'g') AS url,
         strftime(TIMESTAMP '2001-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS day,
         '10.' || (page_id // 65536) % 256 || '.' || (page_id // 256) % 256 || '.' || page_id % 256 AS ip, coalesce(html, '') AS html
  FROM pages WHERE page_id IS NOT NULL),
r AS (
  SELECT file, 1 AS nth, 'response' AS warc_type, day AS warc_date, url AS target_uri, ip, 'application/http; msgtype=response' AS content_type,
         encode('HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || html) AS block,
         'sha1:' || sha1(encode(html)) AS payload_digest, url AS u FROM p
  UNION ALL
  SELECT file, 0, 'warcinfo', day, NULL, NULL, 'text/plain',
         encode(CASE WHEN k % 2 = 1 THEN '2 0 archive' || chr(10) || '{_FIELDS[2]}' ELSE '1 0 archive' || chr(10) || '{_FIELDS[1]}' END || chr(10)), NULL, 'filedesc://' || file FROM p),
d AS (SELECT *, 'sha1:' || sha1(block) AS block_digest, md5(warc_date || ' ' || u || ' ' || sha1(block)) AS h FROM r)
SELECT file, CAST(nth AS INTEGER) AS nth, warc_type, 'urn:uuid:' || {_HEX.format(h="h")} AS record_id, warc_date, target_uri, ip, content_type,
       block_digest, payload_digest, CAST(octet_length(block) AS BIGINT) AS content_length, block
FROM d""",
}
