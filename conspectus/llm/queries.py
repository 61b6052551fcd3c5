"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprints, langid, neardup, packing, pii, sharding, toxicity, url_filter, warc
from .common import table

#: Looked up by name where the texts are tokenised.
VOCABULARY = "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))[1]


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = sharding.shard(docs, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.inspect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_url_filter_cascade": op2_url_filter_cascade,
    "op3_seekable_warc": op3_seekable_warc,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_pii_spans": op5_pii_spans,
    "op6_spaced_seed_decontamination": op6_spaced_seed_decontamination,
    "op7_minhash_fingerprints": op7_minhash_fingerprints,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_histogram_sharding": op9_histogram_sharding,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter_cascade": r"""
        WITH split AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM split),
        parts AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
        ), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        best AS (
            SELECT page_id, host, path, max(CASE WHEN (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) THEN lpad(CAST(length(h || p) AS VARCHAR), 4, '0') || h || p END) AS b
            FROM parts CROSS JOIN rules GROUP BY page_id, host, path
        )
        SELECT page_id, host, path, substr(b, 5) AS rule, coalesce((SELECT v FROM rules WHERE h || p = substr(b, 5)), 'allow') AS verdict FROM best
    """,
    "op3_seekable_warc": """
        WITH base AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), top AS (SELECT payload_digest, max(page_id) AS response_id FROM base WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> response_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> response_id THEN response_id END AS refers_to
        FROM base LEFT JOIN top USING (payload_digest)
    """,
}
