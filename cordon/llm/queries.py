"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ball_kmeans, bpe, decontaminate, filter_audit, html_extract, kd_shards, license_scan, near_dedup, oracles, quality, token_counts, token_files, url_filter
from .common import ship, table

#: The rules of the URL query, as (host, path, action).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n_words=3, percent=85)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    end = 50256
    blocks = token_counts.write_flat(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end)
    return token_counts.label(token_counts.scan(blocks, end), blocks).select("doc_id", "n_tokens")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held = docs.select("doc_id", "text", quality.held_out("doc_id").alias("held_out"))
    return quality.score(held, model, ("doc_id", "held_out"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.fit())


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ball_kmeans.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dims=64, scale=1024)


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(F.coalesce("text", F.lit("")))}
    placed = kd_shards.assign(table(spark, sf_dir, "documents"), shards=16, keep=keep)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_token_files, op3_url_filter, op4_license_scan, op5_decontaminate,
        op6_ann, op7_near_dedup, op8_token_counts, op9_quality, op10_html, op11_clusters, op12_shards, op13_filter_audit,
    )
}

_URL_PARTS = """
  SELECT page_id,
    CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN ''
      ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*') END AS raw_host,
    CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN ''
      ELSE regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages
"""

ORACLE: dict[str, str] = {
    "op3_url_filter": f"""
WITH parts AS ({_URL_PARTS}),
u AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, row_number() OVER () AS k FROM parts),
r(rh, rp, action) AS (VALUES {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)}),
m AS (SELECT k, rh || rp AS rule, action, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
  FROM u JOIN r ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m ON u.k = m.k AND m.n = 1
""",
    "op11_clusters": oracles.kmeans_sql(),
    "op12_shards": oracles.kd_sql(),
    "op13_filter_audit": oracles.AUDIT,
}
