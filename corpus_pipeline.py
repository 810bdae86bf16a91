"""Corpus pipeline: quality, near-duplicates, benchmark passages, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.llm import bpe, decontaminate, near_dedup, quality
from cordon.llm.common import join_sized, ship, table, written

#: Rows up to which a list of dropped rows is broadcast; counted first.
BROADCAST_ROWS = 2_000_000
ROW = "__row"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, as a written table, and the number's name, which no column of ``docs`` has: null and repeated ids are judged by their own rows' texts."""
    row = ROW + "_" * max([len(c) for c in docs.columns if c.lower().startswith(ROW)], default=0)
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _without(rows: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """``rows`` without those whose number is listed, and without the number."""
    listed = written(dropped.select(F.col(ROW).alias(row)).distinct(), "dropped")
    if listed.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    return rows.join(listed, row, "left_anti").drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled ones, accepts; each by its own text, repeated rows alike, null as the empty text."""
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    scored = quality.score(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.col("text")), model, tuple(names))
    return scored.where("predicted = 1").select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): that of smallest doc_id, ties by place, one without id last; empty texts stay."""
    ship(spark)
    rows, row = _numbered(docs)
    found = near_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text", F.col("doc_id").alias("id")), keep=("id",))
    found = written(found.select(F.col("doc_id").alias(ROW), "id", F.col("component_id").alias("c")), "groups")
    order = F.struct(F.col("id").isNull().alias("last"), "id", ROW)
    best = found.groupBy("c").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1").select("c", F.col(f"best.{ROW}").alias("stays"), "n")
    dropped = join_sized(found, best, "c", "n", found.count()).where(F.col(ROW) != F.col("stays"))
    return _without(rows, dropped, row)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, each judged by its own text."""
    rows, row = _numbered(docs)
    found = decontaminate.find(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, found.select(F.col("doc_id").alias(ROW)), row)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, unsigned 32-bit little-endian), and whether decoding them gives the text again."""
    ship(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    both = bpe.round_trip(docs.select("doc_id", "text", digest), ranks, ("doc_id", "digest"), with_ids=True)
    return both.select("doc_id", "n_tokens", "ids", (F.col("decoded_sha256") == F.col("digest")).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: SQL can express neither the fitted classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
