"""Token counts of documents in flat, unindexed token files, by their separators.

A flat file is nothing but 16- or 32-bit ids, an end-of-document id after each document; it is read as
blocks of equal size that know nothing of documents. Each block is searched for the separator with
one vectorised comparison; a prefix scan over the blocks' counts numbers the documents, and the
parts on both sides of block boundaries are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .token_files import library

#: Ids in a block, which is a row: Spark's reader holds 4,096 rows of a column at once in each task, and its writer looks at a page's size every 100 rows.
BLOCK_IDS = 1 << 11
#: Ids that are given to Spark together, or one block's if those are more.
BATCH_IDS = 1 << 18

SCANNED = "file int, block long, n long, ends long, head long, tail long, inner array<long>"


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every whole text (null: empty) into flat files, one for each partition, in blocks of ``block_ids`` ids.

    Returns the table (file, block, data, doc_ids): data is the block's ids as unsigned 32-bit integers;
    doc_ids, apart from the flat data and not read by ``scan``, lists the documents that end in the block.
    Special tokens in a text are ordinary text, so no text holds the separator.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, file = library(tokenizer), TaskContext.get().partitionId()
        held = np.zeros(0, np.uint32)
        ends: list[tuple[int, int | None]] = []  # (position of the separator among all ids, doc_id)
        total = block = taken = 0

        def out(data: np.ndarray) -> pa.RecordBatch:
            nonlocal block, taken
            cuts = [data[k : k + block_ids] for k in range(0, len(data), block_ids)]
            ids = []
            for c in cuts:
                taken += len(c)
                k = next((i for i, e in enumerate(ends) if e[0] >= taken), len(ends))
                ids.append([d for _, d in ends[:k]])
                del ends[:k]
            block += len(cuts)
            return pa.record_batch(
                [
                    pa.array([file] * len(cuts), pa.int32()), pa.array(range(block - len(cuts), block), pa.int64()),
                    pa.array([c.astype("<u4").tobytes() for c in cuts], pa.binary()), pa.array(ids, pa.list_(pa.int64())),
                ],
                names=["file", "block", "data", "doc_ids"],
            )

        together = max(1, BATCH_IDS // block_ids) * block_ids
        for b in slices(batches):
            ids_of = b.column("doc_id").to_pylist()
            done = 0
            for ids, n in lib.encode(b.column("text").to_pylist(), special=False):
                at = total + np.cumsum(n + 1) - 1
                ends += zip(at.tolist(), ids_of[done : done + len(n)], strict=True)
                done += len(n)
                total += len(ids) + len(n)
                held = np.append(held, np.insert(ids, np.cumsum(n), end_id))
                whole = len(held) // block_ids * block_ids
                for k in range(0, whole, together):
                    yield out(held[k : min(k + together, whole)])
                held = held[whole:].copy()
        if len(held):
            yield out(held)

    return written(rows.mapInArrow(run, "file int, block long, data binary, doc_ids array<long>"), "flat-tokens")


def scan(blocks: DataFrame, end_id: int, width: int = 4) -> DataFrame:
    """Token counts by (file, ordinal): n_tokens without the separator, for the documents of each file in order.

    ``blocks`` has file, block and data; a file's blocks in ascending order are its content. A file that
    doesn't end with a separator has one more document, unless it would be empty. Empty blocks count for
    nothing; an empty table has no documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, block, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids = np.frombuffer(data or b"", f"<u{width}")
                at = np.flatnonzero(ids == end_id)
                inner = (np.diff(at) - 1).tolist()
                rows.append((file, block, len(ids), len(at), int(at[0]) if len(at) else len(ids), len(ids) - 1 - int(at[-1]) if len(at) else 0, inner))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCANNED.split(", ")])

    # one small row for each block, kept so that the files are searched once
    found = written(blocks.select("file", "block", "data").mapInArrow(run, SCANNED), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = found.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    inner = numbered.select("file", "first", F.posexplode("inner").alias("k", "n_tokens")).select(
        "file", (F.col("first") + F.col("k") + 1).alias("ordinal"), "n_tokens"
    )
    edges = numbered.select(
        "file",
        F.explode(
            F.array(
                F.struct(F.col("first").alias("ordinal"), F.col("head").alias("n"), (F.col("ends") > 0).alias("ended")),
                F.struct((F.col("first") + F.col("ends")).alias("ordinal"), F.col("tail").alias("n"), F.lit(False).alias("ended")),
            )
        ).alias("e"),
    )
    edges = (
        edges.groupBy("file", F.col("e.ordinal").alias("ordinal"))
        .agg(F.sum("e.n").alias("n_tokens"), F.max("e.ended").alias("ended"))
        .where("ended OR n_tokens > 0")
        .select("file", "ordinal", "n_tokens")
    )
    return inner.unionByName(edges)


def label(counts: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id and n_tokens: the scan's documents, in each file, meet the writer's list of documents in order."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    listed = (
        blocks.select("file", "block", "doc_ids")
        .withColumn("first", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)))
        .select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
        .select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    )
    return counts.join(listed, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
