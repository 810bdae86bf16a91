"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

The library's ids are replaced by their ranks by frequency in the whole corpus, so that the most
frequent 256 take one byte. Two control bits say how many bytes (1 to 4) a value has; four values
share a control byte, and control and data bytes lie apart. Decoding looks control bytes up in a
table and gathers the data bytes, all with numpy.

A file set is a Parquet table of blocks in the shared folder: every block is a run of whole documents in
ascending doc_id order with its own control and data bytes; writing it is a Spark job with the
usual commit, so lost executors and remote stores are no special cases.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, new_path, slices, written
from .pieces import PieceTable

END_ID = 0
#: Tokens in a block, unless its only document has more.
BLOCK_TOKENS = 1 << 19

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = values.astype("<u4")
    n = (1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = n - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < n[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The first ``count`` values; the inverse of ``pack``."""
    n = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(n) - n
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(n > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Library:
    """A tokenizer of the tokenizers library behind a table of pieces that it has already encoded."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = PieceTable(self._encode)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        n = []
        for i in range(0, len(pieces), 20_000):
            for e in self.tokenizer.encode_batch(pieces[i : i + 20_000], add_special_tokens=False):
                ids += e.ids
                n.append(len(e.ids))
        return np.array(ids, np.uint32), np.array(n, np.int64)

    def encode(self, texts: list[str], special: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of consecutive texts and their numbers; with ``special``, as the library, special tokens in a text get their ids."""
        plain: list[str] = []
        for t in texts:
            if special and any(s in t for s in self.special):
                yield from self.table.encode_texts(plain)
                plain = []
                ids = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                yield ids, np.array([len(ids)])
            else:
                plain.append(t)
        yield from self.table.encode_texts(plain)


_WORKER: dict[str, Library] = {}


def library(path: str) -> Library:
    """The tokenizer of this Python worker; it outlives a task."""
    if path not in _WORKER:
        _WORKER[path] = Library(path)
    return _WORKER[path]


def encode_sorted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (shard, at, doc_id, n_tokens, ids) in ascending doc_id order, ``at`` counting tokens within the shard.

    Shards are ranges of (doc_id, hash of the text), so that repeated ids spread too.
    """
    tie = F.xxhash64("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, shard, at = library(tokenizer), TaskContext.get().partitionId(), 0
        for b in slices(batches):
            done = 0
            for ids, n in lib.encode(b.column("text").to_pylist()):
                n1 = n + 1
                full = np.insert(ids, np.cumsum(n), END_ID).astype("<u4")
                ends = np.cumsum(n1)
                raw, cut = full.astype("<u2" if full.max(initial=0) < 65536 else "<u4"), np.append(0, ends)
                width = raw.itemsize
                part = b.slice(done, len(n))
                done += len(n)
                data = raw.tobytes()
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(n), shard, np.int32)),
                        pa.array(at + ends - n1),
                        part.column("doc_id"),
                        pa.array(n1),
                        pa.array(np.full(len(n), width, np.int32)),
                        pa.array([data[width * x : width * y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                    ],
                    names=["shard", "at", "doc_id", "n_tokens", "width", "ids"],
                )
                at += int(ends[-1]) if len(ends) else 0

    return rows.mapInArrow(run, "shard int, at long, doc_id long, n_tokens long, width int, ids binary")


def _ids(width: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4")


def ranking(encoded: DataFrame, n_ids: int) -> np.ndarray:
    """Ids by falling frequency over all documents, ties by id; ``n_ids``, the vocabulary's size, bounds it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            for width, raw in zip(b.column("width").to_pylist(), b.column("ids").to_pylist(), strict=True):
                total += np.bincount(_ids(width, raw), minlength=n_ids)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    got = encoded.select("width", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(n_ids, np.int64)
    total[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return np.argsort(-total, kind="stable").astype(np.uint32)


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode every whole text (null: empty), append ``END_ID``, and write the file set at ``path``.

    ``path``/blocks has the coded blocks, ``path``/vocabulary the id of each rank. An empty table
    gives an empty file set. Rows with one doc_id lie side by side; null ids come first.
    """
    spark = docs.sparkSession
    encoded = written(encode_sorted(docs, tokenizer), "ids")
    by_rank = ranking(encoded, library(tokenizer).tokenizer.get_vocab_size())
    rank_of = np.argsort(by_rank).astype(np.uint32)
    shards = encoded.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row for each shard, as many as partitions
    base = shards.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([_ids(w, r) for _, _, _, _, w, r in held])
            control, data = pack(rank_of[ids])
            return pa.record_batch(
                [
                    pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]], pa.int64()), pa.array([[x[2] for x in held]], pa.list_(pa.int64())),
                    pa.array([[x[3] for x in held]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
                ],
                names=["shard", "at", "doc_ids", "counts", "control", "data"],
            )

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (row[0] != held[0][0] or row[1] != held[-1][1] + held[-1][3] or size + row[3] > BLOCK_TOKENS):
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield out()

    blocks = encoded.select("shard", "at", "doc_id", "n_tokens", "width", "ids").mapInArrow(
        block, "shard int, at long, doc_ids array<long>, counts array<long>, control binary, data binary"
    )
    blocks = blocks.join(F.broadcast(base), "shard").select("shard", (F.col("base") + F.col("at")).alias("start"), "doc_ids", "counts", "control", "data")
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    spark.createDataFrame(pa.table({"rank": np.arange(len(by_rank)), "id": by_rank.astype(np.int64)})).coalesce(1).write.parquet(f"{path}/vocabulary")
    drop_written(spark, encoded)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode the file set at ``path``: doc_id, start (ids before it), n_tokens (with the end id), ids (binary, unsigned 32-bit)."""
    by_rank = _vocabulary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["counts"], np.int64)
                raw = by_rank[unpack(r["control"], r["data"], int(n.sum()))].astype("<u4").tobytes()
                ends = np.cumsum(n)
                yield pa.record_batch(
                    [
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(r["start"] + ends - n),
                        pa.array(n),
                        pa.array([raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _vocabulary(spark: SparkSession, path: str) -> np.ndarray:
    """Bounded by the vocabulary's size."""
    t = spark.read.parquet(f"{path}/vocabulary").toArrow()
    out = np.zeros(len(t), np.uint32)
    out[t.column("rank").to_numpy()] = t.column("id").to_numpy()
    return out


def checksums(decoded: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the CRC-32 of the ids as unsigned 32-bit integers."""
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = new_path(docs.sparkSession, "token-files")
    write(docs, tokenizer, path)
    return checksums(read(docs.sparkSession, path))


