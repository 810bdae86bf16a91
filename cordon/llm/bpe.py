"""Byte-level BPE: recursive DuckDB queries inside Spark's partitions encode, an ordered aggregation decodes.

Each partition's new pieces become token-position rows. A recursive query joins neighbouring tokens
with the merge table and contracts every piece's leftmost pair of minimum rank until no pair is left.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices
from .pieces import PieceTable

#: Pieces and bytes of one query at most, and the bytes from which a piece counts as long.
QUERY_PIECES, QUERY_BYTES = 20_000, 1 << 18
LONG_BYTES = 256
#: Tokens that one decoding query takes at most; a longer document is decoded in parts.
DECODE_TOKENS = 1 << 18
DUCK_MB = 110
#: The same for pieces of a hundred thousand characters and more.
LONG_MB = 300
#: Pieces that a worker holds; half of the usual number, as DuckDB lives in the same process.
HELD_PIECES = 1 << 19

#: For short pieces: token-position rows join the merge table once, then a row for each piece holds its tokens and the ranks of its
#: pairs, of which a contraction changes two. Every round's rows stay until the end.
ENCODE = """
WITH RECURSIVE t(it, w, toks, ranks) AS (
  SELECT 0, w, list(tok ORDER BY pos), list(coalesce(rank, 2147483647) ORDER BY pos) FROM start LEFT JOIN merges ON tok = l AND nxt = r GROUP BY w
  UNION ALL
  SELECT it + 1, w, toks[:p - 1] || [m] || toks[p + 2:],
    CASE WHEN p > 1 THEN ranks[:p - 2] || [coalesce(a.rank, 2147483647), coalesce(b.rank, 2147483647)] ELSE [coalesce(b.rank, 2147483647)] END || ranks[p + 2:]
  FROM (SELECT *, list_position(ranks, m) AS p FROM (SELECT *, list_min(ranks) AS m FROM t) WHERE m < 2147483647) x
  LEFT JOIN merges a ON a.l = toks[p - 1] AND a.r = m LEFT JOIN merges b ON b.l = m AND b.r = toks[p + 2])
SELECT w, arg_max(toks, it) AS ids FROM t GROUP BY w ORDER BY w
"""
#: For long pieces: a round contracts, from the left, all occurrences of the pair of minimum rank up to the first whose contraction
#: makes a pair of lower rank, which one contraction at a time would take next. So rounds are as few as the merges that occur,
#: and each is linear. ``{rounds}`` at most, as every round's rows stay until the end.
ENCODE_LONG = """
WITH RECURSIVE s(it, w, toks) AS (
  SELECT 0, w, toks FROM held
  UNION ALL SELECT * FROM (
    WITH t AS (SELECT it, w, unnest(toks) AS tok, unnest(toks[2:] || [NULL]) AS nxt, unnest(toks[3:] || [NULL, NULL]) AS beyond,
      unnest([NULL] || toks[:-2]) AS prior, generate_subscripts(toks, 1) AS pos FROM s WHERE it < {rounds} AND len(toks) > 1),
    k AS (SELECT t.*, rank FROM t JOIN merges ON tok = l AND nxt = r),
    lo AS (SELECT w, min(rank) AS m FROM k GROUP BY w),
    hit AS (SELECT k.*, m, pos - row_number() OVER (PARTITION BY w ORDER BY pos) AS island FROM k JOIN lo USING (w) WHERE rank = m),
    taken AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, island ORDER BY pos) AS n FROM hit) WHERE n % 2 = 1),
    near AS (SELECT w, pos, m, beyond, CASE WHEN lag(pos) OVER (PARTITION BY w ORDER BY pos) = pos - 2 THEN m ELSE prior END AS before FROM taken),
    stop AS (SELECT w, min(pos) AS last FROM near LEFT JOIN merges a ON a.l = before AND a.r = m LEFT JOIN merges b ON b.l = m AND b.r = beyond
      WHERE a.rank < m OR b.rank < m GROUP BY w),
    done AS (SELECT taken.w, pos, m FROM taken LEFT JOIN stop USING (w) WHERE last IS NULL OR pos <= last)
    SELECT any_value(it) + 1 AS it, t.w, list(coalesce(d.m, tok) ORDER BY t.pos) AS toks
    FROM t JOIN lo ON t.w = lo.w LEFT JOIN done d ON d.w = t.w AND d.pos = t.pos LEFT JOIN done g ON g.w = t.w AND g.pos = t.pos - 1
    WHERE g.pos IS NULL GROUP BY t.w))
SELECT w, max(it) AS it, arg_max(toks, it) AS ids FROM s GROUP BY w ORDER BY w
"""
DECODE = "SELECT d, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes FROM ids JOIN vocabulary USING (id) GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class DuckBpe:
    """A vocabulary's merge table, and a DuckDB connection that holds it between ``open`` and ``close``; lives in one Python worker."""

    def __init__(self, path: str):
        self.ranks = ranks = read_ranks(path)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())})
        self.vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.con = None

    def open(self) -> None:
        import duckdb

        # groups of usual texts fit; what a piece of a million characters spills is scratch of this task, gone with ``close``
        self.spill = tempfile.TemporaryDirectory(prefix="bpe-spill-")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCK_MB}MB", "temp_directory": self.spill.name, "preserve_insertion_order": False})
        for name, t in (("merges", self.merges), ("vocabulary", self.vocabulary)):
            self.con.register("given", t)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")

    def close(self) -> None:
        if self.con is not None:
            self.con.close()
            self.con = None
            self.spill.cleanup()

    def _query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.con.register(name, rows)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def _encode_short(self, raw: list[bytes]) -> list[np.ndarray]:
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        tok = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[np.cumsum(n) - 1] = -1  # the last token has none
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
        start = pa.table({"w": np.repeat(np.arange(len(raw), dtype=np.int32), n), "pos": pos.astype(np.int32), "tok": tok, "nxt": nxt})
        return _lists(self._query(ENCODE, "start", start))

    def _encode_long(self, raw: list[bytes]) -> list[np.ndarray]:
        out = [self.byte[np.frombuffer(b, np.uint8)] for b in raw]
        left = list(range(len(raw)))
        self.con.execute(f"SET memory_limit = '{min(LONG_MB, max(DUCK_MB, sum(map(len, out)) * 500 >> 20))}MB'")
        while left:
            rounds = max(1, min(64, (1 << 22) // sum(len(out[k]) for k in left)))
            lists = pa.LargeListArray.from_arrays(np.append(0, np.cumsum([len(out[k]) for k in left])), pa.array(np.concatenate([out[k] for k in left])))
            got = self._query(ENCODE_LONG.format(rounds=rounds), "held", pa.table({"w": np.array(left, np.int32), "toks": lists.cast(pa.list_(pa.int32()))}))
            for k, ids in zip(left, _lists(got), strict=True):
                out[k] = ids
            left = [k for k, it in zip(left, got.column("it").to_pylist(), strict=True) if it == rounds]
        self.con.execute(f"SET memory_limit = '{DUCK_MB}MB'")
        return out

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and the number for each; a piece that is a token is that token, as in the library."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out = [None if (r := self.ranks.get(b)) is None else np.array([r]) for b in raw]
        for query, own in ((self._encode_short, lambda b: len(b) <= LONG_BYTES), (self._encode_long, lambda b: len(b) > LONG_BYTES)):
            todo = [k for k, b in enumerate(raw) if out[k] is None and own(b)]
            for a, z in _runs(np.array([len(raw[k]) for k in todo], np.int64), QUERY_BYTES, QUERY_PIECES):
                for k, ids in zip(todo[a:z], query([raw[k] for k in todo[a:z]]), strict=True):
                    out[k] = ids
        n = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate(out) if out else np.zeros(0, np.int64), n

    def decode(self, ids: np.ndarray, n: np.ndarray) -> Iterator[list[bytes]]:
        """The bytes of each document whose ids stand one after another, in parts of ``DECODE_TOKENS`` tokens at most."""
        parts = [min(DECODE_TOKENS, k - i) for k in n.tolist() for i in range(0, max(k, 1), DECODE_TOKENS)]
        owner = np.repeat(np.arange(len(n)), np.maximum(1, -(-n // DECODE_TOKENS)))
        size = np.array(parts, np.int64)
        at = np.cumsum(size) - size
        held: list[bytes] = []
        for a, z in _runs(size, DECODE_TOKENS):
            own = size[a:z]
            rows = pa.table({"d": np.repeat(np.arange(a, z), own), "pos": np.arange(own.sum()), "id": ids[at[a] : at[a] + own.sum()].astype(np.int32)})
            got = self._query(DECODE, "ids", rows)
            found = dict(zip(got.column("d").to_pylist(), got.column("bytes").to_pylist(), strict=True))
            for k in range(a, z):
                held.append(found.get(k, b""))
                if k + 1 == len(owner) or owner[k + 1] != owner[k]:
                    yield held
                    held = []


def _lists(got: pa.Table) -> list[np.ndarray]:
    ids = got.column("ids").combine_chunks()
    at, values = ids.offsets.to_numpy(), ids.values.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_WORKER: dict[str, tuple[DuckBpe, PieceTable]] = {}


@contextmanager
def worker(path: str) -> Iterator[tuple[DuckBpe, PieceTable]]:
    """The merge table and the table of pieces of this Python worker, which outlive a task, and a connection, which doesn't."""
    if path not in _WORKER:
        bpe = DuckBpe(path)
        _WORKER[path] = bpe, PieceTable(bpe.encode, HELD_PIECES)
    bpe, table = _WORKER[path]
    bpe.open()
    try:
        yield bpe, table
    finally:
        bpe.close()
        release()


def _digest(parts: list[bytes]) -> str:
    h = hashlib.sha256()
    for x in parts:
        h.update(x)
    return h.hexdigest()


def encode(docs: DataFrame, ranks: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep``, n_tokens (long) and ids (binary: unsigned 32-bit, little-endian) of each row's whole text.

    Null counts as the empty text: no ids. Each row is encoded by itself, so repeated rows are repeated.
    """
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__encoded_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker(ranks) as (_, table):
            for b in slices(batches):
                done = 0
                for ids, n in table.encode_texts(b.column(b.num_columns - 1).to_pylist()):
                    part = b.slice(done, len(n))
                    done += len(n)
                    yield pa.record_batch([*part.columns[:-1], pa.array(n), _cut(ids, n)], names=[*b.schema.names[:-1], "n_tokens", "ids"])

    return source.mapInArrow(run, source.drop("__encoded_text").schema.add("n_tokens", "long").add("ids", "binary"))


def _runs(n: np.ndarray, most: int, rows: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Runs whose sizes sum to ``most`` at most, or of one element, and of ``rows`` elements at most."""
    a, size = 0, 0
    for z, k in enumerate(n.tolist()):
        if z > a and (size + k > most or z - a == rows):
            yield a, z
            a, size = z, 0
        size += k
    if len(n):
        yield a, len(n)


def _cut(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    raw = ids.astype("<u4").tobytes()
    at = (np.append(0, np.cumsum(n)) * 4).tolist()
    return pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def decode(encoded: DataFrame, ranks: str, keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Columns ``keep`` and decoded (binary), the bytes that each row's ids stand for; null ids give none."""
    source = encoded.select(*keep, F.col("ids").alias("__decoded_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker(ranks) as (bpe, _):
            for b in slices(batches):
                raw = [x or b"" for x in b.column(b.num_columns - 1).to_pylist()]
                sizes = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
                for a, z in _runs(sizes, DECODE_TOKENS):
                    got = [b"".join(x) for x in bpe.decode(np.frombuffer(b"".join(raw[a:z]), "<u4"), sizes[a:z])]
                    yield pa.record_batch([*b.slice(a, z - a).columns[:-1], pa.array(got, pa.binary())], names=[*b.schema.names[:-1], "decoded"])

    return source.mapInArrow(run, source.drop("__decoded_ids").schema.add("decoded", "binary"))


def round_trip(docs: DataFrame, ranks: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: ``keep``, n_tokens, ids_sha256, decoded_sha256 (lowercase hex), and the ids if asked for.

    One Python worker does both, so ids don't travel between processes. As in ``encode``, null counts as empty.
    """
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__encoded_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker(ranks) as (bpe, table):
            for b in slices(batches):
                done = 0
                for ids, n in table.encode_texts(b.column(b.num_columns - 1).to_pylist()):
                    part = b.slice(done, len(n))
                    done += len(n)
                    raw = _cut(ids, n)
                    columns = [pa.array(n), pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in raw]), pa.array(list(map(_digest, bpe.decode(ids, n))), pa.string())]
                    yield pa.record_batch([*part.columns[:-1], *columns, *([raw] if with_ids else [])], names=[*b.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    schema = source.drop("__encoded_text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return source.mapInArrow(run, schema.add("ids", "binary") if with_ids else schema)
