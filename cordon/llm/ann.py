"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are the signs of rotations learned on a bounded sample (iterative quantisation). Every block of
the table indexes each substring of its codes; by the pigeonhole principle a code within the
radius is near the query's in some substring, so probing the substrings' neighbourhoods retrieves every code
within it. Full Hamming distances confirm, and inner products of the original vectors rank what is left.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors that the fit sees at most, bits of a code, bits of a substring.
SAMPLE = 10_000
BITS = 256
SUB_BITS = 8
#: Share of the sample's true neighbours that the radius is to hold.
HOLD = 0.975
#: Vectors and queries that meet in one group at most (on average).
BLOCK, QUERY_BLOCK = 8192, 4096

_PROBES = {r: np.array([sum(1 << b for b in c) for k in range(r + 1) for c in itertools.combinations(range(SUB_BITS), k)], np.int64) for r in range(SUB_BITS + 1)}


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A row of ``BITS`` / 8 bytes for each vector."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1, dtype=np.int64)


def fit(sample: np.ndarray, total: int, k: int, rounds: int = 25, seed: int = 5) -> Codes:
    """Rotations by iterative quantisation, and the radius that holds the neighbours of the sample's own points.

    The sample is thinner than the table, so as many neighbours of each point count as ``k`` of the table would be in it.
    """
    d = sample.shape[1]
    mean = sample.mean(axis=0)
    x = sample - mean
    rng = np.random.default_rng(seed)
    base = np.eye(d)
    if d > BITS:
        base = np.linalg.svd(x, full_matrices=False)[2][:BITS].T
        base = np.hstack([base, np.zeros((d, BITS - base.shape[1]))])
    v = x @ base
    parts = []
    for _ in range(-(-BITS // v.shape[1])):
        r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(base @ r)
    codes = Codes(mean, np.hstack(parts)[:, :BITS], BITS)
    if len(sample) > 1:
        packed = codes.encode(sample)
        near = min(len(sample) - 1, max(1, math.ceil(k * len(sample) / max(total, 1))))
        seen = []
        for q in rng.choice(len(sample), min(400, len(sample)), replace=False).tolist():
            s = sample @ sample[q]
            s[q] = -np.inf
            top = np.argpartition(-s, near - 1)[:near]
            seen.append(hamming(packed[top], np.repeat(packed[q : q + 1], near, axis=0)))
        codes.radius = int(np.quantile(np.concatenate(seen), HOLD))
    return codes


class MultiIndex:
    """The codes of a block, each substring indexed by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.order = np.argsort(self.codes, axis=0, kind="stable").T
        self.start = np.array([np.searchsorted(self.codes[o, j], np.arange(257)) for j, o in enumerate(self.order)])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``: all of them, none else."""
        m = self.codes.shape[1]
        r, a = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            near = r if j <= a else r - 1  # the pigeonhole principle with the remainder
            if near < 0:
                break
            values = _PROBES[min(near, SUB_BITS)] ^ int(code[j])
            lo, n = self.start[j][values], self.start[j][values + 1] - self.start[j][values]
            total = np.cumsum(n)
            hit[self.order[j][np.repeat(lo - (total - n), n) + np.arange(total[-1])]] = True
        rows = np.flatnonzero(hit)
        return rows[hamming(self.codes[rows], np.repeat(code[None], len(rows), axis=0)) <= radius] if len(rows) else rows


def _best(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of largest inner product, ties to smaller ids, each product summed alike wherever its row stands."""
    s = x[rows] @ q
    if len(rows) > k:
        cut = np.partition(s, len(s) - k)[len(s) - k]
        rows = rows[s >= cut - 1e-9 * (1 + abs(cut))]
    s = (x[rows] * q).sum(axis=1)
    o = np.lexsort((ids[rows], -s))[:k]
    return rows[o], s[o]


def _search(base: DataFrame, queries: DataFrame, k: int, radius: int, n_base: int, n_queries: int) -> DataFrame:
    blocks, query_blocks = max(1, -(-n_base // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    i, j = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = base.select(i.alias("i"), each(query_blocks).alias("j"), F.lit(False).alias("asks"), "vec_id", "x", "code").unionByName(
        queries.select(each(blocks).alias("i"), j.alias("j"), F.lit(True).alias("asks"), "vec_id", "x", "code")
    )

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        ids = t.column("vec_id").to_numpy()
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(len(ids), -1)
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        own, at = np.flatnonzero(~asks), np.flatnonzero(asks)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(own):
            index, own_ids, own_x = MultiIndex(code[own]), ids[own], x[own]
            for q in at.tolist():
                rows = index.within(code[q], radius)
                rows = rows[own_ids[rows] != ids[q]]
                if len(rows):
                    rows, s = _best(rows, own_ids, own_x, x[q], k)
                    out.append((np.full(len(rows), ids[q]), own_ids[rows], s))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    return sides.groupBy("i", "j").applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product in double precision, ties to smaller ids.

    ``is_query`` is a condition on ``vec_id``. Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do those of another length than most; null ids neither. Rows that share an id count once. A query that finds
    fewer than k (or all, if the table has fewer) within the radius is searched again without one.
    """
    v = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(
        F.col("vec_id").isNotNull()
        & v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
        & F.exists(v, lambda y: y != 0)
    )
    rows = rows.groupBy("vec_id").agg(F.min("x").alias("x"))
    rows = written(rows, "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d, n = (sizes[0]["d"], sizes[0]["count"]) if sizes else (1, 0)
    rows = rows.where(F.size("x") == d)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow().column("x")
    codes = fit(np.array(sample.to_pylist(), float).reshape(-1, d) if n else np.ones((1, d)), n, k)

    def code(batches):
        for b in batches:
            x = np.array(b.column("x").to_pylist(), np.float64).reshape(-1, d)
            yield pa.record_batch(
                [b.column("vec_id"), pa.array([y.tobytes() for y in x], pa.binary()), pa.array([y.tobytes() for y in codes.encode(x)], pa.binary())],
                names=["vec_id", "x", "code"],
            )

    base = written(rows.select("vec_id", "x").mapInArrow(code, "vec_id long, x binary, code binary"), "codes")
    queries = base.where(is_query)
    n_queries = queries.count()
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    first = written(top(_search(base, queries, k, codes.radius, n, n_queries)), "nearest")
    full = first.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = written(queries.join(full, "vec_id", "left_anti"), "short")
    n_short = short.count()
    out = first
    if n_short:
        again = top(_search(base, short, k, BITS, n, n_short))
        out = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
