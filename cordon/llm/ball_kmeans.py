"""Centroid clustering by ball k-means, in exact integers.

Vectors lie in written blocks, each with its members' clusters. In a round every block's share of a cluster is a ball: the
centroid, and the largest distance of a member as radius. Only centroids that lie within twice the radius are its neighbours. A
member that is nearer to its centroid than half the way to the nearest neighbour is in the stable core and stays; the others stand in annuli between
the halves of the ways to one neighbour and the next, and are compared with the neighbours up to their annulus only. By the triangle
inequality no other centroid is as near, so the assignment is that of comparing with all. Each round's blocks are a table, and
their sums come with them, so a lost executor costs its blocks of one round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, release, written

#: Vectors of a block at most.
BLOCK = 4096
#: Components at or beyond 2^62 stand at that bound; distances and sums beyond a long stand at its end.
COMPONENT, LONG = 1 << 62, (1 << 63) - 1
_BLOCK = "ids array<long>, width int, x binary, cluster binary, sums array<struct<cluster:int,totals:array<string>>>"
_WIDTHS = [(np.int16, 1 << 15), (np.int32, 1 << 31), (np.int64, 1 << 63)]


def _scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; ``scale`` is a power of two, so the product of doubles is exact."""
    product = values * scale
    if np.isfinite(product).all() and (not product.size or np.abs(product).max() < COMPONENT):
        return np.floor(product).astype(np.int64)
    exact = [max(-COMPONENT, min(COMPONENT, math.floor(Fraction(x) * scale))) for x in values.ravel().tolist()]
    return np.array(exact, np.int64).reshape(values.shape)


def _exact(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where squared distances are exact in them, else as Python integers."""
    most = max([int(abs(int(f(a)))) for a in (x, c) if a.size for f in (np.min, np.max)], default=0)
    kind = np.float64 if 4 * most * most * max(1, c.shape[1]) < 1 << 53 else object
    return x.astype(kind), c.astype(kind)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d) if d.dtype != object else (d * d).sum(axis=1)


def assign(x: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row of integers, starting from the clusters ``own``; ties go to the smaller number."""
    x, c = _exact(x, centroids)
    best, dist = own.copy(), np.zeros(len(x), x.dtype)
    for i in np.unique(own).tolist():
        members = np.flatnonzero(own == i)
        d = _squared(x[members], c[i])
        gap = _squared(c, c[i])
        radius = d.max()
        near = np.flatnonzero(gap <= 4 * radius)
        near = near[near != i]
        near = near[np.argsort(gap[near], kind="stable")]
        now, at = d.copy(), np.full(len(members), i, own.dtype)
        # members from their annulus inwards: the stable core meets no neighbour
        annulus = np.searchsorted(gap[near], 4 * d, side="right")
        for k, j in enumerate(near.tolist()):
            rows = np.flatnonzero(annulus > k)
            other = _squared(x[members[rows]], c[j])
            closer = (other < now[rows]) | ((other == now[rows]) & (j < at[rows]))
            now[rows[closer]], at[rows[closer]] = other[closer], j
        best[members], dist[members] = at, now
    return best, dist


def _kept(vectors: DataFrame, id_col: str, vector: str, dims: int) -> DataFrame:
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    ok = F.col(vector).isNotNull() & (F.size(vector) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _blocks(kept: DataFrame, dims: int, scale: int) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                part = b.slice(k, BLOCK)
                v = _scaled(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
                most = max(int(v.max()), -int(v.min()) - 1)
                width = next(t for t, n in _WIDTHS if most < n)
                yield _block(part.column("id"), v.astype(width), np.zeros(len(v), np.int32), None)
        release()

    return written(kept.mapInArrow(run, _BLOCK), "blocks")


def _block(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, sums: list | None) -> pa.RecordBatch:
    columns = [
        pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids),
        pa.array([x.itemsize], pa.int32()),
        pa.array([x.tobytes()], pa.binary()),
        pa.array([cluster.tobytes()], pa.binary()),
        pa.array([sums], pa.list_(pa.struct([("cluster", pa.int32()), ("totals", pa.list_(pa.string()))]))),
    ]
    return pa.record_batch(columns, names=["ids", "width", "x", "cluster", "sums"])


def _each(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for b in batches:
        for k in range(b.num_rows):
            ids, width = b.column("ids")[k].values, b.column("width")[k].as_py()
            kind = next(t for t, _ in _WIDTHS if np.dtype(t).itemsize == width)
            x = np.frombuffer(b.column("x")[k].as_buffer(), kind).reshape(-1, dims)
            yield ids, x, np.frombuffer(b.column("cluster")[k].as_buffer(), np.int32)


def _round(blocks: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """The blocks with their members' next clusters; a partition's last one carries the sums of all its members by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64).reshape(-1, dims)
        totals: dict[int, list[int]] = {}
        held = None
        for ids, x, own in _each(batches, dims):
            if held is not None:
                yield _block(*held, None)
            best, _ = assign(x.astype(np.int64), own, c)
            for i in np.unique(best).tolist():
                part = x[best == i]
                # halves of 32 bits, whose sums over a block can't overflow
                high, low = (part.astype(np.int64) >> 32).sum(axis=0), (part.astype(np.int64) & 0xFFFFFFFF).sum(axis=0)
                total = [(int(h) << 32) + int(w) for h, w in zip(high, low, strict=True)] + [len(part)]
                totals[i] = [a + b for a, b in zip(totals[i], total, strict=True)] if i in totals else total
            held = ids, x, best
        if held is not None:
            yield _block(*held, [{"cluster": i, "totals": [str(v) for v in t]} for i, t in totals.items()])
        release()

    return blocks.mapInArrow(run, _BLOCK)


def _moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The floors of the members' means; an empty cluster keeps its centroid. Sums are added up by Spark, one row for each cluster and dimension is left."""
    rows = blocks.where("sums IS NOT NULL").select(F.explode("sums").alias("s")).select("s.cluster", F.posexplode("s.totals").alias("k", "v"))
    found: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("cluster", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        found.setdefault(r.cluster, {})[r.k] = int(r.v)
    return [[found[i][k] // found[i][len(c)] for k in range(len(c))] if i in found else c for i, c in enumerate(centroids)]


def _assigned(blocks: DataFrame, centroids: list[list[int]], dims: int, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centroids, np.int64).reshape(-1, dims)
        for ids, x, own in _each(batches, dims):
            best, dist = assign(x.astype(np.int64), own, c)
            whole = pa.array([min(LONG, int(d)) for d in dist.tolist()], pa.int64())
            yield pa.record_batch([ids, pa.array(best, pa.int32()), whole], names=[id_col, "cluster", "distance"])
        release()

    return written(blocks.mapInArrow(run, f"`{id_col}` long, cluster int, distance long"), "clusters")


def _first(kept: DataFrame, k: int, seed: int, dims: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest hashes, as integers; rows without id come last, equal ids by their components."""
    rows = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "x").limit(k).collect()
    return _scaled(np.array([r.x for r in rows], np.float64).reshape(-1, dims), scale).tolist()


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with ``dims`` finite components.

    Components become floor(scale * x); ``scale`` must be a power of two. The first centroids are the k vectors with the smallest sha256 of
    ``seed:id``; then ``rounds`` times all vectors are assigned and centroids moved to the floors of their means, then all are assigned once more. A
    round that moves nothing ends the rounds, as the rest would move nothing either. Null vectors, those of another
    length and those with null or non-finite components take no part; rows without id do, but start a centroid last. Repeated rows count each;
    fewer vectors than k give fewer centroids, none gives no rows. Distances and inertias beyond a long stand at its end. The driver holds
    k * dims integers and each task a block of vectors and k centroids; no group of rows is gathered by cluster, however large.
    """
    spark = vectors.sparkSession
    kept = _kept(vectors, id_col, vector, dims)
    centroids = _first(kept, k, seed, dims, scale)
    schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    blocks = _blocks(kept, dims, scale)
    for _ in range(rounds):
        nxt = written(_round(blocks, centroids, dims), "blocks")
        drop_written(spark, blocks)
        blocks, before = nxt, centroids
        centroids = _moved(blocks, centroids)
        if centroids == before:
            break
    out = _assigned(blocks, centroids, dims, id_col)
    drop_written(spark, blocks)
    parts = {r.cluster: int(r.v) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("v")).collect()}
    total = min(LONG, sum(parts.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    stats = spark.createDataFrame([(i, min(LONG, v), total, sha[i]) for i, v in parts.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row for each of the k centroids
    return out.join(F.broadcast(stats), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
