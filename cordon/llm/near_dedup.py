"""MinHash near-dedup: many universal hash minima, banding, signature and set verification, components.

Equal shingle sets become one class first, so exact copies never meet in pairs. Classes that share a
band's minima share a bucket. In each bucket the member with most company is compared with all
others; only buckets that still hold several components are then searched for links between components: small ones
pair by pair, by signatures and full sets; large ones only where two sets share one of their rarest shingles, which linked sets must.
So no connection is lost that banding retrieves, while a group that hangs together costs as many comparisons as it has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import drop_written, join_sized, release, slices, written
from .components import components
from .shingles import mix, shingle_sets

MAX_HASHES = 128
#: Probability at most that banding misses a pair right at the threshold.
MISS = 1e-4
#: Standard errors below the threshold at which the signature rules a pair out.
SIGMAS = 4.5
#: Nodes in a block of a bucket, members that meet one row of their chief, and rows up to which a list of nodes is broadcast.
BLOCK = 512
MEMBERS = 64
BROADCAST_NODES = 2_000_000


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``MAX_HASHES`` minima that keeps to ``MISS``."""
    for rows in range(12, 0, -1):
        bands = MAX_HASHES // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS:
            return bands, rows
    return MAX_HASHES, 1


def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift functions, a universal family on 64-bit keys."""
    rng = np.random.default_rng(20240601)
    return rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each function over a set that is not empty, 32 bits each."""
    out = np.empty(len(a), np.uint64)
    with np.errstate(over="ignore"):
        buf = np.empty(len(shingles), np.uint64)
        for k in range(len(a)):
            np.multiply(shingles, a[k], out=buf)
            np.add(buf, b[k], out=buf)
            out[k] = buf.min()
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of the signature."""
    with np.errstate(over="ignore"):
        h = np.arange(bands, dtype=np.uint64)
        for k in range(rows):
            h = mix(h + sig[k : bands * rows : rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h.astype(np.int64)


def sketches(docs: DataFrame, n_words: int, percent: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), keys (of the bands) and bytes (the lowest of each minimum), the last three null for empty sets, and ``keep``."""
    bands, rows = bands_for(percent)
    source = docs.select(*keep, "doc_id", F.col("text").alias("__sketched_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(bands * rows)
        for batch in slices(batches):
            n, digest, keys, low = [], [], [], []
            for s in shingle_sets(batch.column(batch.num_columns - 1).to_pylist(), n_words):
                n.append(len(s))
                sig = signature(s, a, b) if len(s) else None
                digest.append(None if sig is None else _digest(s.tobytes()))
                keys.append(None if sig is None else band_keys(sig, bands, rows).tolist())
                low.append(None if sig is None else sig.astype(np.uint8).tobytes())
            made = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.record_batch([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "n_shingles", "digest", "keys", "bytes"])

    schema = source.drop("__sketched_text").schema
    for name, kind in (("n_shingles", "long"), ("digest", "binary"), ("keys", ArrayType(LongType())), ("bytes", "binary")):
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)


def _sets(docs: DataFrame, nodes: DataFrame, n_words: int) -> DataFrame:
    """(node, data), the full sets of the classes listed (node, first_doc, digest); the list is broadcast up to ``BROADCAST_NODES`` rows, counted first."""
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    source = docs.select(F.col("doc_id").alias("first_doc"), "text").join(nodes.select("first_doc", "node", "digest"), "first_doc").select("node", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), n_words)]
            # other texts of the same id have another digest
            own = [_digest(x) == d for x, d in zip(raw, b.column("digest").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("node"), pa.array(raw, pa.binary())], names=["node", "data"]).filter(pa.array(own, pa.bool_()))

    return source.mapInArrow(run, "node long, data binary")


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _verified(pairs: DataFrame, payload: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) whose payloads (node, data) pass the test.

    The members b of each a are dealt into blocks, and each block's rows stand sorted behind one row of a, so the payload of
    a node with many partners is neither copied to each of them nor held in one task.
    """
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    company = pairs.groupBy("a").agg(F.count("*").alias("size"))
    placed = written(
        join_sized(pairs, company, "a", "size", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / MEMBERS)).cast("int").alias("block")), "placed"
    )
    members = placed.join(payload.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "data")
    heads = placed.select("a", "block").distinct().join(payload.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "data")
    rows = members.unionByName(heads).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: bytes = b""
        for batch in batches:
            keep = []
            for b, data in zip(batch.column("b").to_pylist(), batch.column("data"), strict=True):
                if b is None:
                    head = data.as_py()
                keep.append(b is not None and test(head, data.as_buffer()))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    out = written(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    drop_written(pairs.sparkSession, placed, pairs)
    return out


def _same_sets(percent: int) -> Callable[[bytes, bytes], bool]:
    def test(x: bytes, y: bytes) -> bool:
        u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(u, v, assume_unique=True))
        return 100 * common >= percent * (len(u) + len(v) - common)

    return test


def _same_signatures(percent: int, floor: float) -> Callable[[bytes, bytes], bool]:
    """Payloads: eight bytes of the set's size, then the minima's lowest bytes."""

    def test(x: bytes, y: bytes) -> bool:
        m, n = int.from_bytes(x[:8], "big"), int.from_bytes(y[:8], "big")
        if 100 * min(m, n) < percent * max(m, n):
            return False
        return (np.frombuffer(x, np.uint8, offset=8) == np.frombuffer(y, np.uint8, offset=8)).mean() >= floor

    return test


def _estimate_floor(percent: int, hashes: int) -> float:
    t = percent / 100
    return t - SIGMAS * (t * (1 - t) / hashes) ** 0.5


def _cross_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links between different components in buckets (key, sub, node, n, comp, keys, bytes, data, size).

    A bucket of more than ``BLOCK`` nodes is cut into blocks by hash, and each pair of blocks is one small group. There, pairs of different components whose
    signatures may reach the threshold are compared on their full sets, in the first bucket that they share, until
    they hang together: a group yields fewer links than it has components, however many pairs it has.
    """
    bands, per = bands_for(percent)
    floor = _estimate_floor(percent, bands * per)
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    columns = ("key", "sub", "node", "n", "comp", "keys", "bytes", "data")
    blocked = rows.select(*columns, n_blocks.alias("nb"), mine.alias("mine")).select(*columns, "mine", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    blocked = blocked.select("*", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def run(t: pa.Table) -> pa.Table:
        node, n, comp = (t.column(c).to_numpy() for c in ("node", "n", "comp"))
        mine, i, j = t.column("mine").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        key = t.column("key")[0].as_py()
        keys = np.array(t.column("keys").to_pylist(), np.int64)
        sig = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(len(node), -1)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("data").to_pylist()]
        # a pair of a band's bucket is compared in the first one that it shares
        at = int(np.append(np.flatnonzero((keys == key).any(axis=0)), 0)[0])
        own = np.unique(comp, return_inverse=True)[1]
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        a_out, b_out = [], []
        for x in left.tolist():
            y = right[(own[right] != own[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            if i == j:
                y = y[node[y] > node[x]]
            if not len(y):
                continue
            y = y[~(keys[y, :at] == keys[x, :at]).any(axis=1)]
            est = (sig[y] == sig[x]).mean(axis=1)
            ok = np.flatnonzero(est >= floor)
            for k in ok[np.argsort(-est[ok], kind="stable")].tolist():
                z = int(y[k])
                if own[z] == own[x]:
                    continue
                common = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                if 100 * common >= percent * (len(sets[x]) + len(sets[z]) - common):
                    a_out.append(min(node[x], node[z]))
                    b_out.append(max(node[x], node[z]))
                    own[own == own[z]] = own[x]
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return blocked.groupBy("key", "sub", "i", "j").applyInArrow(run, "a long, b long")


def _by_rare_shingles(rows: DataFrame, percent: int) -> DataFrame:
    """Nodes of large buckets (node, comp, data) in smaller ones (sub, node, comp, size), sub being a shingle.

    Each node stands in those of its rarest shingles among these nodes, so many that the rest, without any of them, is less than the share ``percent``
    of the node: two linked sets have one of them in common. Their number is linear in the sizes of the sets, however many large buckets a node is in.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            sets = [np.frombuffer(x, np.int64) for x in b.column("data").to_pylist()]
            n = np.array([len(x) for x in sets])
            at = np.repeat(np.arange(len(sets)), n)
            yield pa.record_batch([b.column("node").take(at), b.column("comp").take(at), pa.array(n[at]), pa.array(np.concatenate(sets))], names=["node", "comp", "n", "sub"])

    each = written(rows.select("node", "comp", "data").mapInArrow(spread, "node long, comp long, n long, sub long"), "shingles", "none")
    # shingles of one component only come first in the order and need not be listed
    times = each.groupBy("sub").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sub", "size")
    shared = join_sized(each, times, "sub", "size", each.count())
    own = Window.partitionBy("node")
    rank = F.row_number().over(own.orderBy("size", "sub")) + F.col("n") - F.count("*").over(own)
    listed = shared.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("sub", "node", "comp")
    listed = written(listed, "listed")
    full = listed.groupBy("sub").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sub", "size")
    return join_sized(listed, full, "sub", "size", listed.count())


def links(docs: DataFrame, classes: DataFrame, n_words: int, percent: int) -> DataFrame:
    """(a, b): links between classes' nodes, enough of them to connect all that linked pairs connect."""
    spark = docs.sparkSession
    bands, per = bands_for(percent)
    floor = _estimate_floor(percent, bands * per)
    spread = classes.select(F.explode("keys").alias("key"), "node")
    full = spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(join_sized(spread, full, "key", "size", bands * classes.count()), "buckets")
    held = buckets.count()
    # the member whose buckets hold most company stands at the centre of its group
    company = written(buckets.groupBy("node").agg(F.sum("size").alias("company")), "company")
    nodes = written(classes.join(company.select("node"), "node").select("node", "first_doc", "digest", "keys", "bytes", F.col("n_shingles").alias("n")), "nodes")
    chief = buckets.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("a"), F.count("*").alias("size"))
    star = join_sized(buckets.select("key", F.col("node").alias("b")), written(chief, "chief"), "key", "size", held).where("a <> b")
    signatures = nodes.select("node", F.concat(F.unhex(F.lpad(F.hex("n"), 16, "0")), "bytes").alias("data"))
    first = _verified(star, signatures, _same_signatures(percent, floor))
    asked = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first_doc", "digest"), "node")
    sets = written(_sets(docs, written(asked, "asked"), n_words), "sets", "none")
    found = _verified(first, sets, _same_sets(percent))
    drop_written(spark, sets)
    comps = written(components(found), "components")

    own = written(nodes.join(comps, "node", "left").select("node", "first_doc", "digest", "n", "keys", "bytes", F.coalesce("component", "node").alias("comp")), "own")
    within = buckets.join(own.select("node", "comp"), "node")
    mixed = written(within.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size"), "mixed")
    placed = written(join_sized(within.select("key", "node", "comp"), mixed, "key", "size", held), "placed")
    sets = written(_sets(docs, written(placed.select("node").distinct().join(own, "node").select("node", "first_doc", "digest"), "asked"), n_words), "sets", "none")
    rest = own.select("node", "n", "keys", "bytes").join(sets, "node")
    small = placed.where(F.col("size") <= BLOCK).select("key", F.lit(0).cast("long").alias("sub"), "node", "comp", "size")
    if mixed.where(F.col("size") > BLOCK).isEmpty():
        again = small
    else:
        large = placed.where(F.col("size") > BLOCK).select("node", "comp").distinct()
        again = small.unionByName(_by_rare_shingles(large.join(sets, "node"), percent).select(F.lit(0).cast("long").alias("key"), "sub", "node", "comp", "size"))
    out = found.unionByName(written(_cross_links(again.join(rest, "node"), percent).distinct(), "links"))
    drop_written(spark, sets, placed, own, mixed, comps, buckets, company, nodes)
    return out


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable, itself included), kept (doc_id = component_id).

    Documents whose shingle sets have 100 x intersection >= ``percent`` x union are linked. Texts without words
    have an empty set and link with nothing; shorter texts than ``n_words`` words have one shingle. Rows that
    share a doc_id stand for one document, linked by it whatever their texts; a row without doc_id has no component and is kept.
    Only doc_id and text are read, texts of any length whole; other columns play no part. ``keep`` names columns of ``docs`` to return as well.
    """
    ids = docs.select("doc_id", "text")
    sketch = written(sketches(docs, n_words, percent, keep), "sketches")
    total = sketch.count()
    sets = sketch.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = sets.groupBy("digest").agg(
        F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("bytes").alias("bytes")
    )
    # the numbers stand once the table is written
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    linked = links(ids, classes, n_words, percent).select("a", "b")
    # ids with several texts link these
    h = F.coalesce(F.xxhash64("digest"), F.lit(0))
    several = sketch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi"), F.count("digest").alias("size")).where("lo <> hi")
    several = written(several.select("doc_id", "size"), "several")
    repeated = not several.isEmpty()
    if repeated:
        texts = written(join_sized(sets.select("doc_id", "digest"), several, "doc_id", "size", total).distinct(), "texts")
        shared = written(texts.join(classes.select("digest", "node"), "digest").select("doc_id", "node"), "shared")
        centre = written(shared.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("size")), "centre")
        linked = linked.unionByName(join_sized(shared, centre, "doc_id", "size", total).select("a", F.col("node").alias("b")))
    found = written(components(linked), "components")
    placed = written(classes.join(found, "node", "left").select("digest", "copies", "first_doc", F.coalesce("component", "node").alias("component")), "placed")
    least = written(placed.groupBy("component").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("size")), "least")
    known = written(join_sized(placed, least, "component", "size", total).select("digest", "copies", "component_id"), "known")
    columns = ("doc_id", "n_shingles", *keep)
    out = join_sized(sets.select(*columns, "digest"), known, "digest", "copies", total).select(*columns, "component_id")
    empty = sketch.where("doc_id IS NOT NULL AND digest IS NULL").select(*columns)
    if repeated:  # an empty text goes with the others of its id
        of_id = texts.join(known, "digest").groupBy("doc_id").agg(F.min("component_id").alias("c"))
        empty = empty.join(of_id, "doc_id", "left").select(*columns, F.coalesce("c", "doc_id").alias("component_id"))
    else:
        empty = empty.withColumn("component_id", F.col("doc_id"))
    nameless = sketch.where("doc_id IS NULL").select(*columns, F.lit(None).cast("long").alias("component_id"))
    out = out.unionByName(empty).unionByName(nameless)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), *keep)
