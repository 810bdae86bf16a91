"""Sharding by a k-d tree over metadata, with DataFrame functions alone.

A node that must give m shards is split along its widest dimension (relative to that dimension's width in the whole table) where the bytes
reach the share of m // 2 of them: a weighted median. All nodes of a level are split at once. Medians are found by histograms: the
bytes of at most ``BINS`` bins between a node's bounds are summed (with partial sums before the shuffle), the bin in which the share is reached becomes the
next bounds, and once it holds few rows these are put in order. Rows that share a value go on by their text's digest, then their id, then
their place, so no tie, however large, is left whole or out. Neither texts nor rows move; the tree is one row for each node.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, new_path, written

#: Bins of a histogram pass; rows of a bin that one window puts in order.
BINS, ORDERED = 4096, 20_000
#: Coordinates beyond it, and missing ones below, stand at this bound.
BOUND = 1 << 61
KEYS = ("__coordinate", "__digest", "__id", "__row")


def coordinate(field: T.StructField) -> Column:
    """A column's values as whole numbers of the same order: strings by their first seven bytes, null before all."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.conv(F.rpad(F.substring(F.hex(c), 1, 14), 14, "0"), 16, 10).cast("long"), F.lit(-1))
    if isinstance(field.dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.BooleanType):
        number = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), c.cast("long")))
    else:  # clamped first, as a double may hold more than a long
        number = F.floor(F.greatest(F.lit(float(-BOUND)), F.least(F.lit(float(BOUND)), F.nanvl(c.cast("double"), F.lit(0.0)))))
    return F.when(c.isNotNull(), number).otherwise(F.lit(-BOUND))


def keyed(docs: DataFrame, dims: tuple[str, ...], text: str = "text", id_col: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """``docs``' columns (or ``keep`` of them) with size, coordinates and keys, as a table in the shared folder, so that every pass sees the same rows."""
    fields = {f.name: f for f in docs.schema.fields}
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [F.col(f"`{c}`") for c in docs.columns] if keep is None else [v.alias(k) for k, v in keep.items()]
    return written(
        docs.select(
            *own,
            (F.octet_length(whole) + F.lit(1)).cast("long").alias("__size"),
            F.array(*[coordinate(fields[d]) for d in dims]).alias("__at"),
            F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long").alias("__digest"),
            coordinate(fields[id_col]).alias("__id"),
            F.monotonically_increasing_id().alias("__row"),
            F.lit(0).alias("__node"),
        ),
        "keyed",
    )


def _frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A row for each node of a level: as many as there are shards at most. They travel as one literal, as rows of Python objects would need a Python worker."""
    fields = T._parse_datatype_string(schema).fields
    text = json.dumps([{f.name: r[f.name] for f in fields} for r in rows])
    kinds = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields)
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds}>>"))))


def _level(nodes: dict[int, int], rows: DataFrame, wide: list[int], k: int) -> list[dict]:
    """The level's nodes with bytes, dimension and bounds; one that holds no row is left out, as its shards stay empty."""
    at = [F.col("__at")[j] for j in range(k)]
    got = rows.groupBy("__node").agg(F.sum("__size").alias("total"), *[f(a).alias(f"{n}{j}") for j, a in enumerate(at) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    out = []
    for r in got:
        m = nodes[r["__node"]]
        if m > 1:
            share = [(r[f"hi{j}"] - r[f"lo{j}"]) / max(1, wide[j]) for j in range(k)]
            d = share.index(max(share))
            row = {"__node": r["__node"], "dim": d, "target": r["total"] * (m // 2) // m, "base": 0, "stage": 0, "lo": r[f"lo{d}"], "hi": r[f"hi{d}"]}
            out.append(row | {"p0": 0, "p1": 0, "p2": 0})
    return out


_STATE = "__node int, dim int, target long, base long, stage int, lo long, hi long, p0 long, p1 long, p2 long"
_SPLIT = "__node int, dim int, t0 long, t1 long, t2 long, t3 long, keeps boolean, right int"


def _within(rows: DataFrame, states: list[dict]) -> DataFrame:
    """The rows between their node's bounds, with the key of the node's stage as ``key``."""
    s = _frame(rows.sparkSession, states, _STATE)
    own = rows.join(s, "__node").withColumn("__coordinate", F.element_at("__at", F.col("dim") + 1))
    for j in range(3):
        own = own.where((F.col("stage") <= j) | (F.col(KEYS[j]) == F.col(f"p{j}")))
    key = F.when(F.col("stage") == 0, F.col(KEYS[0])).when(F.col("stage") == 1, F.col(KEYS[1])).when(F.col("stage") == 2, F.col(KEYS[2])).otherwise(F.col(KEYS[3]))
    return own.withColumn("key", key).where(F.col("key").between(F.col("lo"), F.col("hi")))


def _narrow(rows: DataFrame, states: list[dict]) -> tuple[list[dict], list[dict]]:
    """(states that need another pass, states whose rows are few): each with the bounds of the bin in which the node reaches its share."""
    bins = _within(rows, states).withColumn("bin", F.expr(f"(key - lo) div ((hi - lo) div {BINS} + 1)"))
    sums = bins.groupBy("__node", "target", "base", "bin").agg(F.sum("__size").alias("w"), F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
    # a node has BINS rows here at most
    run = sums.withColumn("upto", F.sum("w").over(Window.partitionBy("__node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) + F.col("base"))
    cross = run.where("upto > target AND upto - w <= target").select("__node", "n", "least", "most", (F.col("upto") - F.col("w")).alias("start")).collect()
    state = {s["__node"]: s for s in states}
    again, few = [], []
    for r in cross:
        s = state[r["__node"]] | {"base": r.start, "lo": r.least, "hi": r.most}
        if r.n <= ORDERED:
            few.append(s)
        elif r.least < r.most or s["stage"] == 3:
            again.append(s)
        else:  # one value for many rows: go on by the next key
            again.append(s | {f"p{s['stage']}": r.least, "stage": s["stage"] + 1, "lo": -BOUND, "hi": (1 << 63) - 1 - BOUND})
    return again, few


def _cut(rows: DataFrame, few: list[dict], nodes: dict[int, int]) -> list[dict]:
    """The row at which each node reaches its share, of the few that are left, and whether it belongs to the first part: if at least half of it does."""
    order = Window.partitionBy("__node").orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, 0)
    run = _within(rows, few).withColumn("upto", F.sum("__size").over(order) + F.col("base"))
    at = run.where((F.col("upto") > F.col("target")) & (F.col("upto") - F.col("__size") <= F.col("target")))
    got = at.select("__node", "dim", *[F.col(k).alias(f"t{j}") for j, k in enumerate(KEYS)], (2 * F.col("upto") - F.col("__size") <= 2 * F.col("target")).alias("keeps")).collect()
    return [r.asDict() | {"right": r["__node"] + nodes[r["__node"]] // 2} for r in got]


def _step(rows: DataFrame, splits: list[dict]) -> DataFrame:
    """``rows`` moved from ``__node`` to the half of it that they belong to."""
    if not splits:
        return rows
    s = _frame(rows.sparkSession, splits, _SPLIT)
    mine = F.struct(F.element_at("__at", F.col("dim") + 1), *[F.col(k) for k in KEYS[1:]])
    cut = F.struct("t0", "t1", "t2", "t3")
    node = F.when(F.col("dim").isNull() | (mine < cut) | (F.col("keeps") & (mine == cut)), F.col("__node")).otherwise(F.col("right"))
    return rows.join(s, "__node", "left").withColumn("__to", node).drop("__node", *s.columns[1:]).withColumnRenamed("__to", "__node")


def tree(rows: DataFrame, shards: int) -> list[list[dict]]:
    """The splits of each level for ``keyed`` rows. A node is named by its first shard."""
    nodes, levels = {0: shards}, []
    rows = rows.select("__size", "__at", "__node", *KEYS[1:])
    k = rows.select(F.max(F.size("__at"))).first()[0]
    if k is None:
        return []
    whole = rows.agg(*[(F.max(F.col("__at")[j]) - F.min(F.col("__at")[j])).alias(f"w{j}") for j in range(k)]).first()
    while max(nodes.values()) > 1:
        states, few = _level(nodes, rows, list(whole), k), []
        while states:
            states, done = _narrow(rows, states)
            few += done
        levels.append(_cut(rows, few, nodes) if few else [])
        rows = _step(rows, levels[-1])
        nodes = {a: b for n, m in nodes.items() for a, b in ([(n, m // 2), (n + m // 2, m - m // 2)] if m > 1 else [(n, m)])}
    return levels


def route(rows: DataFrame, levels: list[list[dict]]) -> DataFrame:
    """``keyed`` rows with the shard that the tree gives them: one broadcast join with a level's nodes after another, and no shuffle."""
    for splits in levels:
        rows = _step(rows, splits)
    return rows.withColumnRenamed("__node", "shard")


def _slotted(routed: DataFrame) -> DataFrame:
    """With slot: the row's number in its shard by id, then place. A range of rows is numbered in itself, and starts where those before it end."""
    ranges = written(routed.repartitionByRange("shard", "__id", "__row").withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("shard", "__part").agg(F.count("*").alias("n"))
    # one row for each part that the shard has
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("shard", "__part").orderBy("__id", "__row")
    numbered = ranges.withColumn("__k", F.row_number().over(own) - 1).join(start, ["shard", "__part"])
    return numbered.withColumn("slot", (F.col("__start") + F.col("__k")).cast("long")).drop("__part", "__start", "__k")


def _shards(rows: DataFrame, shards: int | None, target_bytes: int | None) -> int:
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either the number of shards or their bytes")
    if shards is None:
        total = rows.agg(F.sum("__size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    if shards < 1:
        raise ValueError("at least one shard")
    return shards


def assign(
    docs: DataFrame, shards: int | None = None, dims: tuple[str, ...] = ("n_chars", "lang", "source"), keep: dict[str, Column] | None = None,
    target_bytes: int | None = None, text: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """Columns ``keep`` (names and expressions; by default the id), size, shard and slot of each row; shards hold nearly equal bytes.

    ``size`` is the text's UTF-8 bytes plus one, null counting as none. Give the number of ``shards``, or ``target_bytes`` for as many as it takes.
    Splits are made between rows, so a shard differs from an equal share by no more than a row at each of its levels. Equal texts with equal metadata stand side
    by side, so they share a shard unless it ends among them. Null metadata come before all others; rows without id before the others of a slot order; repeated rows
    are rows of their own. With fewer rows than shards some shards are empty; an empty table has no rows. ``docs`` may have any other columns; names
    beginning with two underscores are taken.
    """
    rows = keyed(docs, dims, text, id_col, keep or {id_col: F.col(f"`{id_col}`")})
    levels = tree(rows, _shards(rows, shards, target_bytes))
    names = list(keep or {id_col: None})
    return _slotted(route(rows, levels).drop("__at", "__digest")).select(*names, F.col("__size").alias("size"), "shard", "slot")


def write_shards(docs: DataFrame, path: str | None = None, shards: int | None = None, dims: tuple[str, ...] = ("n_chars", "lang", "source"), target_bytes: int | None = None, text: str = "text", id_col: str = "doc_id") -> str:
    """Write whole rows as Parquet under ``path``/shard=N, in the order of their slots over a shard's files; returns the path.

    The table is numbered once in the shared folder; tree passes read its keys alone, and rows move in one shuffle, to their place.
    """
    rows = keyed(docs, dims, text, id_col)
    levels = tree(rows, _shards(rows, shards, target_bytes))
    path = path or new_path(docs.sparkSession, "shards")
    placed = route(rows, levels).repartitionByRange("shard", "__id", "__row").sortWithinPartitions("shard", "__id", "__row")
    placed.select(*docs.columns, "shard").write.partitionBy("shard").parquet(path)
    drop_written(docs.sparkSession, rows)
    return path
