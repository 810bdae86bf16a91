"""Addresses of programs against tables of functions and line steps: as-of joins over ranges of addresses.

Tables: ``functions`` (program, fn_id, start, stop: the half-open range of its code; ranges of one program don't overlap), ``steps`` (program,
start, file, line: what holds from that address on, up to the next step of the same function), ``asked`` (program, address, or program, file, line).
Addresses are longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Addresses (as a power of two) that one task's window runs over; the last value before a range comes from a prefix scan over ranges.
SPAN = 16


def _last(rows: DataFrame, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (program, at, rank, columns, keep) of rank 1 with each column's last non-null value at or before the row: within its range, else that of the nearest range before.

    Of rows with the same place and rank the greatest counts. The window over ranges has one row for each range that holds anything of a program, so no task sees a program's own rows.
    """
    placed = rows.withColumn("span", F.shiftright("at", SPAN))
    within = Window.partitionBy("program", "span").orderBy("at", "rank", *columns).rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.groupBy("program", "span").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("at", "rank", c)))[c].alias(c) for c in columns])
    before = Window.partitionBy("program").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("program", "span", *[F.last(c, ignorenulls=True).over(before).alias(f"{c}_carried") for c in columns])
    held = placed.select("program", "at", "rank", "span", *keep, *[F.last(c, ignorenulls=True).over(within).alias(c) for c in columns])
    return held.where("rank = 1").join(carried, ["program", "span"]).select("program", "at", *keep, *[F.coalesce(c, f"{c}_carried").alias(c) for c in columns])


def _known(table: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Rows of ``_last`` for a table (program, start, columns): a struct of it under ``name``."""
    return table.where("start IS NOT NULL").select("program", F.col("start").alias("at"), F.lit(0).alias("rank"), F.struct("start", *columns).alias(name))


def _as_of(asked: DataFrame, **known: tuple[DataFrame, list[str]]) -> DataFrame:
    """Distinct (program, at) with a struct for each table (program, start, columns) of ``known``, under its name: its last row that starts at or before.

    Of rows with the same start the greatest counts. A null address meets nothing. All tables are met in one pass, so that each row is shuffled for it once.
    """
    rows = asked.where("at IS NOT NULL").select("program", "at").distinct().withColumn("rank", F.lit(1))
    for name, (table, columns) in known.items():
        rows = rows.unionByName(_known(table, name, columns), allowMissingColumns=True)
    return _last(rows, *known)


def functions_at(asked: DataFrame, functions: DataFrame) -> DataFrame:
    """``asked`` (program, address, ...) with ``fn_id`` of the function whose range holds the address; null where none does, or the address is null."""
    a = asked.select("program", F.col("address").alias("at"))
    held = _as_of(a, held=(functions.where("start < stop"), ["stop", "fn_id"]))
    found = held.where("at < held.stop").select("program", F.col("at").alias("address"), F.col("held.fn_id").alias("fn_id"))
    return asked.join(found, ["program", "address"], "left")


def lines_at(asked: DataFrame, functions: DataFrame, steps: DataFrame) -> DataFrame:
    """``asked`` (program, address, ...) with fn_id, file and line; file and line are null in a function without a step at or before the address."""
    a = asked.select("program", F.col("address").alias("at"))
    held = _as_of(a, held=(functions.where("start < stop"), ["stop", "fn_id"]), step=(steps, ["file", "line"])).where("at < held.stop")
    own = F.col("step.start") >= F.col("held.start")
    found = held.select(
        "program", F.col("at").alias("address"), F.col("held.fn_id").alias("fn_id"), F.when(own, F.col("step.file")).alias("file"), F.when(own, F.col("step.line")).alias("line")
    )
    return asked.join(found, ["program", "address"], "left")


def addresses_of(asked: DataFrame, functions: DataFrame, steps: DataFrame) -> DataFrame:
    """``asked`` (program, file, line, ...) with the least ``address`` at which that line of that file begins, its ``fn_id``, and ``error``.

    ``error`` is ``unknown file`` or ``unknown line`` where there is no address, else null. Steps outside all functions don't count.
    """
    # steps go through the window themselves, so they need not be joined to what they met
    own = steps.where("start IS NOT NULL").select("program", F.col("start").alias("at"), F.lit(1).alias("rank"), F.struct("file", "line").alias("step"))
    held = _last(own.unionByName(_known(functions.where("start < stop"), "held", ["stop", "fn_id"]), allowMissingColumns=True), "held", keep=("step",))
    at = held.where("at < held.stop AND held.fn_id IS NOT NULL").select("program", F.col("at").alias("address"), F.col("held.fn_id").alias("fn_id"), "step.file", "step.line")
    placed = written(at.groupBy("program", "file", "line").agg(F.min(F.struct("address", "fn_id")).alias("first")), "line-starts")
    files = placed.select("program", "file").distinct().withColumn("known", F.lit(True))
    out = asked.join(placed, ["program", "file", "line"], "left").join(files, ["program", "file"], "left")
    error = F.when(F.col("known").isNull(), "unknown file").when(F.col("first").isNull(), "unknown line")
    return out.select(*asked.columns, F.col("first.address").alias("address"), F.col("first.fn_id").alias("fn_id"), error.alias("error"))
