"""Message streams: the most precise findings so far, kept per entry, and rendering when the input is exhausted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def findings_of(messages: DataFrame) -> DataFrame:
    """The findings among messages (batch or stream): (osv, fixed_version, trace)."""
    return messages.where("finding IS NOT NULL").select("finding.*")


def entries_of(messages: DataFrame) -> DataFrame:
    return messages.where("osv IS NOT NULL").select("osv.*")


def best_levels(findings: DataFrame) -> DataFrame:
    """(osv, level, n) by entry: the highest level so far, and how many findings have it.

    A streaming aggregation for the update mode; its state is three counters for each entry, no findings.
    """
    level = T.level_of(F.get("trace", F.lit(0)))
    counts = findings.groupBy("osv").agg(*[F.count_if(level == k).alias(f"n{k}") for k in (1, 2, 3)])
    best = F.when(F.col("n3") > 0, 3).when(F.col("n2") > 0, 2).otherwise(1)
    n = F.when(F.col("n3") > 0, F.col("n3")).when(F.col("n2") > 0, F.col("n2")).otherwise(F.col("n1"))
    return counts.select("osv", best.alias("level"), n.alias("n"))


def run_once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Consume what is there, hand each batch to ``write``, and stop: the flush at the end of the input."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
