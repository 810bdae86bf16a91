"""Keyed state over message streams: the most precise findings as a log of changes, and findings joined with entries that come in any order.

Both keep their state in the state store, so a restart from the checkpoint goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..schema import ENTRY, FINDING

CHANGES = "osv string, action string, level int, finding string"
PAIRS = "osv string, finding string, entry string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def list_states(spark: SparkSession) -> Iterator[None]:
    """The state store that holds typed and list states, for queries started inside; a query keeps the one that it was started with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Best(StatefulProcessor):
    """One level for each entry; no finding is held, however many an entry has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.level.get()[0] if self.level.exists() else 0
        for part in rows:
            most = int(part["level"].max())
            if most > now:
                if now:
                    yield pd.DataFrame({"osv": [key[0]], "action": ["retract"], "level": [now], "finding": [None]})
                now = most
                self.level.update((now,))
            stands = part[part["level"] == now]
            yield pd.DataFrame({"osv": key[0], "action": "add", "level": stands["level"].astype("int32"), "finding": stands["finding"]})

    def close(self) -> None:
        pass


def precise_changes(findings: DataFrame) -> DataFrame:
    """(osv, action, level, finding) of a stream of findings (osv, fixed_version, trace): ``add`` for each finding of its entry's highest level so far, ``retract`` when a
    higher one comes, which voids all that was added up to the level that it names. Less precise findings than before give nothing. ``finding`` is JSON."""
    rows = findings.select("osv", T.level_of(F.get("trace", F.lit(0))).cast("int").alias("level"), F.to_json(F.struct("osv", "fixed_version", "trace")).alias("finding"))
    return rows.groupBy("osv").transformWithStateInPandas(statefulProcessor=_Best(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def standing(changes: DataFrame) -> DataFrame:
    """What the changes leave, in whatever order they lie: (osv, level, fixed_version, trace)."""
    gone = changes.where("action = 'retract'").groupBy("osv").agg(F.max("level").alias("gone"))
    left = changes.where("action = 'add'").join(gone, "osv", "left").where("gone IS NULL OR level > gone")
    return left.select("level", F.from_json("finding", FINDING).alias("f")).select("f.osv", "level", "f.fixed_version", "f.trace")


class _Meet(StatefulProcessor):
    """An entry, once it has come, and until then the findings that wait for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "entry string")
        self.waiting = handle.getListState("waiting", "finding string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.entry.get()[0] if self.entry.exists() else None
        for part in rows:
            came = part["entry"].dropna()
            if len(came) and known is None:
                # the first one stands
                known = came.iloc[0]
                self.entry.update((known,))
                if self.waiting.exists():
                    yield pd.DataFrame({"osv": key[0], "finding": [w[0] for w in self.waiting.get()], "entry": known})
                    self.waiting.clear()
            found = part["finding"].dropna()
            if known is None:
                for f in found:
                    self.waiting.appendValue((f,))
            elif len(found):
                yield pd.DataFrame({"osv": key[0], "finding": found, "entry": known})

    def close(self) -> None:
        pass


def meetings(messages: DataFrame) -> DataFrame:
    """(osv, finding, entry), both JSON, of a stream of messages: a row for each finding as soon as its entry is known, whichever comes first. ``unmet`` gives the rest at the end of the input."""
    rows = messages.where("osv IS NOT NULL OR finding IS NOT NULL").select(F.coalesce("osv.id", "finding.osv").alias("id"), F.to_json("finding").alias("finding"), F.to_json("osv").alias("entry"))
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=_Meet(), outputStructType=PAIRS, outputMode="Append", timeMode="None")


def unmet(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(osv, finding, entry) of findings that still wait when a ``meetings`` query has stopped, with the default entry: only its id."""
    held = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", True).load(checkpoint)
    default = F.to_json(F.struct(F.col("key.id").alias("id")))
    return held.select(F.col("key.id").alias("osv"), F.col("list_element.finding").alias("finding"), default.alias("entry"))


def paired(pairs: DataFrame) -> DataFrame:
    """(osv, fixed_version, trace, entry) with the parsed columns."""
    return pairs.select(F.from_json("finding", FINDING).alias("f"), F.from_json("entry", ENTRY).alias("entry")).select("f.*", "entry")
