"""Advisory databases over HTTP: compressed JSON endpoints read by a Python data source, one partition for a share of the ids."""

from __future__ import annotations

import gzip
import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ENTRY

#: Entries that a task fetches.
IDS_OF_TASK = 200


def fetch(root: str, endpoint: str, timeout: float = 60) -> bytes:
    """The unpacked body of ``<root>/<endpoint>.json.gz``; any status but 200 is an error."""
    with urllib.request.urlopen(f"{root}/{endpoint}.json.gz", timeout=timeout) as r:
        if r.status != 200:
            raise OSError(f"{endpoint}: status {r.status}")
        return gzip.decompress(r.read())


def has_index(root: str, timeout: float = 60) -> bool:
    """Whether the place serves the layout with an index."""
    try:
        with urllib.request.urlopen(urllib.request.Request(f"{root}/index/modules.json.gz", method="HEAD"), timeout=timeout) as r:
            return r.status == 200
    except urllib.error.URLError:
        return False


class _Ids(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class AdvisoryReader(DataSourceReader):
    def __init__(self, root: str, ids: list[str]):
        self.root, self.ids = root, ids

    def partitions(self) -> list[InputPartition]:
        return [_Ids(self.ids[i : i + IDS_OF_TASK]) for i in range(0, len(self.ids), IDS_OF_TASK)] or [_Ids([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in partition.ids:  # type: ignore[attr-defined]
            yield i, fetch(self.root, f"ID/{i}").decode()


class AdvisorySource(DataSource):
    """``spark.read.format("advisories_http").option("root", url)``: (id, json) of each entry that the index names."""

    @classmethod
    def name(cls) -> str:
        return "advisories_http"

    def schema(self) -> str:
        return "id string, json string"

    def reader(self, schema) -> DataSourceReader:
        root = self.options["root"]
        if not has_index(root):
            raise ValueError(f"no advisory index at {root}")
        modules = json.loads(fetch(root, "index/modules"))
        return AdvisoryReader(root, sorted({v["id"] for m in modules for v in m.get("vulns") or ()}))


def read_http(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(AdvisorySource)
    raw = spark.read.format("advisories_http").option("root", root).load()
    return raw.select(F.from_json("json", ENTRY).alias("e")).select("e.*")
