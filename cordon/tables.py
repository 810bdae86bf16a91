"""Tables written to the folder that all executors share: they cut the lineage of iterative jobs and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where a local session names none, a new folder, which the executors of a cluster would not see."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cordon-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins by key that shuffle and sort, whatever its estimate: Catalyst takes a file's size for that of its rows, which may be fifty times as large, and a broadcast
    holds them in the driver and in every executor."""
    return df.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/cordon/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
