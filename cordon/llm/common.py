"""What the operators share: the shared folder, written tables, shipping of this package."""

from __future__ import annotations

import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cordon/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later result reads."""
    for df in frames:
        for f in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_cordon_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="cordon-ship-"), "cordon_package.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    sc._cordon_shipped = True


def slices(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """Batches cut into smaller ones, so that a worker turns few texts into Python objects at a time; after the last one memory is given back."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
    release()


#: A key with more rows than this, and than one in ``HOT_SHARE`` of all, is hot.
HOT_ROWS, HOT_SHARE = 100, 10_000


def join_sized(rows: DataFrame, side: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``side``, which has one row for each key and in ``size`` how many of ``rows`` have it; ``total`` is their sum or more.

    Keys with more than ``HOT_ROWS`` rows and one in ``HOT_SHARE`` of all are met by a broadcast, as there are ``HOT_SHARE`` (or a hundredth of
    the rows, if that is less) of them at most; the others by a shuffle, in which no key is hot. Both sides are read more than once.
    """
    hot = side.where(F.col(size) > max(HOT_ROWS, total // HOT_SHARE))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(side, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def release() -> None:
    """Give freed memory back at the end of a task: Python workers outlive it, and what they keep counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c):
    """A-Z to a-z, all other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
