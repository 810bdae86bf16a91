"""Saved message streams and binary abstractions as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BINARY_DDL, MESSAGE
from .json_objects import json_objects


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, config, progress, SBOM, osv, finding) of files that hold messages one after another, in any layout; a large file is read by many tasks."""
    rows = json_objects(spark, path)
    return rows.select("file", "ordinal", F.from_json("json", MESSAGE, {"mode": "FAILFAST"}).alias("m")).select("file", "ordinal", "m.*")


def read_message_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The same messages, one on each line: splittable, and readable as a stream."""
    return (spark.readStream if streaming else spark.read).schema(MESSAGE).json(path)


def read_blob(spark: SparkSession, path: str, name: str, version: str) -> DataFrame:
    """The body of a binary abstraction: two JSON lines, a header that must be exactly (name, version), then the body.

    Anything else is an error when it is read.
    """
    whole = spark.read.text(path, wholetext=True)
    if whole.isEmpty():
        raise ValueError("not a binary abstraction: the file is empty")
    lines = whole.select(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    header = F.from_json(F.get("lines", F.lit(0)), "name string, version string")
    right = (F.size("lines") == 2) & F.coalesce((header["name"] == name) & (header["version"] == version), F.lit(False))
    body = F.from_json(F.get("lines", F.lit(1)), BINARY_DDL)
    checked = F.when(right & body.isNotNull(), body).otherwise(F.raise_error(F.lit("not a binary abstraction of this version")))
    return lines.select(checked.alias("b")).select("b.*")


def write_blob(body: DataFrame, path: str, name: str, version: str) -> None:
    """Header line and body line, symbols sorted by ``pkg.name``; body has one row."""
    order = F.array_sort("pkgSymbols", lambda a, b: F.when(F.concat_ws(".", a["pkg"], a["name"]) < F.concat_ws(".", b["pkg"], b["name"]), -1).otherwise(1))
    header = F.to_json(F.struct(F.lit(name).alias("name"), F.lit(version).alias("version")))
    body.withColumn("pkgSymbols", order).select(F.concat_ws("\n", header, F.to_json(F.struct("*"))).alias("value")).coalesce(1).write.text(path)


def setting(settings, name: str):
    """The first value of a build setting, or the empty string. ``settings`` is array<struct<key,value>>."""
    return F.coalesce(F.get(F.filter(settings, lambda s: s["key"] == name), F.lit(0))["value"], F.lit(""))
