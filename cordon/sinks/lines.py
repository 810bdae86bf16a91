"""Documents as ordered lines: built, sorted and written by executors, so a document's size is bounded by storage only.

A document is a table (section int, n long, m string, line string) whose lines in the order of the first three columns are its text. Several rows
with equal places come in the order of their lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import written

ORDER = ("section", "n", "m", "line")


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with their number (``n``, from 0) in an order, without a window over all rows: range partitions, counted, and a prefix sum over their counts.

    The rows are written once with their places, as a recomputed range partition may be cut elsewhere. The sum has one row for each partition.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    rows = placed.select("*", F.shiftright("__id", 33).alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__at")).drop("__id")
    counts = rows.groupBy("__part").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__part").withColumn("n", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def fixed(spark: SparkSession, section: int, line: str) -> DataFrame:
    """One line of a section."""
    return spark.range(1).select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("n"), F.lit("").alias("m"), F.lit(line).alias("line"))


def elements(section: int, rows: DataFrame) -> DataFrame:
    """Lines of a JSON list's elements (n, line): all but the first begin with a comma."""
    return rows.select(F.lit(section).alias("section"), "n", F.lit("").alias("m"), F.concat(F.when(F.col("n") == 0, "").otherwise(","), "line").alias("line"))


def joined(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def write_document(lines: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Write a document as text files of a folder that, one after another by their part numbers, are the document.

    Spark's own commit applies: a lost executor's files are written again, and a failed write leaves none.
    """
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges go by the place alone: their bounds come from a sample that the driver holds, and a line may be megabytes
    lines.repartitionByRange(n, *ORDER[:3]).sortWithinPartitions(*ORDER).select("line").write.text(folder)


def text_of(lines: DataFrame) -> str:
    """A small document as a string: what ``write_document`` writes. A large one belongs in files."""
    return "".join(f"{r[0]}\n" for r in lines.orderBy(*ORDER).select("line").toLocalIterator())
