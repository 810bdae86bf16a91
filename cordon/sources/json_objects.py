"""JSON objects of files of any size and layout, read by many tasks.

Files are read in pieces that end at a closing brace, which Spark's text reader splits at any place. What a piece does to the reader's state (in a string or
not, and the depth) is known for both states that it may start in; pieces add up to blocks, blocks to files, so every piece learns where it starts without any
task reading a whole file. Pieces move only to the object that they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import written


def _opened(segments: Column, odd: int) -> Column:
    """How many brackets more are opened than closed outside strings, where these are the segments between quotes of that parity; closing braces end pieces."""
    s = F.array_join(F.filter(segments, lambda _, i: i % 2 == odd), "")
    return F.length(F.translate(s, "]", "")) - F.length(F.translate(s, "{[", ""))


def json_objects(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """(file, ordinal, json) of the objects that stand one after another in each file, or, with ``array``, of those in its one array, from 0 in their order.

    Any white space and line breaks may stand in and between them. Text after the last object that is more than white space and the array's end is an error when it is read;
    a file that ends just before its last brace is read as if it had it. A file without objects has no rows.
    """
    raw = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece")
    )
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"', -1)
    pieces = written(raw.withColumns({"turn": (F.size(parts) - 1) % 2, "o0": _opened(parts, 0), "o1": _opened(parts, 1)}), "pieces")
    # in a string, the brace at the end closes nothing
    closes = lambda turned: F.when(F.col("turn") == turned, 1).otherwise(0)
    narrow = pieces.select("file", "block", "at", "turn", (F.col("o0") - closes(0)).alias("d0"), (F.col("o1") - closes(1)).alias("d1"))
    own = Window.partitionBy("file", "block").orderBy("at")
    upto, prior = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    run = narrow.withColumn("q", F.coalesce(F.sum("turn").over(prior), F.lit(0)) % 2)
    run = run.withColumns({f"e{s}": F.sum(F.when(F.col("q") == s, F.col("d0")).otherwise(F.col("d1"))).over(upto) for s in (0, 1)})
    run = written(run.select("file", "block", "at", "turn", "q", "e0", "e1"), "runs")
    # a row for each block that the reader makes of a file
    blocks = run.groupBy("file", "block").agg((F.sum("turn") % 2).alias("turns"), F.max_by("e0", "at").alias("b0"), F.max_by("e1", "at").alias("b1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("s", F.coalesce(F.sum("turns").over(earlier), F.lit(0)) % 2)
    starts = starts.withColumn("depth", F.coalesce(F.sum(F.when(F.col("s") == 0, F.col("b0")).otherwise(F.col("b1"))).over(earlier), F.lit(0)))
    ends = run.join(starts.select("file", "block", "s", "depth"), ["file", "block"]).select(
        "file", "block", "at",
        ((F.col("q") + F.col("s") + F.col("turn")) % 2 == 0) & (F.col("depth") + F.when(F.col("s") == 0, F.col("e0")).otherwise(F.col("e1")) == int(array)),
    ).toDF("file", "block", "at", "whole")
    ends = written(ends, "ends")
    counts = ends.groupBy("file", "block").agg(F.count_if("whole").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum(F.col("whole").cast("int")).over(prior), F.lit(0))
    placed = ends.withColumn("k", inside).join(counts, ["file", "block"]).select("at", "whole", (F.col("k") + F.col("before")).alias("ordinal"))
    # a group is one object
    lists = pieces.select("file", "block", "at", "piece").join(placed, "at").groupBy("file", "ordinal").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "piece"))).alias("parts"), F.max("whole").alias("whole")
    )
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["piece"]), "}"), r"\A[\s,\[]+" if array else r"\A\s+", "")
    rows = lists.select("file", F.col("ordinal").cast("int").alias("ordinal"), "whole", text.alias("text"))
    left = rows.where(F.col("whole") | ~F.col("text").rlike(r"\A[\s\]]*\z" if array else r"\A\s*\z"))
    return left.select("file", "ordinal", F.when(F.col("whole"), F.concat("text", F.lit("}"))).otherwise(F.raise_error(F.concat(F.lit("text after the last object of "), F.col("file")))).alias("json"))
