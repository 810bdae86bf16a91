"""What each of five filters removes, in every order: a relational word pipeline.

Words are exploded, counted for each (row, word), then for each row into totals and distinct words; the other filters' flags are outer-joined, and
32 conditional counts, one for each set of failed filters, answer all 120 orders for a part of the corpus.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_sized, written

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
WHITE = "\t\n\x0b\x0c\r"


def word_counts(rows: DataFrame) -> DataFrame:
    """(row, total, n_distinct) for every row (row, text) that has words: maximal runs of other characters than U+0020 and U+0009 to U+000D.

    Texts move once, to where their row belongs; (row, word) and row are then counted there, without another shuffle.
    """
    words = rows.repartition("row").select("row", F.explode(F.split(F.translate("text", WHITE, " " * len(WHITE)), " ")).alias("word")).where("word <> ''")
    each = words.groupBy("row", "word").agg(F.count("*").alias("n"))
    return each.groupBy("row").agg(F.sum("n").alias("total"), F.count("*").alias("n_distinct"))


def repeated(rows: DataFrame, total: int) -> DataFrame:
    """(row) of the rows (row, doc_id, digest) whose digest also stands under a smaller doc_id."""
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most")
    return join_sized(rows, least.select("digest", "least", "n"), "digest", "n", total).where("doc_id > least").select("row")


def _flags(text: Column) -> tuple[Column, Column]:
    """Failures of C and D."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]")


def failures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, part, failed) of each row; bit k of ``failed`` is set if filter k of ABCDE fails.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * A-Z > 10 * code points; D: holds one of ``#$%&*|``; E: a smaller doc_id has the same
    text. ``part`` is lang, null as the empty string. Null texts count as empty; an empty text has no words, so it fails A but not B. A row without doc_id is neither smaller
    nor larger than another; rows that share a doc_id and text don't repeat each other. Words are case-sensitive.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    capitals, signs = _flags(F.col("text"))
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    # written, so that both branches see the same row numbers
    rows = written(source.withColumns({"digest": F.unhex(F.sha2("text", 256)), "c": capitals, "d": signs}), "rows")
    others = rows.select("row", "doc_id", "part", "digest", "c", "d")
    copies = repeated(others.select("row", "doc_id", "digest"), others.count()).withColumn("e", F.lit(True))
    all_flags = others.drop("digest").join(word_counts(rows.select("row", "text")), "row", "left").join(copies, "row", "left")
    total, distinct = F.coalesce("total", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    failed = [total < 100, 100 * distinct < 80 * total, F.col("c"), F.col("d"), F.coalesce("e", F.lit(False))]
    return all_flags.select("doc_id", "part", sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0)).alias("failed"))


def counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part: the 32 conditional counts of documents n0 to n31, of good ones g0 to g31 and of toxic ones t0 to t31.

    Counts are added up for each (doc_id, part, failed) before they meet the labels. A document with several label rows is good or toxic if one says so.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    each = failed.groupBy("doc_id", "part", "failed").agg(F.count("*").alias("n")).join(marks.where("doc_id IS NOT NULL"), "doc_id", "left")
    kinds = {"n": F.lit(True), "g": F.coalesce(F.col("good") == 1, F.lit(False)), "t": F.coalesce(F.col("toxic") == 1, F.lit(False))}
    return each.groupBy("part").agg(*[F.coalesce(F.sum(F.when((F.col("failed") == m) & own, F.col("n"))), F.lit(0)).alias(f"{k}{m}") for k, own in kinds.items() for m in range(SETS)])


def orders(table: DataFrame) -> DataFrame:
    """600 rows for each part: what each step of each order keeps, removes and wastes; see ``audit``."""
    arrays = table.select("part", *[F.array(*[F.col(f"{k}{m}") for m in range(SETS)]).alias(k) for k in "ngt"])
    steps = arrays.select("*", F.explode(F.lit(["".join(p) for p in permutations(FILTERS)])).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda at: F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {at}, 1)) - 1)")
    earlier = [F.when(F.lit(k) < F.col("step"), bit(k)).otherwise(F.lit(0)) for k in range(1, len(FILTERS))]
    rows = steps.withColumns({"own": bit("step"), "before": sum(earlier, F.lit(0))})

    def over(counted: str, weight) -> Column:
        """Sum over the sets of failed filters of their count, times the weight of a set."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(SETS - 1)), F.lit(0).cast("long"), lambda acc, m: acc + F.get(F.col(counted), m) * weight(m).cast("long"))

    own, before = F.col("own"), F.col("before")
    failing = lambda m: m.bitwiseAND(own) != 0
    first = lambda m: failing(m) & (m.bitwiseAND(before) == 0)
    return rows.select(
        "part",
        "filter_order",
        "step",
        over("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        over("n", first).alias("removed"),
        over("n", lambda m: failing(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        F.get("n", own).alias("unique_fails"),
        over("g", first).alias("good_lost"),
        over("t", first).alias("toxic_lost"),
        # of the orders of five, each failed filter of a set comes first in an equal share
        over("n", lambda m: F.when(failing(m), F.floor(F.lit(len(list(permutations(FILTERS)))) / F.greatest(F.bit_count(m), F.lit(1)))).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row for each part, order of the five filters and step.

    kept: documents that pass this and all earlier steps; removed: that fail here first; redundant: that fail this filter and were removed earlier; unique_fails: that
    fail this filter only; good_lost, toxic_lost: removed here and labelled so; shapley: the filter's removed, summed over all orders. See ``failures`` for nulls, empty texts and repeated
    rows. A part without documents has no rows; an empty table none at all. Extra columns are ignored.
    """
    return orders(counts(failures(docs, text), labels))
