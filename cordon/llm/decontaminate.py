"""Benchmark decontamination: prefix index of the items' rarest shingles, all item-sized windows counted by events, exact verification.

DataFrame functions only. Of an item's shingles, so many are listed, those in fewest items first, that the others together weigh
less than the similarity asks for: a window that is similar has a listed one, so no item of such a window is missed. The documents' shingles that
any item has are kept as rows (document, shingle, places), and a listed one makes a document and an item a pair. Of a pair, each place
counts for the windows that start in one interval: from where the window reaches it, or from behind the place that many occurrences before it as the
item has of the shingle, up to itself. A running sum over the intervals' ends is the weight that every window shares with the item, so all
windows are judged in time and memory of their shingles, however often a passage stands in texts and items. The best windows' words decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, written

#: Shingles, and windows, up to which a side is broadcast; counted first. A shingle is two numbers, a window five and an item's digest.
BROADCAST_SHINGLES = 1_000_000
BROADCAST_WINDOWS = 300_000


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters and digits; none for null."""
    return F.filter(F.split(F.coalesce(lower_ascii(text), F.lit("")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    """Hash of each run of k words."""
    return F.when(
        F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))
    ).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column, n: int) -> Column:
    """The runs of n words as texts; a shorter sequence is one."""
    return F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    ).otherwise(F.array(F.array_join(words, " ")))


def _item_shingles(items: DataFrame, n_words: int) -> DataFrame:
    """(iid, len, k, weight, h, times): the hashed shingles of each item, of ``k`` words, and how often they occur; ``weight`` in all."""
    k = F.least("len", F.lit(n_words)).alias("k")
    weight = F.greatest(F.col("len") - (n_words - 1), F.lit(1)).alias("weight")
    hashes = F.transform(_shingles(F.col("iw"), n_words), lambda x: F.xxhash64(F.split(x, " ")))
    return items.select("iid", "len", k, weight, F.explode(hashes).alias("h")).groupBy("iid", "len", "k", "weight", "h").agg(F.count("*").cast("int").alias("times"))


def _listed(shingles: DataFrame, similarity: float) -> DataFrame:
    """(k, h, iid, len, weight): of each item's shingles, those in fewest items first, so many that the others' share is below ``similarity``."""
    spread = shingles.join(shingles.groupBy("k", "h").agg(F.count("*").alias("texts")), ["k", "h"])
    before = F.sum("times").over(Window.partitionBy("iid").orderBy("texts", "h").rowsBetween(Window.unboundedPreceding, -1))
    ranked = spread.withColumn("before", F.coalesce(before, F.lit(0)))
    return ranked.where((F.col("weight") - F.col("before")) / F.col("weight") >= similarity).select("k", "h", "iid", "len", "weight")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table, to be broadcast if it has so many rows at most."""
    return F.broadcast(df) if df.count() <= rows else df


_TEXT = ["doc_id", "tid", "words"]


def _hits(docs: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, tid, words, k, h, ps): each text's shingles that an item has, and their places in ascending order."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("tid"), words_of(F.col("text")).alias("w"))
    hits = None
    for k in sizes:
        own = _small(written(shingles.where(F.col("k") == k).select("h").distinct(), "held"), BROADCAST_SHINGLES)
        grams = texts.select("doc_id", "tid", F.size("w").alias("words"), F.lit(k).alias("k"), F.posexplode(_grams(F.col("w"), k)).alias("p", "h"))
        met = grams.join(own, "h", "left_semi")
        hits = met if hits is None else hits.unionByName(met)
    return hits.groupBy(*_TEXT, "k", "h").agg(F.array_sort(F.collect_set("p")).alias("ps"))


def _best_windows(hits: DataFrame, shingles: DataFrame, listed: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, tid, words, iid, len, at): of each text and item, the first of the windows that share most, if that is enough."""
    pairs = hits.join(_small(listed, BROADCAST_SHINGLES), ["k", "h"]).select(*_TEXT, "iid").distinct()
    asked = pairs.join(_small(shingles, BROADCAST_SHINGLES), "iid").join(hits, [*_TEXT, "k", "h"])
    last = F.greatest(F.col("words") - F.col("len"), F.lit(0))

    def starts(p: Column, i: Column) -> Column:
        enough = F.when(i >= F.col("times"), F.col("ps")[i - F.col("times")] + 1).otherwise(0)
        return F.struct(F.greatest(enough, p - F.col("weight") + 1, F.lit(0)).alias("lo"), F.least(p, last).alias("hi"))

    counts = asked.select(*_TEXT, "iid", "len", "weight", F.explode(F.transform("ps", starts)).alias("x")).where("x.lo <= x.hi")
    end = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    ends = counts.select(*_TEXT, "iid", "len", "weight", F.explode(F.array(end(F.col("x.lo"), 1), end(F.col("x.hi") + 1, -1))).alias("e"))
    steps = ends.groupBy(*_TEXT, "iid", "len", "weight", F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    shared = F.sum("d").over(Window.partitionBy(*_TEXT, "iid").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    good = steps.withColumn("shared", shared).where(F.col("shared") / F.col("weight") >= similarity)
    return good.groupBy(*_TEXT, "iid", "len").agg((-F.max(F.struct("shared", (-F.col("at")).alias("back")))["back"]).alias("at"))


def _verified(docs: DataFrame, best: DataFrame, items: DataFrame, n_words: int, similarity: float) -> DataFrame:
    """(doc_id, iid, similarity, at, n_words): the windows whose own shingles, as words, are enough; only texts that have a window are cut again."""
    side = _small(best, BROADCAST_WINDOWS)
    cut = docs.withColumn("tid", F.xxhash64("text")).join(side, ["doc_id", "tid"]).select("doc_id", "tid", "iid", "at", "len", words_of(F.col("text")).alias("w"))
    cut = cut.select("doc_id", "tid", "iid", "at", F.slice("w", F.col("at") + 1, F.col("len")).alias("ww")).dropDuplicates(["doc_id", "tid", "iid"])
    key = ["doc_id", "tid", "iid", "at", "n"]
    window = cut.select("doc_id", "tid", "iid", "at", F.size("ww").alias("n"), F.explode(_shingles(F.col("ww"), n_words)).alias("s")).groupBy(*key, "s").agg(F.count("*").alias("here"))
    weight = F.greatest(F.col("len") - (n_words - 1), F.lit(1)).alias("weight")
    own = items.select("iid", weight, F.explode(_shingles(F.col("iw"), n_words)).alias("s")).groupBy("iid", "weight", "s").agg(F.count("*").alias("times"))
    share = window.join(own, ["iid", "s"]).groupBy(*key, "weight").agg(F.sum(F.least("here", "times")).alias("shared"))
    return share.select("doc_id", "iid", (F.col("shared") / F.col("weight")).alias("similarity"), "at", "n").where(F.col("similarity") >= similarity)


def find(docs: DataFrame, benchmark: DataFrame, n_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """A row for each document and benchmark item found in it: doc_id, item_id, similarity, word_at, n_words.

    Similarity is the weight of the item's shingles (as often as they occur) that the best window of the item's length has,
    as a share of the item's; of equally good windows the first is given. Words are runs of letters and digits, A-Z lower-cased; an item of fewer words than ``n_words`` is
    one shingle, one without words is never found. A text of fewer words than the item is one window, as it is. Null and empty texts hold nothing. Rows that share an id count as
    one document (or item) with each row's text; rows without an id are left out. Other columns play no part. Two texts under one id
    are told apart by a 64-bit hash.
    """
    named = written(
        benchmark.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("iw")).where(F.size("iw") > 0)
        .select("item_id", F.sha2(F.array_join("iw", " "), 256).alias("iid"), F.size("iw").alias("len"), "iw"), "items"
    )
    items = named.select("iid", "len", "iw").dropDuplicates(["iid"])
    shingles = written(_item_shingles(items, n_words), "shingles")
    sizes = sorted(r[0] for r in shingles.select("k").distinct().collect())  # n_words values at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, word_at int, n_words int")
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    hits = written(_hits(texts, shingles, sizes), "hits")
    best = written(_best_windows(hits, shingles, written(_listed(shingles, similarity), "listed"), similarity), "windows")
    found = _verified(texts, best, items, n_words, similarity).join(named.select("iid", "item_id").distinct(), "iid")
    # of the texts under one id, that of the best window
    return found.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), F.max_by(F.struct(F.col("at").alias("word_at"), F.col("n").alias("n_words")), F.struct("similarity", -F.col("at"), "n")).alias("w")
    ).select("doc_id", "item_id", "similarity", "w.word_at", "w.n_words")


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the documents found; rows without an id stay."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
