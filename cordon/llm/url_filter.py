"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, precedence.

DataFrame functions only. Every URL is taken apart into the expressions that any rule of the given
list could be written as (host suffixes at label boundaries x path prefixes at the lengths that
rules have); their SHA-256 digests' first characters meet the rules' in an equi-join, the full
digests confirm, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii

PREFIX_HEX = 8
BROADCAST_RULES = 100_000

RULES = T.StructType(
    [
        T.StructField("rule_host", T.StringType(), False),
        T.StructField("rule_path", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
    ]
)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """All host suffixes of at most ``labels`` labels x all path prefixes of the given lengths."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda k: F.call_function("substring_index", host, F.lit("."), -k),
    )
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(
            suffixes,
            lambda h: F.transform(cuts, lambda n: F.struct(h.alias("h"), F.substring(path, F.lit(1), n).alias("p"))),
        )
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Judge each row's URL: columns ``keep``, then host, path, rule, verdict.

    A rule (rule_host, rule_path, action) fits its host and all subdomains if the URL's path starts
    with its path. The longest rule (host and path together, then host, then text) wins; without one
    the verdict is ``default``. Null and malformed URLs have empty host and path and fit a rule only
    if its host is empty. Repeated rows are judged and returned each; other columns play no part.

    The work is done once for each distinct (host, path): hot hosts shrink before any shuffle, and
    the join back is an ordinary equi-join whose hot keys AQE splits. The rules are broadcast up to
    ``BROADCAST_RULES`` rows, counted first; a longer list joins by shuffle, its expressions salted.
    Path lengths and label counts in use are bounded by the longest rule, not by the data.
    """
    rules = rules.select(lower_ascii(F.coalesce("rule_host", F.lit(""))).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "action")
    shape = rules.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()
    urls = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    none = urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not shape["n"]:
        return none

    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    listed = rules.select("*", digest.alias("digest"), F.substring(digest, 1, PREFIX_HEX).alias("prefix"))
    distinct = urls.select("host", "path").distinct()
    asked = (
        distinct.select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), shape["labels"], shape["lengths"])).alias("e"))
        .select("host", "path", _digest(F.col("e.h"), F.col("e.p")).alias("full"))
        .withColumn("ask", F.substring("full", 1, PREFIX_HEX))
    )
    if shape["n"] <= BROADCAST_RULES:
        met = asked.join(F.broadcast(listed), F.col("ask") == F.col("prefix"))
    else:
        salts = 16
        spread = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = asked.withColumn("ask_salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int")).join(
            spread, (F.col("ask") == F.col("prefix")) & (F.col("ask_salt") == F.col("salt"))
        )
    order = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), "rule_host", "rule_path", "action")
    judged = (
        met.where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), order).alias("best"))
        .select(F.col("host").alias("j_host"), F.col("path").alias("j_path"), F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    )
    return urls.join(judged, (F.col("host") == F.col("j_host")) & (F.col("path") == F.col("j_path")), "left").select(
        *keep, "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict")
    )
