"""Findings: made from matches, validated, ranked by precision, grouped and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import FRAME, text
from .modules import is_standard


def frame(module: Column, version: Column, package: Column | None = None, function: Column | None = None, receiver: Column | None = None, position: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    at = F.lit(None).cast("struct<filename:string,offset:int,line:int,column:int>") if position is None else position
    return F.struct(
        module.alias("module"), version.alias("version"), (none if package is None else package).alias("package"), (none if function is None else function).alias("function"),
        (none if receiver is None else receiver).alias("receiver"), at.alias("position"),
    ).cast(FRAME)


def module_findings(matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A finding with one frame for each affecting row: (osv, fixed_version, trace). ``matched`` has fixed_version.

    Rows are made distinct before their frames are made, here and below: they are smaller, and where they were joined by some of these columns they need no other shuffle.
    """
    rows = matched.select(*by, "osv", "fixed_version", "path", "version").distinct()
    return rows.select(*by, "osv", "fixed_version", F.array(frame(F.col("path"), F.col("version"))).alias("trace"))


def package_findings(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``found``: osv, fixed_version, path, version, package."""
    rows = found.select(*by, "osv", "fixed_version", "path", "version", "package").distinct()
    return rows.select(*by, "osv", "fixed_version", F.array(frame(F.col("path"), F.col("version"), F.col("package"))).alias("trace"))


def symbol_findings(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Findings of a program without call graph: the symbol split at its last dot into receiver and name."""
    name = F.substring_index("symbol", ".", -1)
    receiver = F.when(F.contains("symbol", F.lit(".")), F.regexp_replace("symbol", r"\.[^.]*\z", ""))
    rows = found.select(*by, "osv", "fixed_version", "path", "version", "package", "symbol").distinct()
    return rows.select(*by, "osv", "fixed_version", F.array(frame(F.col("path"), F.col("version"), F.col("package"), name, receiver)).alias("trace"))


def stack_traces(stacks: DataFrame, functions: DataFrame, calls: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, trace) of stacks (by, path), each of which ``by`` tells apart: frames sink first.

    The sink has its definition's position, every other frame that of its call. ``functions``: fn_id, module, version, package,
    name, receiver, file, line, column; ``calls``: one site for each (caller, callee) with file, line, column.
    """
    at = lambda f, a, b: F.struct(F.col(f).alias("filename"), F.lit(0).alias("offset"), F.col(a).cast("int").alias("line"), F.col(b).cast("int").alias("column"))
    steps = stacks.select(*by, F.posexplode("path").alias("k", "fn"), "path").withColumn("callee", F.when(F.col("k") > 0, F.get("path", F.col("k") - 1)))
    f = functions.select(F.col("fn_id").alias("fn"), "module", "version", "package", "name", "receiver", at("file", "line", "column").alias("defined"))
    c = calls.select(F.col("caller").alias("fn"), "callee", at("file", "line", "column").alias("called"))
    rows = steps.drop("path").join(f, "fn", "left").join(c, ["fn", "callee"], "left")
    one = frame(F.col("module"), F.col("version"), F.col("package"), F.col("name"), F.col("receiver"), F.when(F.col("k") == 0, F.col("defined")).otherwise(F.col("called")))
    # a stack's length bounds its group
    traces = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", one.alias("f")))).alias("t"))
    return traces.select(*by, F.transform("t", lambda x: x["f"]).alias("trace"))


def stack_findings(stacks: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Findings from representative stacks (osv, fixed_version, vuln, path): see ``stack_traces``."""
    return stack_traces(stacks, functions, calls, ("vuln", "osv", "fixed_version")).select("osv", "fixed_version", "trace")


def top(trace: Column | str = "trace") -> Column:
    return F.get(F.col(trace) if isinstance(trace, str) else trace, F.lit(0))


def valid(osv: Column, trace: Column) -> Column:
    """An entry id, at least one frame; version or package need a module, a function needs a package."""
    bad = F.exists(
        trace,
        lambda f: ((text(f["version"]) != "") & (text(f["module"]) == ""))
        | ((text(f["package"]) != "") & (text(f["module"]) == ""))
        | ((text(f["function"]) != "") & (text(f["package"]) == "")),
    )
    return (text(osv) != "") & (F.coalesce(F.size(trace), F.lit(0)) > 0) & ~bad


def with_level(findings: DataFrame) -> DataFrame:
    return findings.withColumn("level", T.level_of(top()))


def most_specific(findings: DataFrame) -> DataFrame:
    """The findings of the highest level of each entry.

    The level is aggregated (with partial sums on the map side) and joined back, so a hot entry isn't sorted in one task.
    """
    ranked = with_level(findings)
    best = ranked.groupBy("osv").agg(F.max("level").alias("best"))
    return ranked.join(best, "osv").where("level = best").drop("best")


def with_entries(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings with their entry; a row with only the id where the entry is missing."""
    return findings.join(entries.withColumnRenamed("id", "osv"), "osv", "left")


def by_vulnerability(findings: DataFrame) -> DataFrame:
    """(osv, level, n_findings, any_standard), ids descending."""
    t = with_level(findings)
    std = is_standard(text(top()["package"])) | (top()["module"] == "stdlib")
    return t.groupBy("osv").agg(F.max("level").alias("level"), F.count("*").alias("n_findings"), F.max(std).alias("any_standard")).orderBy(F.desc("osv"))


def by_module(findings: DataFrame) -> DataFrame:
    """(osv, module, n_findings)."""
    return findings.groupBy("osv", top()["module"].alias("module")).agg(F.count("*").alias("n_findings"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: vulnerabilities called, imported, required; modules called outside the standard library; whether that is called.

    ``findings`` has an ``ordinal``: a called vulnerability counts for the module of its first finding.
    """
    t = with_level(findings)
    std = is_standard(text(top()["package"])) | (top()["module"] == "stdlib")
    each = t.groupBy("osv").agg(F.max("level").alias("level"), F.max(std).alias("std"), F.min_by(top()["module"], "ordinal").alias("module"))
    called = F.col("level") == 3
    return each.agg(
        F.count_if(called).alias("called"),
        F.count_if(F.col("level") == 2).alias("imported"),
        F.count_if(F.col("level") == 1).alias("required"),
        F.count_distinct(F.when(called & ~F.col("std"), F.col("module"))).alias("modules_called"),
        F.coalesce(F.max(called & F.col("std")), F.lit(False)).alias("stdlib_called"),
    )


def exit_code(findings: DataFrame, scan_level: str) -> int:
    """3 if a finding exists at exactly the level scanned for, else 0."""
    want = {"module": 1, "package": 2, "symbol": 3}[scan_level]
    return 3 if not with_level(findings).where(F.col("level") == want).isEmpty() else 0


def top_symbols(symbols: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` symbols (by short name) of each (osv, path), with the number of others."""
    own = Window.partitionBy("osv", "path")
    n = symbols.groupBy("osv", "path").agg(F.count("*").alias("total"))
    ranked = symbols.withColumn("rank", F.row_number().over(own.orderBy("symbol"))).where(F.col("rank") <= k)
    return ranked.join(n, ["osv", "path"]).select("osv", "path", "symbol", "rank", F.greatest(F.col("total") - k, F.lit(0)).alias("others"))


def flags(findings: DataFrame) -> DataFrame:
    """(osv, called, imported, required): whether any finding of an entry has a function, a package, a module in its top frame."""
    has = lambda c: F.coalesce(F.bool_or(text(top()[c]) != ""), F.lit(False))
    return findings.groupBy("osv").agg(has("function").alias("called"), has("package").alias("imported"), has("module").alias("required"))


def stable_order() -> list[Column]:
    """The order of findings that does not depend on how they came: entry, greatest first, then the top frame's module, package, receiver and function."""
    return [F.desc("osv"), *[text(top()[c]) for c in ("module", "package", "receiver", "function")]]
