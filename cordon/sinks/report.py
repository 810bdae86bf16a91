"""The text report as ordered lines, laid out by executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semver
from ..functions import text as T
from ..operators.findings import most_specific, summary, top
from ..schema import LEVELS, text
from ..tables import written
from . import lines

WIDTH = 80


def sections(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """(osv, level, module, shown, found, fixed, platforms, traces, description, url) of each entry's modules."""
    best = most_specific(findings)
    t = top()
    rows = best.groupBy("osv", "level", t["module"].alias("module")).agg(
        F.min(text(t["version"])).alias("version"),
        F.min(text(F.col("fixed_version"))).alias("fixed_version"),
        F.min(t["package"]).alias("package"),
        F.array_sort(F.collect_set(F.when(F.col("level") == 3, T.compact_line(F.col("trace"))))).alias("traces"),
    )
    e = entries.select(F.col("id").alias("osv"), "affected", T.description(F.col("summary"), F.col("details")).alias("description"), text(F.col("database_specific.url")).alias("url"))
    joined = rows.join(e, "osv", "left")
    each = joined.select(
        "osv", "level", "module", F.coalesce(F.when(F.col("module") == "stdlib", F.col("package")), F.col("module")).alias("shown"),
        semver.module_version(F.col("module"), F.col("version")).alias("found"), semver.module_version(F.col("module"), F.col("fixed_version")).alias("fixed"),
        F.coalesce(T.platforms(F.col("affected"), F.col("module")), F.array().cast("array<string>")).alias("platforms"), "traces", text(F.col("description")).alias("description"), text(F.col("url")).alias("url"),
    )
    # entries that share an id are one in a report: the platforms of all, the least text
    return each.groupBy("osv", "level", "module", "shown", "found", "fixed", "traces").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("platforms")))).alias("platforms"), F.min("description").alias("description"), F.min("url").alias("url")
    )


def wrapped(c: Column, indent: str = "    ", width: int = WIDTH) -> Column:
    """A text's words in lines of at most ``width`` bytes, the indent included; a longer word has a line of its own. No words: empty."""
    words = F.filter(F.split(text(c), "[\\t-\\r \\u0085\\p{Z}]+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(s: Column, w: Column) -> Column:
        first = s["line"] == ""
        full = ~first & (F.octet_length(s["line"]) + F.octet_length(w) + 1 > width)
        done = F.when(full, F.concat(s["done"], s["line"], F.lit("\n"))).otherwise(s["done"])
        line = F.when(first | full, F.concat(F.lit(indent), w)).otherwise(F.concat(s["line"], F.lit(" "), w))
        return F.struct(done.alias("done"), line.alias("line"))

    return F.aggregate(words, start, add, lambda s: F.concat(s["done"], s["line"]))


_TITLES = {3: "Symbol", 2: "Package", 1: "Module"}


def _lines(section: int | Column, n: Column, m: Column, line: Column) -> list[Column]:
    return [(F.lit(section) if isinstance(section, int) else section).cast("int").alias("section"), n.cast("long").alias("n"), m.alias("m"), line.alias("line")]


def config_text(config: dict[str, str]) -> str:
    """What is known of the toolchain, scanner and database, and an empty line."""
    get = lambda k: config.get(k) or ""
    out = [f"Go: {get('go_version')}"] if get("go_version") else []
    if get("scanner_name"):
        out.append(f"Scanner: {get('scanner_name')}" + (f"@{get('scanner_version')}" if get("scanner_version") else ""))
    if get("db"):
        out += [f"DB: {get('db')}"] + ([f"DB updated: {get('db_last_modified')}"] if config.get("db_last_modified") else [])
    return "\n".join([*out, ""])


def bill_lines(sbom: DataFrame, tool: str = "cordon", section: int = 1) -> DataFrame:
    """The root packages and modules of a bill (go_version, modules, roots), in the order of its lists."""
    # fixed values: the texts of the report
    said = F.when(F.size("roots") > 1, F.concat(F.lit("The package pattern matched the following "), F.size("roots").cast("string"), F.lit(" root packages:"))).otherwise("The package pattern matched the following root package:")
    first = F.get("modules", F.lit(0))["path"]
    scanned = F.concat(F.lit(f"{tool} scanned the following "), (F.size("modules") - 1).cast("string"), F.lit(" modules and the "), text(F.col("go_version")), F.lit(" standard library:"))
    b = sbom.withColumn("roots", F.coalesce("roots", F.array().cast("array<string>"))).withColumn("modules", F.coalesce("modules", F.array().cast("array<struct<path:string,version:string>>")))
    none = F.lit("")
    roots = b.select(F.posexplode("roots").alias("k", "root")).select(*_lines(section, F.col("k") + 1, none, F.concat(F.lit("  "), "root")))
    version = F.when(text(F.col("x.version")) == "", "").otherwise(F.concat(F.lit("@"), "x.version"))
    mods = b.select(F.posexplode("modules").alias("k", "x")).where("x.path <> 'stdlib'").select(*_lines(section + 1, F.col("k") + 1, none, F.concat(F.lit("  "), "x.path", version)))
    printed = (F.size("roots") > 0) | F.exists("modules", lambda x: x["path"] != "stdlib")
    return lines.joined(
        b.where(F.size("roots") > 0).select(*_lines(section, F.lit(0), none, said)), roots,
        b.where((F.size("modules") > 0) & (first != "stdlib")).select(*_lines(section + 1, F.lit(0), none, scanned)), mods,
        b.where(printed).select(*_lines(section + 2, F.lit(0), none, F.lit(""))),
    )


def report_lines(
    entries: DataFrame, findings: DataFrame, scan_level: str, verbose: bool = False, config: dict[str, str] | None = None, sbom: DataFrame | None = None, tool: str = "cordon"
) -> DataFrame:
    """The report of a scan as ordered lines: versions if ``config`` is given, the bill if it is given and the report is verbose, a section for each level, the counts.

    Entries come by id, greatest first, numbered in each section; an entry's modules by path. An entry that isn't known has no description.
    """
    spark = findings.sparkSession
    want = LEVELS.index(scan_level) + 1
    shown = [x for x in (3, 2, 1) if x == want or (x < want and verbose)]
    rows = written(sections(entries, findings).where(F.col("level").isin(shown)), "sections")
    heads = rows.groupBy("osv", "level").agg(F.min("description").alias("description"), F.min("url").alias("url"))
    order = written(lines.numbered(heads, F.desc("level"), F.desc("osv")), "entries")
    firsts = {r["level"]: r["first"] for r in order.groupBy("level").agg(F.min("n").alias("first")).collect()}
    parts = [lines.fixed(spark, 0, config_text(config))] if config is not None else []
    if verbose and sbom is not None:
        parts.append(bill_lines(sbom, tool))
    for x in shown:
        # fixed values: the texts of the report
        none = "" if x in firsts else ("\nNo vulnerabilities found.\n" if x == want else "\nNo other vulnerabilities found.\n")
        parts.append(lines.fixed(spark, 20 - 4 * x, f"=== {_TITLES[x]} Results ===\n{none}"))
    place = 21 - 4 * F.col("level")
    rank = F.lit(1)
    for x, n in firsts.items():
        rank = F.when(F.col("level") == x, F.col("n") - n + 1).otherwise(rank)
    title = F.concat(F.lit("Vulnerability #"), rank.cast("string"), F.lit(": "), "osv", F.lit("\n"), wrapped(F.col("description")), F.lit("\n  More info: "), "url")
    parts.append(order.select(*_lines(place, F.col("n"), F.lit(""), title)))
    shown_at = lambda c: F.concat(F.col("shown"), F.lit("@"), F.col(c))
    numbered = F.transform("traces", lambda t, i: F.concat(F.lit("\n      #"), (i + 1).cast("string"), F.lit(": "), t))
    body = F.concat(
        F.when(F.col("module") == "stdlib", "  Standard library").otherwise(F.concat(F.lit("  Module: "), "module")),
        F.lit("\n    Found in: "), shown_at("found"),
        F.lit("\n    Fixed in: "), F.when(F.col("fixed") != "", shown_at("fixed")).otherwise("N/A"),
        F.when(F.size("platforms") > 0, F.concat(F.lit("\n    Platforms: "), F.array_join("platforms", ", "))).otherwise(""),
        F.when(F.size("traces") > 0, F.concat(F.lit("\n    Example traces found:"), F.array_join(numbered, ""))).otherwise(""),
        F.lit("\n"),
    )
    parts.append(rows.join(order.select("osv", "level", "n"), ["osv", "level"]).select(*_lines(place, F.col("n"), F.concat(F.lit(" "), "module"), body)))
    s = summary(findings.withColumn("ordinal", F.monotonically_increasing_id()) if "ordinal" not in findings.columns else findings).first()
    places = [f"{s['modules_called']} module{'' if s['modules_called'] == 1 else 's'}"] if s["modules_called"] else []
    places += ["the standard library"] if s["stdlib_called"] else []
    n = s["called"]
    said = f"Your code is affected by {n} {'vulnerability' if n == 1 else 'vulnerabilities'}" + (f" from {' and '.join(places)}" if places else "") + "."
    return lines.joined(*parts, lines.fixed(spark, 30, said))


def render(entries: DataFrame, findings: DataFrame, scan_level: str, verbose: bool = False, config: dict[str, str] | None = None, sbom: DataFrame | None = None) -> str:
    """The report of a small scan as a string; for a large one write ``report_lines``."""
    return lines.text_of(report_lines(entries, findings, scan_level, verbose, config, sbom))
