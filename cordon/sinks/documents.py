"""SARIF and OpenVEX documents built by grouping, and messages as JSON."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.findings import most_specific, top, with_level
from ..schema import text
from ..tables import written
from . import lines


def messages(config: DataFrame | None = None, sbom: DataFrame | None = None, entries: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """(kind order, json): one message for each row, with exactly one field; config first, then the bill, entries, findings.

    Write the json column with ``write.text`` for one message on each line.
    """
    parts = []
    for k, (name, df) in enumerate((("config", config), ("SBOM", sbom), ("osv", entries), ("finding", findings))):
        if df is not None:
            parts.append(df.select(F.lit(k).alias("kind"), F.to_json(F.struct(F.struct(*df.columns).alias(name))).alias("json")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _frames(trace: Column, binary: bool) -> Column:
    """A stack's frames, entry first; a missing position is 1:1, and in binary mode there is none."""

    def one(f: Column) -> Column:
        where = F.struct(
            F.struct(T.file_location(f, F.element_at(trace, -1)["module"]).alias("artifactLocation"), F.struct(F.coalesce(f["position"]["line"], F.lit(1)).alias("startLine"), F.coalesce(f["position"]["column"], F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"),
            F.struct(T.document_symbol(f).alias("text")).alias("message"),
        )
        bare = F.struct(F.struct(T.document_symbol(f).alias("text")).alias("message"))
        version = F.when(text(f["version"]) == "", f["module"]).otherwise(F.concat(f["module"], F.lit("@"), f["version"]))
        return F.struct(version.alias("module"), (bare if binary else where).alias("location"))

    return F.transform(F.reverse(trace), one)


def sarif_results(findings: DataFrame, scan_level: str, binary: bool = False) -> DataFrame:
    """A result for each entry at its most precise level: (ruleId, level, message, stacks), sorted stacks."""
    best = most_specific(findings)
    element = F.when(F.col("level") == 1, top()["module"]).otherwise(top()["package"])
    stack = F.when(F.col("level") == 3, F.struct(T.compact_line(F.col("trace")).alias("message"), _frames(F.col("trace"), binary).alias("frames")))
    each = best.groupBy("osv", "level").agg(F.array_sort(F.collect_set(element)).alias("elements"), F.array_sort(F.collect_list(stack)).alias("stacks"))
    return each.select(
        F.col("osv").alias("ruleId"),
        T.severity(F.col("level"), scan_level).alias("level"),
        F.struct(T.result_message(F.col("level"), F.col("elements"), scan_level).alias("text")).alias("message"),
        "stacks",
    )


def code_flows(findings: DataFrame, binary: bool = False) -> DataFrame:
    """(ruleId, message, threadFlows) for each vulnerable function that is called: the compact traces of findings with the same top frame, entry first."""
    called = most_specific(findings).where("level = 3")
    # fixed value: the text of the message
    said = F.concat(F.lit("A summarized code flow for vulnerable function "), T.document_symbol(top()))
    flow = F.struct(_frames(T.compact(F.col("trace")), binary).alias("locations"))
    each = called.select(F.col("osv").alias("ruleId"), said.alias("message"), top().alias("frame"), flow.alias("flow"))
    return each.groupBy("ruleId", "message", "frame").agg(F.array_sort(F.collect_list("flow")).alias("threadFlows")).drop("frame")


def sarif_rules(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """A rule for each entry that has findings: id, text, help link, tags (aliases, or none)."""
    e = entries.join(findings.select(F.col("osv").alias("id")).distinct(), "id", "left_semi")
    return e.select(
        "id",
        F.struct(F.concat(F.lit("["), F.col("id"), F.lit("] "), T.description(F.col("summary"), F.col("details"))).alias("text")).alias("shortDescription"),
        text(F.col("database_specific.url")).alias("helpUri"),
        F.struct(F.coalesce("aliases", F.array().cast("array<string>")).alias("tags")).alias("properties"),
    )


def _json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def sarif_lines(entries: DataFrame, findings: DataFrame, scan_level: str, tool: str = "cordon", version: str = "0", binary: bool = False) -> DataFrame:
    """The document of a scan as ordered lines, one for each rule (by id) and result (by rule); of entries with one id the least text counts."""
    spark = findings.sparkSession
    rules = sarif_rules(entries, findings)
    rules = lines.numbered(rules.groupBy("id").agg(F.min(_json(*rules.columns)).alias("line")), "id")
    results = sarif_results(findings, scan_level, binary)
    results = lines.numbered(results.select("ruleId", _json(*results.columns).alias("line")), "ruleId")
    driver = json.dumps({"name": tool, "semanticVersion": version}, ensure_ascii=False)[:-1]
    head = f'{{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{{"tool": {{"driver": {driver}, "rules": ['
    return lines.joined(
        lines.fixed(spark, 0, head), lines.elements(1, rules), lines.fixed(spark, 2, ']}}, "results": ['), lines.elements(3, results), lines.fixed(spark, 4, "]}]}")
    )


def sarif(entries: DataFrame, findings: DataFrame, scan_level: str, tool: str = "cordon", version: str = "0", binary: bool = False) -> str:
    """The document of a small scan as a string; for a large one write ``sarif_lines``."""
    return lines.text_of(sarif_lines(entries, findings, scan_level, tool, version, binary))


def vex_statements(entries: DataFrame, findings: DataFrame, scan_level: str, purl_type: str) -> DataFrame:
    """A statement for each entry that has findings: (id, aliases, description, subcomponents, status, justification)."""
    best = most_specific(findings)
    each = best.groupBy("osv", "level").agg(F.array_sort(F.collect_set(T.purl(purl_type, top()["module"], top()["version"]))).alias("subcomponents"))
    s = T.exchange_status(F.col("level"), scan_level)
    rows = each.select("osv", "subcomponents", s["status"].alias("status"), s["justification"].alias("justification"))
    e = entries.select(F.col("id").alias("osv"), "aliases", T.description(F.col("summary"), F.col("details")).alias("description"))
    return rows.join(e, "osv", "left").select(F.col("osv").alias("id"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), text(F.col("description")).alias("description"), "subcomponents", "status", "justification")


def canonical(document: Column) -> Column:
    """A struct as compact JSON in one form only: fields in order, null ones left out, ``<>&`` and line separators escaped, control characters in small hex digits."""
    j = F.to_json(document)
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        j = F.regexp_replace(j, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
    for c in "<>&\u2028\u2029":
        j = F.replace(j, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return j


def vex_canonical(statements: DataFrame, tool: str, link: str = "") -> DataFrame:
    """(id, line): each statement of ``vex_statements`` as canonical JSON. Empty fields are left out; ``link`` comes before an id to make its address."""
    some = lambda c: F.when(F.size(c) > 0, c)
    aliases = some(F.col("aliases"))
    address = F.when(F.lit(link) != "", F.concat(F.lit(link), "id"))
    # fixed value: the texts of statements
    impact = F.when(F.col("status") == "not_affected", F.lit(f"{tool} determined that the vulnerable code isn't called"))
    parts = F.transform("subcomponents", lambda x: F.struct(x.alias("@id")))
    body = F.struct(
        F.struct(address.alias("@id"), F.col("id").alias("name"), F.when(F.col("description") != "", F.col("description")).alias("description"), aliases.alias("aliases")).alias("vulnerability"),
        F.array(F.struct(F.lit("Unknown Product").alias("@id"), some(parts).alias("subcomponents"))).alias("products"),
        "status", "justification", impact.alias("impact_statement"),
    )
    return statements.select("id", canonical(body).alias("line"))


def _quoted(value: str) -> str:
    out = json.dumps(value, ensure_ascii=False)
    return reduce(lambda t, c: t.replace(c, f"\\u{ord(c):04x}"), "<>&\u2028\u2029", out)


def open_vex_lines(entries: DataFrame, findings: DataFrame, scan_level: str, purl_type: str, author: str, timestamp: str, tool: str = "cordon", link: str = "") -> DataFrame:
    """The document of a scan as ordered lines, a statement each. Its id is the SHA-256 of its canonical JSON with the time set to zero.

    The digest is a sum over the text in order, so the driver runs it over the statements as they stream by, and holds none of them.
    """
    spark = findings.sparkSession
    each = vex_canonical(vex_statements(entries, findings, scan_level, purl_type), tool, link).groupBy("id").agg(F.min("line").alias("line"))
    rows = written(lines.numbered(each, "id").select("n", "line"), "statements")
    quoted = _quoted
    head = f'"author":{quoted(author)},"timestamp":%s,"version":1,"tooling":{quoted(tool)}'
    context = '{"@context":"https://openvex.dev/ns/v0.2.0",'
    digest = hashlib.sha256((context + head % '"0001-01-01T00:00:00Z"').encode())
    mark = ',"statements":['
    for r in rows.orderBy("n").toLocalIterator():
        digest.update((mark + r["line"]).encode())
        mark = ","
    some = mark == ","
    digest.update(b"]}" if some else b"}")
    first = f'{context}"@id":{quoted(f"{tool}/vex:{digest.hexdigest()}")},{head % quoted(timestamp)}'
    return lines.joined(lines.fixed(spark, 0, first + (',"statements":[' if some else "")), lines.elements(1, rows), lines.fixed(spark, 2, "]}" if some else "}"))


def open_vex(entries: DataFrame, findings: DataFrame, scan_level: str, purl_type: str, author: str, timestamp: str, tool: str = "cordon", link: str = "") -> str:
    """The document of a small scan as a string; for a large one write ``open_vex_lines``."""
    return lines.text_of(open_vex_lines(entries, findings, scan_level, purl_type, author, timestamp, tool, link))


def levels(findings: DataFrame) -> DataFrame:
    return with_level(findings).select("osv", "level")
