from __future__ import annotations

import json

from pyspark.sql import functions as F

from cordon.functions import text as T
from cordon.operators import findings, graph, modules, scan
from cordon.schema import BINARY_DDL, ENTRY, FINDING, FRAME
from cordon.sinks import documents, report
from cordon.streaming import messages


def test_reach_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", None)], "src string, dst string")
    got = graph.reach(edges, spark.createDataFrame([("a",)], "node string"))
    assert {r.node: r.depth for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def stacks(spark, vulns, calls, entries):
    v = spark.createDataFrame(vulns, "vuln string, osv string, package string, node string")
    c = spark.createDataFrame(calls, "caller string, callee string, resolved boolean")
    got = graph.representative_stacks(v, c, spark.createDataFrame([(e,) for e in entries], "node string"))
    return {r.vuln: (r.path, r.weight) for r in got.collect()}


def test_representative_stacks(spark):
    calls = [("main", "mid", False), ("mid", "sink", True), ("main", "way", True), ("way", "sink", True), ("far", "main", True), ("sink", "main", True)]
    assert stacks(spark, [("v", "o", "p", "sink")], calls, ["main", "far"]) == {"v": (["sink", "way", "main"], 0)}
    # another sink of the same entry and package is no intermediate function, but may be the entry
    calls = [("main", "s2", True), ("s2", "s1", True)]
    pair = [("v1", "o", "p", "s1"), ("v2", "o", "p", "s2")]
    assert stacks(spark, pair, calls, ["main"]) == {"v2": (["s2", "main"], 0)}
    assert stacks(spark, pair, calls, ["s2"]) == {"v1": (["s1", "s2"], 0)}
    other = [("v1", "o", "p", "s1"), ("v2", "o", "q", "s2")]
    assert stacks(spark, other, calls, ["main"])["v1"] == (["s1", "s2", "main"], 0)
    assert stacks(spark, pair, [], ["s1"]) == {}


def test_longest_prefix(spark):
    packages = spark.createDataFrame([("a.org/x/y/z",), ("a.org/xy",), ("net/http",), ("b.org/q",)], "package string")
    known = spark.createDataFrame([("a.org/x",), ("a.org/x/y",), ("stdlib",)], "path string")
    plain = {r.package: r.module for r in modules.resolve(packages, known).collect()}
    assert plain == {"a.org/x/y/z": "a.org/x/y", "a.org/xy": "unknown-module", "net/http": "stdlib", "b.org/q": "unknown-module"}
    assert {r.package: r.module for r in modules.resolve(packages, known, raw_prefix=True).collect()}["a.org/xy"] == "a.org/x"


def frame(module="m", package=None, function=None, receiver=None, line=None):
    return {"module": module, "version": "v1.0.0", "package": package, "function": function, "receiver": receiver, "position": {"filename": "f.go", "offset": 0, "line": line, "column": 2} if line else None}


def one(spark, trace, expr):
    return spark.createDataFrame([(trace,)], f"trace array<{FRAME}>").select(expr(F.col("trace")).alias("x")).first().x


def test_texts(spark):
    trace = [frame("dep", "d.org/go-lib/v2", "Do$1", "*T"), frame("dep", "d.org/b", "B"), frame("dep", "d.org/c", "C"), frame("top", "t.org/cmd", "Main", line=7), frame("top", "t.org/cmd", "init", line=3)]
    assert one(spark, trace, T.compact_line) == "f.go:7:2: cmd.Main calls c.C, which eventually calls lib.T.Do"
    assert one(spark, trace[:1], T.compact_line) == "lib.T.Do"
    assert one(spark, [frame("m", "p/a", "A"), frame("m", "p/b", "B")], T.compact_line) == "b.B calls a.A"
    df = spark.createDataFrame([("a.org/x y/+*é", "v1"), ("m", "")], "m string, v string")
    assert [r[0] for r in df.select(T.purl("generic", F.col("m"), F.col("v"))).collect()] == ["pkg:generic/a.org%2Fx%20y%2F+%2A%C3%A9@v1", "pkg:generic/m"]
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(T.english_list(F.col("x"))).collect()] == ["a", "a and b", "a, b, and c", ""]
    df = spark.createDataFrame([("a@b@v1.0.0",), ("a@",), ("@v1.0.0",), ("a@x",)], "p string")
    assert [r[0] and tuple(r[0]) for r in df.select(T.split_pattern(F.col("p"))).collect()] == [("a@b", "v1.0.0"), None, None, None]


def found(spark):
    rows = [
        ("V-1", "v1.2.0", [frame("dep")]), ("V-1", "v1.2.0", [frame("dep", "dep.org/p")]), ("V-1", "v1.2.0", [frame("dep", "dep.org/p", "F"), frame("top", "top", "main", line=4)]),
        ("V-2", "", [frame("dep")]), ("V-2", "", [frame("dep", "dep.org/q")]), ("V-3", "", [frame("stdlib")]),
    ]
    return spark.createDataFrame(rows, FINDING)


def entries(spark):
    rows = [{"id": f"V-{i}", "summary": f"Flaw {i}", "aliases": ["C-1"] if i == 1 else None, "database_specific": {"url": f"u{i}"}} for i in (1, 2)]
    return spark.createDataFrame(rows, ENTRY)


def test_documents(spark):
    f, e = found(spark), entries(spark)
    assert sorted((r.osv, r.level) for r in findings.most_specific(f).collect()) == [("V-1", 3), ("V-2", 2), ("V-3", 1)]
    s = findings.summary(f.withColumn("ordinal", F.monotonically_increasing_id())).first()
    assert tuple(s) == (1, 1, 1, 1, False)
    assert findings.exit_code(f, "symbol") == 3 and findings.exit_code(f.where("osv = 'V-2'"), "symbol") == 0
    sarif = json.loads(documents.sarif(e, f, "symbol"))
    results = {r["ruleId"]: r for r in sarif["runs"][0]["results"]}
    assert [results[k]["level"] for k in ("V-1", "V-2", "V-3")] == ["error", "warning", "note"]
    assert results["V-1"]["message"]["text"] == "Your code calls vulnerable functions in 1 package (dep.org/p)."
    assert [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == ["V-1", "V-2"]
    vex = documents.open_vex(e, f, "symbol", "generic", "someone", "2024-01-01T00:00:00Z")
    again = documents.open_vex(e, f, "symbol", "generic", "someone", "2025-01-01T00:00:00Z")
    assert json.loads(vex)["@id"] == json.loads(again)["@id"]
    assert [x["status"] for x in json.loads(vex)["statements"]] == ["affected", "not_affected", "not_affected"]
    lines = [json.loads(r.json) for r in documents.messages(entries=e, findings=f).collect()]
    assert all(len(x) == 1 for x in lines) and len(lines) == 8
    text = report.render(e, f, "symbol", verbose=True)
    assert "Vulnerability #1: V-1" in text and "Fixed in: dep@v1.2.0" in text and "affected by 1 vulnerability from 1 module." in text


def test_validity(spark):
    rows = [("V", "", [frame()]), ("", "", [frame()]), ("V", "", []), ("V", "", [frame("", "p")]), ("V", "", [frame("m", None, "F")])]
    df = spark.createDataFrame(rows, FINDING)
    assert [r[0] for r in df.select(findings.valid(F.col("osv"), F.col("trace"))).collect()] == [True, False, False, False, False]


def test_stream(spark, tmp_path):
    """The stream's last word on each entry equals the batch's, however the messages are cut into files."""
    from cordon.sources.messages import read_message_lines

    for k, part in enumerate(found(spark).repartition(3).select(F.to_json(F.struct(F.struct("*").alias("finding"))).alias("j")).collect()):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text(part.j + "\n")
    seen: dict[str, tuple] = {}
    stream = messages.best_levels(messages.findings_of(read_message_lines(spark, str(tmp_path / "in"), streaming=True)))
    messages.run_once(stream, lambda df, _: seen.update({r.osv: (r.level, r.n) for r in df.collect()}), str(tmp_path / "ck")).awaitTermination()
    assert seen == {r.osv: (r.level, r.n) for r in messages.best_levels(found(spark)).collect()} == {"V-1": (3, 1), "V-2": (2, 1), "V-3": (1, 1)}


def test_deep_stacks_by_doubling(spark):
    """A chain of 37 calls, with a side way that is as long but has an unresolved call."""
    calls = [(f"n{i + 1:02d}", f"n{i:02d}", True) for i in range(37)] + [("n05x", "n04", False), ("n06", "n05x", True)]
    assert stacks(spark, [("v", "o", "p", "n00"), ("w", "q", "p", "n00")], calls, ["n37"]) == {k: ([f"n{i:02d}" for i in range(38)], 0) for k in ("v", "w")}


def binaries(spark):
    module = lambda p, v: {"Path": p, "Version": v, "Replace": None}
    sym = lambda pkg, *names: [{"pkg": pkg, "name": n} for n in names]
    rows = [
        ("a", {"path": "top.org/cmd", "main": {"Path": "top.org", "Version": "v0.1.0"}, "modules": [module("a.org/m", "v1.0.0")], "pkgSymbols": sym("main", "Bad") + sym("a.org/m/p", "F", "f")}),
        ("stripped", {"path": "x", "main": None, "modules": [module("a.org/m", "v1.0.0")], "pkgSymbols": []}),
        ("windows", {"path": "y", "main": None, "modules": [module("a.org/m", "v1.0.0"), module("b.org/n", "v1.0.0")], "pkgSymbols": sym("a.org/m/p", "f"), "goos": "windows", "goarch": "amd64"}),
        ("fixed", {"path": "z", "main": None, "modules": [module("a.org/m", "v3.0.0")], "pkgSymbols": sym("a.org/m/p", "F")}),
    ]
    return spark.createDataFrame([{"program": k, "goVersion": "go1.20.0", "goos": "linux", "goarch": "amd64"} | v for k, v in rows], f"program string, {BINARY_DDL}")


def test_several_binaries_are_each_as_alone(spark):
    def entry(i, module, symbols, goos=()):
        imports = [{"path": f"{module}/cmd" if module == "top.org" else f"{module}/p", "goos": list(goos), "goarch": [], "symbols": symbols}]
        return {"id": i, "affected": [{"package": {"name": module}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0", "fixed": None}, {"introduced": None, "fixed": "2.0.0"}]}], "ecosystem_specific": {"imports": imports}}]}

    known = spark.createDataFrame([entry("V1", "a.org/m", ["F", "f", "g"]), entry("V2", "a.org/m", [], ["linux"]), entry("V3", "top.org", ["Bad"])], ENTRY)
    now = F.lit("2024-01-01").cast("timestamp")
    show = lambda df: sorted((r.program, r.osv, r.fixed_version, r.trace[0].package or "", r.trace[0].function or "") for r in df.collect())
    table = binaries(spark)
    together = show(scan.scan_binary(table, known, now))
    assert together == sorted(x for r in ("a", "stripped", "windows", "fixed") for x in show(scan.scan_binary(table.where(F.col("program") == r), known, now)))
    symbols = {(p, o, f) for p, o, _, _, f in together if f}
    # the symbol of the main package stands under its path; f goes where F is found too; the linux entry leaves windows alone
    assert {x for x in symbols if x[0] == "a"} == {("a", "V1", "F"), ("a", "V2", "F"), ("a", "V3", "Bad")}
    assert {x for x in symbols if x[0] == "windows"} == {("windows", "V1", "f")}
    assert {x for x in symbols if x[0] == "stripped"} >= {("stripped", "V1", "F")} and not any(p == "fixed" for p, *_ in together)


def test_binaries_meet_rows_of_entries(spark):
    """Entries as rows, two of which share an id, a module and an ordinal, as if nested; findings are told apart by small rows, which are joined where they lie."""
    imports = lambda *s: F.expr(f"array(named_struct('path', 'a.org/m/p', 'goos', array(), 'goarch', array(), 'symbols', array({', '.join(map(repr, s))})))")
    rows = spark.sql("SELECT 'V1' AS osv, e AS entry, CAST(NULL AS TIMESTAMP) AS withdrawn, 0 AS ordinal, 'a.org/m' AS module, array(named_struct('type', 'SEMVER', 'events', array("
                     "named_struct('introduced', '0', 'fixed', CAST(NULL AS STRING)), named_struct('introduced', CAST(NULL AS STRING), 'fixed', CASE e WHEN 1 THEN '2.0.0' ELSE '0.9.0' END)))) AS ranges FROM VALUES (1), (2) t(e)")  # fmt: skip
    rows = rows.withColumn("imports", F.when(F.col("entry") == 1, imports("F")).otherwise(imports("G")))
    found = scan.scan_binary(binaries(spark), rows, F.lit("2024-01-01").cast("timestamp"))
    # version 1.0.0 is past the second entry's fix, so its symbol G is none of a stripped binary's
    got = sorted((r.program, r.osv, r.fixed_version, r.trace[0].package or "", r.trace[0].function or "") for r in found.collect())
    want = [(p, "V1", "v2.0.0", *x) for p in ("a", "stripped") for x in (("", ""), ("a.org/m/p", ""), ("a.org/m/p", "F"))]
    assert got == sorted([*want, ("windows", "V1", "v2.0.0", "", ""), ("windows", "V1", "v2.0.0", "a.org/m/p", "")])
    left, right = (spark.range(100).selectExpr("id AS program", "'p' AS path", "'o' AS osv", *more) for more in (["'k' AS package", "'s' AS symbol"], ["'1' AS version", "'2' AS fixed_version"]))
    plan = findings.symbol_findings(left.hint("merge").join(right, ["program", "path", "osv"]), ("program",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_warnings_of_binaries(spark):
    old = binaries(spark).withColumns({"goVersion": F.when(F.col("program") == "a", "go1.17").otherwise("go1.18"), "goos": F.when(F.col("program") == "fixed", "").otherwise("linux")})
    said = {(r.program, r.message.split(":")[1].split()[0]) for r in scan.binary_warnings(old).collect()}
    assert said == {("a", "binary"), ("fixed", "failed")}
