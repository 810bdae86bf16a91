"""what decides how a scan of sources grows, and that its findings are the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from cordon.operators import graph, scan
from cordon.plans import QUERIES
from cordon.plans.views import Views
from cordon.schema import ENTRY

SF = "/root/testdata/sf0.001"
NOW = "2024-06-01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_affected_rows_are_shuffled_by_supplier_and_by_module_only(spark, monkeypatch):
    """Before, nested entries were shuffled by module, by entry and module twice, and matches once more for each level."""
    plans, write = {}, scan.written
    monkeypatch.setattr(scan, "written", lambda df, name: plans.setdefault(name, _plan(df)) and write(df, name))
    QUERIES["q_scan_source"](spark, SF)
    assert "affected" not in plans
    large = [x for x in plans["matched"].splitlines() if "Exchange hashpartitioning" in x and "(path#" not in x and "(original#" not in x and "(module#" not in x]
    assert sorted(x.split("hashpartitioning(")[1][0] for x in large if "(s#" in x or "(m#" in x) == ["m", "s"]
    assert all("osv#" not in x.split("hashpartitioning(")[1].split(")")[0] for x in large)
    # sorted while they are small, and not once more with ranges and packages for the groups or the join; the other sort is that of packages
    assert len([x for x in plans["matched"].splitlines() if "Sort [m#" in x]) == 1 and plans["matched"].count("Sort [module#") == 1 and "ObjectHashAggregate(keys=[module#" not in plans["matched"]


def test_line_items_meet_in_one_shuffle(spark):
    sites = Views(spark, SF)["u_site"]
    sites.collect()
    plan = _plan(sites).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("+- Exchange hashpartitioning(") == 1


def test_functions_met_are_asked_for_by_searches_that_go_on(spark, monkeypatch):
    """Forty searches end in the first round, one goes on for twelve: its rounds read its own functions."""
    asked, small = [], graph._small
    monkeypatch.setattr(graph, "BROADCAST_NODES", 0)
    monkeypatch.setattr(graph, "_small", lambda df, n: (df.columns == ["search", "node"] and asked.append(n)) or small(df, n))
    chain = ["t", *[f"c{i}" for i in range(12)], "main"]
    calls = [("main", f"s{i}", True) for i in range(40)] + [(b, a, True) for a, b in zip(chain, chain[1:])]
    vulns = [(n, n, "k", n) for n in ["t", *[f"s{i}" for i in range(40)]]]
    got = graph.representative_stacks(
        spark.createDataFrame(vulns, "vuln string, osv string, package string, node string"),
        spark.createDataFrame(calls, "caller string, callee string, resolved boolean"), spark.createDataFrame([("main",)], "node string"),
    )
    assert {r.vuln: r.path for r in got.collect()} == {"t": chain} | {f"s{i}": [f"s{i}", "main"] for i in range(40)}
    assert len(asked) == 13 and asked[0] == 41 and asked[1:] == list(range(2, 14))


def _affected(module, events, imports=()):
    return {"package": {"name": module, "ecosystem": "Go"}, "ranges": [{"type": "SEMVER", "events": [dict([e]) for e in events]}], "ecosystem_specific": {"imports": list(imports)}}


def test_findings_of_all_levels(spark):
    """Module x at two versions, one of them as a replacement: an entry with a fix for each has a stack of its own for each (before, its frames came twice in both)."""
    named = lambda *symbols: {"path": "x.org/x/p", "symbols": list(symbols) or None}
    two = [("introduced", "0"), ("fixed", "1.0.5"), ("introduced", "1.0.8"), ("fixed", "1.2.0")]
    old = [("introduced", "0"), ("fixed", "1.0.5")]
    rows = [
        ("TWO", None, [_affected("x.org/x", two, [named("T.M", "Gone")])]),
        ("ANY", None, [_affected("x.org/x", old, [named()])]),
        ("WHOLE", None, [_affected("x.org/x", old)]),
        ("OTHER", None, [_affected("x.org/x", old, [{"path": "x.org/x/q", "symbols": ["F"]}])]),
        ("BACK", "2024-01-01 00:00:00", [_affected("x.org/x", old)]),
        ("NEW", None, [_affected("x.org/x", [("introduced", "1.3.0")])]),
    ]
    entries = spark.createDataFrame([{"id": i, "affected": a} for i, _, a in rows], ENTRY)
    gone = spark.createDataFrame([(i, w) for i, w, _ in rows], "id string, w string")
    entries = entries.join(gone, "id").withColumn("withdrawn", F.to_timestamp("w")).drop("w")
    replace = "struct<path:string,version:string>"
    mods = spark.createDataFrame([("x.org/x", "v1.0.0", None), ("y.org/y", "v9.0.0", ("x.org/x", "v1.1.0")), ("main", "", None)], f"path string, version string, replace {replace}")
    packages = spark.createDataFrame([("x.org/x/p", "x.org/x"), ("main", "main")], "package string, module string")
    functions = spark.createDataFrame(
        [(1, "x.org/x", "x.org/x/p", "M", "*T", "m.go", 5, 1), (2, "main", "main", "main", None, "main.go", 9, 1)],
        "fn_id long, module string, package string, name string, receiver string, file string, line int, column int",
    )
    calls = spark.createDataFrame([(2, 1, True, "main.go", 11, 3)], "caller long, callee long, resolved boolean, file string, line int, column int")
    found = scan.scan_source(mods, packages, functions, calls, spark.createDataFrame([(2,)], "node long"), entries, F.lit(NOW).cast("timestamp"))
    got = sorted((r.osv, r.fixed_version, r.trace[0].version if not r.trace[0].function else "", len([x for x in r.trace if x.package]), r.trace[-1].function or "") for r in found.collect())
    module = [(o, "v1.0.5", "v1.0.0", 0, "") for o in ("ANY", "OTHER", "TWO", "WHOLE")] + [("TWO", "v1.2.0", "v1.1.0", 0, "")]
    package = [(o, f, v, 1, "") for o, f, v, n, _ in module if o != "OTHER"]
    symbol = [(o, f, "", 2, "main") for o, f, v, n, _ in module if o != "OTHER"]
    assert got == sorted(module + package + symbol)
