"""Names with type arguments, paths, addresses, and documents written by executors."""

from __future__ import annotations

import hashlib
import json
import os
import random

from pyspark.sql import functions as F

from cordon.functions import paths, symbols
from cordon.operators import addresses
from cordon.schema import SBOM_DDL
from cordon.sinks import documents, lines, report

from .test_operators import entries, found


def test_names_with_type_arguments(spark):
    # fixed values: names and their parts
    cases = [
        ("debug/sym.(*LineTable).PCToLine", "debug/sym", "(*LineTable)", "PCToLine"), ("debug/sym.NewTable", "debug/sym", "", "NewTable"), ("main.set[int]", "main", "", "set[int]"),
        ("main.(*value[int]).get", "main", "(*value[int])", "get"), ("a/b.diff[c/d.ordered[float64]]", "a/b", "", "diff[c/d.ordered[float64]]"),
        ("main.test[.shape.int]", "main", "", "test[.shape.int]"), ("x.org/y/do.c/pkg/flag.(*Set).Print", "x.org/y/do.c/pkg/flag", "(*Set)", "Print"), ("x.org/do.c/flag.Print", "x.org/do.c/flag", "", "Print"),
        ("type:.eq.a", "", "eq", "a"), ("go:x.y", "", "", "y"), ("plain", "", "", "plain"), ("", "", "", ""), (None, "", "", ""), ("a.b]c[", "a", "", "b]c["), ("a.T[x].M[y.z]", "a", "", "T[x].M[y.z]"),
    ]
    c = F.col("name")
    rows = spark.createDataFrame([(a, k) for k, (a, *_) in enumerate(cases)], "name string, k int").select("k", symbols.package_of(c), symbols.receiver_of(c), symbols.base_of(c)).collect()
    for r in rows:
        assert tuple(r)[1:] == cases[r[0]][1:], cases[r[0]]
    old = spark.createDataFrame([("go.x.y", 18), ("go.x.y", 20), ("go:x.y", 18), ("go:x.y", 19)], "name string, minor int")
    assert [r[0] for r in old.select(symbols.package_of(c, F.col("minor"))).collect()] == ["", "go", "go:x", "go:x"]
    df = spark.createDataFrame([("*a/b.T", "a/b"), ("T", "a"), (None, None)], "r string, p string")
    assert [tuple(x) for x in df.select(symbols.bare_receiver(F.col("r"), F.col("p")), symbols.shown(F.col("r"), F.col("p"), F.lit("f"))).collect()] == [("*T", "*a/b.T.f"), ("T", "T.f"), ("", ".f")]


def test_paths_are_those_of_the_system(spark):
    rng = random.Random(3)
    made = ["/".join(rng.choice(["a", "b", "..", ".", "", "c"]) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    made += ["", "/", "//", "..", "/..", "a/../..", "./a"]
    pairs = [(x, y) for x, y in zip(made, rng.sample(made, len(made)), strict=True)]
    rows = spark.createDataFrame(pairs, "x string, y string").select("x", "y", paths.clean(F.col("x")).alias("c"), paths.relative(F.col("x"), F.col("y")).alias("r")).collect()
    for r in rows:
        want = os.path.normpath(r.x) if r.x else "."
        assert r.c == ("/" + want.lstrip("/") if want.startswith("/") else want), r
        base, path = (os.path.normpath(p or ".") for p in (r.x, r.y))
        if r.r is None:
            assert base.startswith("/") != path.startswith("/") or ".." in base.split("/"), r
        else:
            root = "" if base.startswith("/") else "/0/1/2/3/4/5/6/7/"
            assert r.r == os.path.relpath(root + path, root + base), r
    one = lambda *a: spark.range(1).select(paths.module_file(*[F.lit(x) for x in a[:3]], *a[3:])).first()[0]
    assert one("/v/vendor/a.b/c/x/f.go", "", "a.b/c") == "x/f.go" and one("/v/f.go", "", "a") == "" and one("", "/d", "a") == ""
    assert one("C:\\m\\x\\f.go", "C:\\m", "a", "\\") == "x/f.go"


def test_addresses_against_brute_force(spark):
    rng = random.Random(5)
    fns, steps = [], []
    for g in "ab":
        at = 0
        for k in range(60):
            at += rng.choice([0, 0, 1, 70_000, 300_000])
            n = rng.choice([1, 5, 100, 200_000])
            fns.append((g, k, at, at + n))
            steps += [(g, at + d, f"f{rng.randint(0, 2)}", rng.randint(1, 9)) for d in sorted({rng.randrange(n) for _ in range(4)})]
            at += n
    asked = [(g, x) for g in "abc" for x in [None, -1, 0, *(rng.randrange(6_000_000) for _ in range(200)), *(f[2] for f in fns), *(f[3] for f in fns)]]
    f = spark.createDataFrame(fns, "program string, fn_id long, start long, stop long")
    t = spark.createDataFrame(steps, "program string, start long, file string, line int")
    q = spark.createDataFrame(asked, "program string, address long")
    got = sorted((tuple(r) for r in addresses.lines_at(q, f, t).select("program", "address", "fn_id", "file", "line").collect()), key=str)

    def brute(g, x):
        own = [y for y in fns if x is not None and y[0] == g and y[2] <= x < y[3]]
        if not own:
            return (g, x, None, None, None)
        at = [y for y in steps if y[0] == g and own[0][2] <= y[1] <= x]
        return (g, x, own[0][1], *(max(at, key=lambda y: y[1])[2:] if at else (None, None)))

    assert got == sorted((brute(g, x) for g, x in asked), key=str)
    places = [(g, file, line) for g in "abc" for file in ("f0", "f1", "none") for line in range(11)]
    rows = addresses.addresses_of(spark.createDataFrame(places, "program string, file string, line int"), f, t).collect()
    assert len(rows) == len(places)
    for r in rows:
        at = [y[1] for y in steps if y[0] == r.program and y[2] == r.file and y[3] == r.line]
        known = any(y[0] == r.program and y[2] == r.file for y in steps)
        assert (r.address, r.error) == (min(at, default=None), None if at else "unknown line" if known else "unknown file")
    assert addresses.lines_at(q.limit(0), f, t).count() == 0 and addresses.lines_at(q, f.limit(0), t).where("fn_id IS NOT NULL").count() == 0


def test_written_documents_are_the_small_ones(spark, tmp_path):
    f, e = found(spark), entries(spark)
    for k, document in enumerate((documents.sarif_lines(e, f, "symbol"), documents.open_vex_lines(e, f, "symbol", "generic", "someone", "2024-01-01T00:00:00Z"), report.report_lines(e, f, "symbol", True))):
        folder = tmp_path / str(k)
        lines.write_document(document, str(folder), 3)
        parts = sorted(p for p in folder.iterdir() if p.name.startswith("part-"))
        assert "".join(p.read_text() for p in parts) == lines.text_of(document)
    none = f.limit(0)
    assert json.loads(documents.sarif(e, none, "symbol"))["runs"][0]["results"] == []
    assert "statements" not in json.loads(documents.open_vex(e, none, "symbol", "generic", "a", "t"))


def test_a_document_of_many_results(spark, tmp_path):
    rows = spark.range(100_000).select(F.concat(F.lit("V-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("osv"))
    frames = F.array(F.struct(F.lit("m").alias("module"), *[F.lit(None).cast("string").alias(c) for c in ("version", "package", "function", "receiver")], F.lit(None).cast("struct<filename:string,offset:int,line:int,column:int>").alias("position")))
    f = rows.select("osv", F.lit("").alias("fixed_version"), frames.alias("trace"))
    lines.write_document(documents.sarif_lines(entries(spark), f, "module"), str(tmp_path / "x"), 5)
    document = json.loads("".join(p.read_text() for p in sorted((tmp_path / "x").iterdir()) if p.name.startswith("part-")))
    assert [r["ruleId"] for r in document["runs"][0]["results"]] == [f"V-{i:06d}" for i in range(100_000)]


def test_document_id_is_the_digest_of_a_fixed_text(spark):
    f, e = found(spark).where("osv = 'V-1'"), entries(spark).withColumn("summary", F.lit("a<b>&\u2028\x1b\\u001B"))
    got = json.loads(documents.open_vex(e, f, "symbol", "generic", "x & y", "2024-01-01T00:00:00Z"))
    body = (
        '{"@context":"https://openvex.dev/ns/v0.2.0","author":"x \\u0026 y","timestamp":"0001-01-01T00:00:00Z","version":1,"tooling":"cordon","statements":[{"vulnerability":{"name":"V-1",'
        '"description":"a\\u003cb\\u003e\\u0026\\u2028\\u001b\\\\u001B","aliases":["C-1"]},"products":[{"@id":"Unknown Product","subcomponents":[{"@id":"pkg:generic/dep@v1.0.0"}]}],"status":"affected"}]}'
    )
    assert got["@id"] == "cordon/vex:" + hashlib.sha256(body.encode()).hexdigest()
    assert got["statements"][0]["vulnerability"]["description"] == "a<b>&\u2028\x1b\\u001B" and got["timestamp"] == "2024-01-01T00:00:00Z"


def test_lines_are_filled_by_bytes(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["é", "ab", "word", "x" * 30, "y" * 90]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", None, " \n\t ", "a\u00a0b\u2003c"]

    def brute(s):
        out, w = "", 0
        for word in (s or "").split():
            n = len(word.encode())
            if w and w + n + 1 > 80:
                out, w = out + "\n", 0
            out, w = (out + "    " + word, 4 + n) if not w else (out + " " + word, w + n + 1)
        return out

    rows = spark.createDataFrame([(k, s) for k, s in enumerate(texts)], "k int, s string").select("k", report.wrapped(F.col("s"))).collect()
    assert all(r[1] == brute(texts[r[0]]) for r in rows)


def test_report_text(spark):
    f, e = found(spark), entries(spark)
    sbom = spark.createDataFrame([{"go_version": "v1.22", "modules": [{"path": "top", "version": ""}, {"path": "dep", "version": "v1.1.0"}, {"path": "stdlib", "version": "v1.22"}], "roots": ["top"]}], SBOM_DDL)
    got = report.render(e, f.where("osv <> 'V-3'"), "symbol", True, {"go_version": "v1.22", "scanner_name": "cordon", "scanner_version": "0", "db": "d"}, sbom)
    want = """Go: v1.22
Scanner: cordon@0
DB: d

The package pattern matched the following root package:
  top
cordon scanned the following 2 modules and the v1.22 standard library:
  top
  dep@v1.1.0

=== Symbol Results ===

Vulnerability #1: V-1
    Flaw 1
  More info: u1
  Module: dep
    Found in: dep@v1.0.0
    Fixed in: dep@v1.2.0
    Example traces found:
      #1: f.go:4:2: top.main calls p.F

=== Package Results ===

Vulnerability #1: V-2
    Flaw 2
  More info: u2
  Module: dep
    Found in: dep@v1.0.0
    Fixed in: N/A

=== Module Results ===

No other vulnerabilities found.

Your code is affected by 1 vulnerability from 1 module.
"""
    assert got == want, got


def test_sent_entries_and_flags(spark):
    from cordon.operators import findings, scan
    from cordon.schema import ENTRY

    names = lambda *xs: [{"package": {"name": x}} for x in xs]
    e = spark.createDataFrame([{"id": "A", "affected": names("a", "b", "b")}, {"id": "B", "affected": names("old")}, {"id": "C", "affected": []}, {"id": "D", "affected": names("fork")}, {"id": "E"}], ENTRY)
    mods = spark.createDataFrame([("a", "v1", None), ("b", "v1", None), ("old", "v1", ("fork", "v2"))], "path string, version string, replace struct<path:string,version:string>")
    got = {r.id: r.times for r in scan.sent_entries(mods, e).collect()}
    assert got["A"] == 2 and got["D"] == 1 and "C" not in got and "E" not in got
    assert sorted(tuple(r) for r in findings.flags(found(spark)).collect()) == [("V-1", True, True, True), ("V-2", False, True, True), ("V-3", False, False, True)]
    order = [(r.osv, r.trace[0].package or "") for r in found(spark).orderBy(*findings.stable_order()).collect()]
    assert order == [("V-3", ""), ("V-2", ""), ("V-2", "dep.org/q"), ("V-1", ""), ("V-1", "dep.org/p"), ("V-1", "dep.org/p")]
