"""What decides how a query grows: shuffles of line items, rounds of a fixpoint, tasks of a writer. And that the cheaper ways give the same."""

from __future__ import annotations

import os
import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from cordon.functions import paths, ranges, semver
from cordon.operators import addresses, callgraph
from cordon.plans import QUERIES
from cordon.plans.views import Views
from cordon.schema import affected_rows
from cordon.tables import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_nonsuperseded_fix", "q_platform_filter", "q_platforms"])
def test_line_items_are_shuffled_once(spark, name):
    """F27, F30, F32: small rows of a supplier come together once; before, distinct symbols, their lists and the nested rows were shuffled one after another."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_modules_meet_rows_that_are_shuffled_before_they_grow(spark):
    """one shuffle of line items by supplier, one by module, and that of the modules."""
    plan = QUERIES["q_affecting"](spark, SF).select("path")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(s#") == 1 and plan.count("Exchange hashpartitioning(m#") == 1


def test_affected_rows_are_those_of_nested_entries(spark):
    v = Views(spark, SF)
    columns = ["osv", "entry", "withdrawn", "module", "ranges", "imports"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    nested = rows(affected_rows(v.entries()))
    assert nested and rows(v.affected()) == nested and rows(v.affected(by_module=True)) == nested


def test_zero_has_a_literal_key(spark):
    same, literal = spark.range(1).select(semver.key(F.lit("0")) == semver.zero(), ranges.keyed(F.expr("array(struct('SEMVER' AS type, array(struct('0' AS introduced, '' AS fixed)) AS events))"))).first()
    assert same and literal[0].events[0].at == spark.range(1).select(semver.key(F.lit("0"))).first()[0]


def test_types_spread_in_few_rounds(spark, monkeypatch):
    """a round takes several steps, and circles are not looked for first."""
    n, tables, write = 40, [], callgraph.written
    monkeypatch.setattr(callgraph, "written", lambda df, name: tables.append(name) or write(df, name))
    edges = [(str(i), str((i + 1) % n)) for i in range(n)] + [("3", "x"), ("x", "y"), ("y", "y"), ("p", "q")]
    marks = [("0", 1), ("0", 1), ("17", 2), ("p", 3)]
    got = callgraph.spread(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(marks, "node string, mark int")).collect()
    ring = [str(i) for i in range(n)] + ["x", "y"]
    assert sorted(map(tuple, got)) == sorted([(a, m) for a in ring for m in (1, 2)] + [("p", 3), ("q", 3)])
    assert len(tables) <= 2 + (n + 2) // callgraph.STEPS + 2


def test_messages_are_written_by_many_tasks(spark):
    """as many files as tasks read the events."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    base = f"{shared_dir(spark).removeprefix('file://')}/cordon"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    try:
        rows = QUERIES["q_message_files"](spark, SF).collect()
    finally:
        for k, x in held.items():
            spark.conf.set(k, x)
    (folder,) = [x for x in os.listdir(base) if x.startswith("messages-") and x not in before]
    assert len([x for x in os.listdir(f"{base}/{folder}") if x.startswith("part-")]) > 1
    assert sum(r.n for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count() and not any(r.doubled for r in rows)


def test_relative_paths_are_those_of_posix(spark):
    """the quick ways below a folder, beside it, and with dots."""
    rng = random.Random(3)
    made = lambda: "/" + "/".join(rng.choice(["a", "b", "..", ".", "", "a..b"]) for _ in range(rng.randrange(6)))
    pairs = [(made(), made()) for _ in range(300)] + [("/a/b", "/a/b/c"), ("/a", "/b"), ("/", "/a"), ("/a", "/a")]
    rows = spark.createDataFrame(pairs, "b string, p string").select("b", "p", paths.relative(F.col("b"), F.col("p")), paths.clean(F.col("p"))).collect()
    norm = lambda p: "/" + posixpath.normpath(p).lstrip("/")
    assert [r for r in rows if (r[2], r[3]) != (posixpath.relpath(norm(r.p), norm(r.b)), norm(r.p))] == []


def test_line_starts_take_one_shuffle_of_steps(spark, monkeypatch):
    """functions and steps meet in one window; neither is made distinct first, nor joined to what it met."""
    plans = []
    write = addresses.written
    monkeypatch.setattr(addresses, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    QUERIES["q_line_addresses"](spark, SF)
    (plan,) = plans
    assert len(re.findall(r"\bJoin\b", plan)) == 1 and len(re.findall(r"\bAggregate \[", plan)) == 2


def test_of_functions_with_one_start_the_greatest_counts(spark):
    functions = spark.createDataFrame([(1, 5, 100, 110), (1, 6, 100, 105), (1, 5, 100, 110), (1, 7, 200, 200), (1, 8, None, 300)], "program int, fn_id int, start long, stop long")
    steps = spark.createDataFrame([(1, 107, "a", 1), (1, 102, "a", 1), (1, 102, "a", 1), (1, 102, "b", 2), (1, 200, "c", 3), (1, None, "d", 4), (2, 102, "a", 1)], "program int, start long, file string, line int")
    asked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4), (1, "a", 2), (2, "a", 1)], "program int, file string, line int")
    got = {(r.program, r.file, r.line): (r.address, r.fn_id, r.error) for r in addresses.addresses_of(asked, functions, steps).collect()}
    none = (None, None, "unknown file")
    assert got == {(1, "a", 1): (102, 5, None), (1, "b", 2): (102, 5, None), (1, "c", 3): none, (1, "d", 4): none, (1, "a", 2): (None, None, "unknown line"), (2, "a", 1): none}
