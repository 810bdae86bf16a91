"""What must not grow with the tables on the driver: plans of joins, bounds of range partitions."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from cordon.operators import matching
from cordon.plans import QUERIES
from cordon.plans.views import Views
from cordon.schema import affected_rows
from cordon.sinks import lines
from cordon.tables import written

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_package_semi", "q_symbol_findings", "q_unique_symbols", "q_affecting"])
def test_modules_are_not_broadcast(spark, name):
    """Modules grow with the tables, however small their file."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda s: len(re.match(r"[ :+\-]*", s)[0])
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = plan[i + 1 :]
            end = next((k for k, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            assert not any("part.parquet" in x or "p_partkey" in x for x in below[:end]), line


def test_fixes_are_not_broadcast(spark):
    """Every affected row's ranges, keyed, are tens of times their file."""
    v = Views(spark, SF)
    affected = written(affected_rows(v.entries()), "affected")
    hits = matching.affecting(v.modules(), affected, F.lit("2024-06-01").cast("timestamp"))
    assert "BroadcastHashJoin" not in matching.with_fixed(hits, affected)._jdf.queryExecution().executedPlan().toString()


def test_range_bounds_hold_no_lines(spark, tmp_path):
    """A document's parts are cut by the place of its lines, as the bounds of ranges are a sample that the driver holds."""
    rows = spark.range(40).selectExpr("cast(id % 2 as int) AS section", "id % 5 AS n", "'' AS m", "concat(repeat('x', 1000), id) AS line")
    seen, kind = [], type(rows)
    write = kind.repartitionByRange
    kind.repartitionByRange = lambda self, n, *c: seen.append(c) or write(self, n, *c)
    try:
        lines.write_document(rows, f"{tmp_path}/d", 3)
    finally:
        kind.repartitionByRange = write
    assert seen == [("section", "n", "m")]
    want = [r.line for r in sorted(rows.collect(), key=lambda r: (r.section, r.n, r.m, r.line))]
    parts = [p.read_text().split("\n")[:-1] for p in sorted((tmp_path / "d").glob("part-*"))]
    assert [x for p in parts for x in p] == want


def test_lines_come_from_one_pass(spark):
    """Functions and line steps meet the addresses in one window over ranges, with one over each program's ranges; so no row is shuffled for each of them."""
    plan = QUERIES["q_address_lines"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 2
