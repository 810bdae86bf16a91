from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from cordon.functions import ranges as R
from cordon.functions import semver as S
from cordon.schema import RANGE

ORDER = ["", "v0.0.0-0.20200101000000-abc", "v0.0.0", "v0.9.10", "v1.0.0-1", "v1.0.0-2", "v1.0.0-10", "v1.0.0-a", "v1.0.0-a.1", "v1.0.0-a.b", "v1.0.0", "v1.0.10", "v1.2", "go1.12.3", "v1.18", "2.0.0"]


def test_order(spark):
    rows = [(a, b, i < j) for (i, a), (j, b) in itertools.product(enumerate(ORDER), repeat=2)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select("*", S.less(F.col("a"), F.col("b")).alias("got")).where("want <> got").collect()
    assert got == []


def test_validity(spark):
    good = ["v1", "1.2", "go1.2.3", "v1.2.3-a.0", "v1.2.3+b.01", "v10.20.30-x-y.7z+b"]
    bad = [None, "", "v", "v1.", "v01.2.3", "v1.2-a", "v1.2.3-", "v1.2.3-01", "v1.2.3+", "latest", "v1.2.3.4"]
    df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "v string, want boolean")
    assert df.where(S.valid(F.col("v")) != F.col("want")).collect() == []
    assert df.where("NOT want").select(S.key(F.col("v")).alias("k")).distinct().count() == 1


def test_tags(spark):
    df = spark.createDataFrame([("go1.7", "v1.7.0"), ("go1.7.3 X:y", "v1.7.3"), ("go1.8rc2", "v1.8.0-rc.2"), ("go1", "v1.0.0"), ("go1.0", ""), ("devel +abc", ""), (None, "")], "t string, want string")
    assert df.where(S.from_tag(F.col("t")) != F.col("want")).collect() == []
    df = spark.createDataFrame([("v1.7.0", "go1.7", "go1.7"), ("v1.21.0", "go1.21.0", "go1.21"), ("v1.22.1", "go1.22.1", "go1.22.1"), ("v1.8.0-rc.2", "go1.8-rc2", "go1.8rc2"), ("v2.0.0", "go2.0.0", "go2.0")], "v string, t string, d string")
    assert df.where((S.to_tag(F.col("v")) != F.col("t")) | (S.display_tag(F.col("v")) != F.col("d"))).collect() == []


def event(introduced=None, fixed=None):
    return (introduced, fixed)


def test_ranges(spark):
    semver = lambda *e: ("SEMVER", list(e))
    two = semver(event("0"), event(None, "1.3.0"), event("2.0.0"), event(None, "2.4.0"))
    cases = [
        ([], "v5.0.0", True), ([semver()], "v5.0.0", True), ([("GIT", [event("9.0.0")])], "v5.0.0", True), ([("GIT", []), semver(event("9.0.0"))], "v5.0.0", False),
        ([two], "v1.2.9", True), ([two], "v1.3.0", False), ([two], "v2.0.0-rc.1", False), ([two], "v2.0.0", True), ([two], "v2.4.0", False), ([("SEMVER", two[1][::-1])], "v2.1.0", True),
        ([semver(event(None, None))], "v1.0.0", False),
    ]
    df = spark.createDataFrame(cases, f"r array<{RANGE}>, v string, want boolean")
    assert df.where(R.affects(R.keyed(F.col("r")), S.key(F.col("v"))) != F.col("want")).collect() == []


def test_fixes(spark):
    semver = lambda *e: ("SEMVER", list(e))
    latest = [([], ""), ([semver(event("0"), event(None, "1.3.0"))], "1.3.0"), ([semver(event("0"), event(None, "1.3.0"), event("1.9.0"))], ""), ([semver(event(None, "1.3.0")), semver(event(None, "1.10.0"))], "1.10.0"), ([("GIT", [event(None, "7.0.0")])], "")]
    df = spark.createDataFrame(latest, f"r array<{RANGE}>, want string")
    assert df.where(R.latest_fix(F.col("r")) != F.col("want")).collect() == []
    earliest = [
        ([semver(event("0"), event(None, "1.3.0"), event("2.0.0"), event(None, "2.4.0"))], "v1.0.0", "v1.3.0"),
        ([semver(event("0"), event(None, "1.3.0")), semver(event("1.2.0"), event(None, "1.5.0"))], "v1.0.0", "v1.5.0"),
        ([semver(event("0"), event(None, "1.3.0"))], "v1.3.0", ""),
        ([semver(event("0"))], "v1.0.0", ""),
    ]
    df = spark.createDataFrame(earliest, f"r array<{RANGE}>, v string, want string")
    assert df.where(R.earliest_fix(F.col("r"), R.keyed(F.col("r")), S.key(F.col("v"))) != F.col("want")).collect() == []


def test_fold_equals_intervals(spark):
    """On well-formed ranges the walk and the two comparisons agree."""
    from cordon.operators import matching

    rng = random.Random(1)
    rows = []
    for k in range(60):
        cuts = sorted(rng.sample(range(30), rng.randint(1, 5)))
        ev = [event(f"1.{c}.0" if i or rng.random() < 0.5 else "0") if i % 2 == 0 else event(None, f"1.{c}.0") for i, c in enumerate(cuts)]
        rows.append((f"o{k}", None, 0, "m", [("SEMVER", rng.sample(ev, len(ev)))], []))
    affected = spark.createDataFrame(rows, f"osv string, withdrawn timestamp, ordinal int, module string, ranges array<{RANGE}>, imports array<struct<path:string,goos:array<string>,goarch:array<string>,symbols:array<string>>>")
    modules = spark.createDataFrame([("m", f"v1.{i}.{j}") for i in range(31) for j in (0, 1)] + [("m", ""), ("m", "(devel)")], "path string, version string")
    walk = matching.affecting(modules, affected, F.lit("2024-01-01").cast("timestamp")).select("path", "version", "osv").distinct()
    cut = matching.affecting_intervals(modules, matching.intervals(affected))
    assert walk.count() > 100 and walk.exceptAll(cut).isEmpty() and cut.exceptAll(walk).isEmpty()
