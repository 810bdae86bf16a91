"""Schemas of advisories, programs and messages, and what a missing field means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = "STRUCT<introduced: STRING, fixed: STRING>"
RANGE = f"STRUCT<type: STRING, events: ARRAY<{EVENT}>>"
IMPORT = "STRUCT<path: STRING, goos: ARRAY<STRING>, goarch: ARRAY<STRING>, symbols: ARRAY<STRING>>"
AFFECTED = f"STRUCT<package: STRUCT<name: STRING, ecosystem: STRING>, ranges: ARRAY<{RANGE}>, ecosystem_specific: STRUCT<imports: ARRAY<{IMPORT}>>>"
ENTRY_DDL = (
    "schema_version STRING, id STRING, modified TIMESTAMP, published TIMESTAMP, withdrawn TIMESTAMP, aliases ARRAY<STRING>, summary STRING, details STRING, "
    f"affected ARRAY<{AFFECTED}>, references ARRAY<STRUCT<type: STRING, url: STRING>>, credits ARRAY<STRUCT<name: STRING>>, "
    "database_specific STRUCT<url: STRING, review_status: STRING>"
)
POSITION = "STRUCT<filename: STRING, offset: INT, line: INT, column: INT>"
FRAME = f"STRUCT<module: STRING, version: STRING, package: STRING, function: STRING, receiver: STRING, position: {POSITION}>"
FINDING_DDL = f"osv STRING, fixed_version STRING, trace ARRAY<{FRAME}>"
CONFIG_DDL = (
    "protocol_version STRING, scanner_name STRING, scanner_version STRING, db STRING, db_last_modified TIMESTAMP, go_version STRING, scan_level STRING, scan_mode STRING"
)
SBOM_DDL = "go_version STRING, modules ARRAY<STRUCT<path: STRING, version: STRING>>, roots ARRAY<STRING>"


MESSAGE = (
    f"config STRUCT<{CONFIG_DDL}>, progress STRUCT<time: TIMESTAMP, message: STRING>, SBOM STRUCT<{SBOM_DDL}>, osv STRUCT<{ENTRY_DDL}>, finding STRUCT<{FINDING_DDL}>"
)
ENTRY = ENTRY_DDL
FINDING = FINDING_DDL
INDEX_MODULES_DDL = "path STRING, vulns ARRAY<STRUCT<id: STRING, modified: TIMESTAMP, fixed: STRING>>"
BINARY_DDL = (
    "path STRING, main STRUCT<Path: STRING, Version: STRING>, "
    "modules ARRAY<STRUCT<Path: STRING, Version: STRING, Replace: STRUCT<Path: STRING, Version: STRING>>>, "
    "pkgSymbols ARRAY<STRUCT<pkg: STRING, name: STRING>>, goVersion STRING, goos STRING, goarch STRING"
)

#: Names of pseudo-modules and of what can't be attributed.
STDLIB, TOOLCHAIN = "stdlib", "toolchain"
UNKNOWN_MODULE, UNKNOWN_PACKAGE = "unknown-module", "unknown-package"

LEVELS = ("module", "package", "symbol")


def text(c: Column) -> Column:
    """A missing string is the empty one."""
    return F.coalesce(c, F.lit(""))


def items(c: Column, kind: str) -> Column:
    """A missing list is the empty one."""
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def entry_key(entries: DataFrame) -> Column:
    """What tells entries apart: their column ``entry``, if they have one, as ids may be shared; else the id."""
    return F.col("entry" if "entry" in entries.columns else "id")


def affected_rows(entries: DataFrame) -> DataFrame:
    """One row for each affected module of each entry: osv, entry, withdrawn, ordinal, module, ranges, imports.

    This is the form in which entries are joined; nested lists keep their order, nulls become empty.
    """
    return entries.select(F.col("id").alias("osv"), entry_key(entries).alias("entry"), "withdrawn", F.posexplode("affected").alias("ordinal", "a")).select(
        "osv",
        "entry",
        "withdrawn",
        "ordinal",
        text(F.col("a.package.name")).alias("module"),
        items(F.col("a.ranges"), RANGE).alias("ranges"),
        items(F.col("a.ecosystem_specific.imports"), IMPORT).alias("imports"),
    )
