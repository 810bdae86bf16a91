"""Which module a package belongs to, and the bill of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semver
from ..schema import STDLIB, UNKNOWN_MODULE, text


def is_standard(package: Column) -> Column:
    """A standard-library package: known, and without a dot in its first path element."""
    return (package != "") & (package != "unknown-package") & ~F.contains(F.substring_index(package, "/", 1), F.lit("."))


def prefixes(path: Column) -> Column:
    """A path's prefixes that end where an element ends, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def resolve(packages: DataFrame, modules: DataFrame, raw_prefix: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(package, module): the longest module path that is a prefix of the package's; standard packages go to the standard library.

    The prefixes of each package meet the modules in an equi-join. With ``raw_prefix`` any string prefix counts, not only one
    at the end of an element; then prefixes of all the modules' lengths are tried. Packages without a module go to the unknown one.
    ``by`` names further columns of both that tell programs apart.
    """
    known = modules.select(*by, F.col("path").alias("module")).distinct()
    if raw_prefix:
        lengths = [r[0] for r in known.select(F.length("module").alias("n")).distinct().orderBy("n").collect()]  # bounded by the longest path
        tries = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: F.when(n <= F.length("package"), F.substring("package", F.lit(1), n))), lambda x: x.isNotNull())
    else:
        tries = prefixes(F.col("package"))
    named = packages.select(*by, "package").distinct()
    std = F.when(is_standard(F.col("package")), F.array(F.lit(STDLIB))).otherwise(F.array().cast("array<string>"))
    asked = named.select(*by, "package", F.explode(F.concat(tries, std)).alias("module"))
    best = asked.join(known, [*by, "module"]).groupBy(*by, "package").agg(
        F.max_by("module", F.when(is_standard(F.col("package")) & (F.col("module") == STDLIB), F.lit(1 << 30)).otherwise(F.length("module"))).alias("module")
    )
    return named.join(best, [*by, "package"], "left").select(*by, "package", F.coalesce("module", F.lit(UNKNOWN_MODULE)).alias("module"))


def bill_of_materials(modules: DataFrame, roots: DataFrame) -> DataFrame:
    """A row (scan, go_version, modules, roots) for each scan: root modules first, then the others, each by path; replacements applied.

    ``modules``: scan, path, version, replace; ``roots``: scan, package, module of the packages that were asked for. A list is as long as one
    scan's program.
    """
    top = roots.select("scan", F.col("module").alias("path"), F.lit(True).alias("root")).distinct()
    r = F.col("replace")
    rows = modules.join(top, ["scan", "path"], "left").select(
        "scan",
        F.col("root").isNull().alias("later"),
        F.when(r.isNotNull(), r["path"]).otherwise(F.col("path")).alias("path"),
        F.when(r.isNotNull(), text(r["version"])).otherwise(text(F.col("version"))).alias("version"),
        (F.col("path") == STDLIB).alias("std"),
    )
    listed = rows.groupBy("scan").agg(
        F.max(F.when(F.col("std"), semver.to_tag(F.col("version")))).alias("go_version"),
        F.transform(F.array_sort(F.collect_list(F.struct("later", "path", "version"))), lambda m: F.struct(m["path"].alias("path"), m["version"].alias("version"))).alias("modules"),
    )
    named = roots.groupBy("scan").agg(F.array_sort(F.collect_set("package")).alias("roots"))
    return listed.join(named, "scan", "left").select("scan", text(F.col("go_version")).alias("go_version"), "modules", F.coalesce("roots", F.array().cast("array<string>")).alias("roots"))


def _stands_for(m: Column) -> Column:
    r = m["Replace"]
    return F.struct(F.when(r.isNotNull(), r["Path"]).otherwise(m["Path"]).alias("path"), F.when(r.isNotNull(), text(r["Version"])).otherwise(text(m["Version"])).alias("version"))


def binary_bill(binary: DataFrame) -> DataFrame:
    """(path, go_version, modules) of binary abstractions: the main module first, then in order with replacements, the standard library last."""
    other = F.transform("modules", _stands_for)
    main = F.when(F.col("main").isNotNull(), F.array(F.struct(F.col("main.Path").alias("path"), text(F.col("main.Version")).alias("version")))).otherwise(
        F.array().cast("array<struct<path:string,version:string>>")
    )
    std = F.array(F.struct(F.lit(STDLIB).alias("path"), semver.from_tag(F.col("goVersion")).alias("version")))
    return binary.select("path", F.col("goVersion").alias("go_version"), F.concat(main, other, std).alias("modules"))


def binary_modules(binary: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, path, version) rows of the same modules, for joins."""
    none = F.array().cast("array<struct<path:string,version:string>>")
    main = F.when(F.col("main").isNotNull(), F.array(F.struct(F.col("main.Path").alias("path"), text(F.col("main.Version")).alias("version")))).otherwise(none)
    std = F.array(F.struct(F.lit(STDLIB).alias("path"), semver.from_tag(F.col("goVersion")).alias("version")))
    rows = binary.select(*by, F.explode(F.concat(main, F.coalesce(F.transform("modules", _stands_for), none), std)).alias("m"))
    return rows.select(*by, "m.path", "m.version").distinct()


def binary_symbols(binary: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """(path, package, symbol) of binary abstractions; package ``main`` is the main package's path if that is known."""
    rows = binary.select(*by, F.col("path").alias("_main"), F.explode("pkgSymbols").alias("s"))
    named = F.when((F.col("s.pkg") == "main") & (text(F.col("_main")) != ""), F.col("_main")).otherwise(text(F.col("s.pkg")))
    return rows.select(*by, named.alias("package"), F.col("s.name").alias("symbol")).distinct()
