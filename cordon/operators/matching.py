"""Modules against advisories: the filter by range, time and platform, and matches of packages and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges, semver
from ..schema import text
from ..tables import shuffled, written


def current(withdrawn: Column, now: Column) -> Column:
    """Not withdrawn by ``now``; a later withdrawal doesn't count yet."""
    return withdrawn.isNull() | (withdrawn >= now)


def on_platform(imp: Column, goos: str | Column, goarch: str | Column) -> Column:
    """An empty platform, or a package without a list, matches all. The platform may be each row's own."""

    def side(listed: Column, name: str | Column) -> Column:
        if isinstance(name, str) and name == "":
            return F.lit(True)
        held = (F.coalesce(F.size(listed), F.lit(0)) <= 0) | F.coalesce(F.array_contains(listed, name), F.lit(False))
        return held if isinstance(name, str) else (text(name) == "") | held

    return side(imp["goos"], goos) & side(imp["goarch"], goarch)


def pruned(affected: DataFrame, goos: str | Column = "", goarch: str | Column = "") -> DataFrame:
    """Affected rows with only the packages of the platform; a row that had packages and has none left goes."""
    kept = F.filter("imports", lambda i: on_platform(i, goos, goarch))
    return affected.withColumn("had", F.size("imports")).withColumn("imports", kept).where("had = 0 OR size(imports) > 0").drop("had")


def keyed(affected: DataFrame) -> DataFrame:
    """Affected rows with their ranges keyed, once for each row instead of once for each comparison."""
    return affected.withColumn("keyed", ranges.keyed(F.col("ranges")))


def affecting(modules: DataFrame, affected: DataFrame, now: Column, goos: str = "", goarch: str = "", by_module: bool = False) -> DataFrame:
    """Affected rows that hold for modules: the columns of ``modules`` (path, version, ...) and osv, entry, ordinal, ranges, keyed, imports.

    An equi-join on the module path, its range test in the condition. Versions that are empty or under
    development are affected by nothing. Both sides are shuffled by path, rows before their ranges are keyed, as keys are the larger;
    with ``by_module`` they are shuffled by it already.
    """
    rows = pruned(affected.where(current(F.col("withdrawn"), now)), goos, goarch)
    rows = keyed(rows if by_module else rows.repartition("module"))
    usable = modules.where(ranges.usable(F.col("version"))).withColumn("version_key", semver.key(F.col("version")))
    hit = (F.col("path") == F.col("module")) & ranges.affects(F.col("keyed"), F.col("version_key"))
    return shuffled(usable).join(rows, hit).drop("module", "withdrawn")


def intervals(affected: DataFrame) -> DataFrame:
    """(osv, entry, module, lo, hi): each range of semantic versions as half-open intervals of keys; null is unbounded.

    For well-formed ranges only (introductions and fixes alternate); then the range test is two comparisons.
    """
    own = affected if "entry" in affected.columns else affected.withColumn("entry", F.col("osv"))
    e = keyed(own).select("osv", "entry", "module", F.explode(F.filter("keyed", lambda r: r["semver"])).alias("r")).select("osv", "entry", "module", F.col("r.events").alias("ev"))
    starts = F.filter(
        F.transform(
            "ev", lambda x, i: F.struct(x.alias("e"), F.get("ev", i + 1)["at"].alias("hi"))
        ),
        lambda s: s["e"]["enters"],
    )
    return e.select("osv", "entry", "module", F.explode(starts).alias("s")).select("osv", "entry", "module", F.when(F.col("s.e.finite") == 1, F.col("s.e.at")).alias("lo"), F.col("s.hi").alias("hi"))


def affecting_intervals(modules: DataFrame, cuts: DataFrame) -> DataFrame:
    """``affecting`` over ``intervals``: (path, version, osv), once for each entry."""
    usable = modules.where(ranges.usable(F.col("version"))).withColumn("k", semver.key(F.col("version")))
    inside = (F.col("path") == F.col("module")) & (F.col("lo").isNull() | (F.col("lo") <= F.col("k"))) & (F.col("hi").isNull() | (F.col("k") < F.col("hi")))
    return shuffled(usable).join(cuts, inside).select("path", "version", "osv", "entry").distinct().drop("entry")


def with_fixed(matched: DataFrame, affected: DataFrame, by: str = "osv") -> DataFrame:
    """``matched`` (with path, version, version_key, osv) and fixed_version: the earliest fix in no range of the entry's module.

    Entries that share an id count as one, as findings name nothing but the id; with ``by`` entry each stands by itself.
    """
    own = affected.groupBy(by, "module").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "ranges"))), lambda x: x["ranges"])).alias("all_ranges"))
    own = own.withColumn("all_keyed", ranges.keyed(F.col("all_ranges")))
    joined = matched.join(shuffled(own.withColumnRenamed(by, "o")), (F.col(by) == F.col("o")) & (F.col("path") == F.col("module")))
    return joined.withColumn("fixed_version", ranges.earliest_fix(F.col("all_ranges"), F.col("all_keyed"), F.col("version_key"))).drop("o", "module", "all_ranges", "all_keyed")


def targets(matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, osv, package, symbol): what affecting rows name; a null package is the whole module, a null symbol the whole package.

    Exploded, so that matching packages and symbols are equi-joins. ``by`` names further columns that tell programs apart, here and below.
    """
    p = matched.select(*by, "path", "osv", F.explode_outer("imports").alias("i"))
    return p.select(*by, "path", "osv", F.col("i.path").alias("package"), F.explode_outer("i.symbols").alias("symbol"))


def for_packages(packages: DataFrame, matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``packages`` (path, package) with the entries that match them, each once: (path, package, osv)."""
    t = written(targets(matched, by).select(*by, "path", "osv", F.col("package").alias("target")).distinct(), "targets")
    own, packages = [*by, "path"], shuffled(packages)
    named = packages.join(t.where("target IS NOT NULL").withColumnRenamed("target", "package"), [*own, "package"]).select(*own, "package", "osv")
    whole = packages.join(t.where("target IS NULL"), own).select(*own, "package", "osv")
    return named.unionByName(whole).distinct()


def for_symbols(symbols: DataFrame, matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``symbols`` (path, package, symbol) with the entries that match them: (path, package, symbol, osv)."""
    t = written(targets(matched, by).distinct(), "targets")
    own, symbols = [*by, "path"], shuffled(symbols)
    out = [*own, "package", "symbol", "osv"]
    exact = symbols.join(t.where("symbol IS NOT NULL"), [*own, "package", "symbol"]).select(*out)
    package = symbols.join(t.where("package IS NOT NULL AND symbol IS NULL").drop("symbol"), [*own, "package"]).select(*out)
    module = symbols.join(t.where("package IS NULL").drop("package", "symbol"), own).select(*out)
    return exact.unionByName(package).unionByName(module).distinct()


def known_symbols(matched: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(path, osv, package, symbol) of all affected symbols, ``<package>/*`` where none is listed: for programs without symbols."""
    p = matched.select(*by, "path", "osv", F.explode("imports").alias("i"))
    none = F.coalesce(F.size("i.symbols"), F.lit(0)) <= 0
    listed = F.when(none, F.array(F.concat(F.col("i.path"), F.lit("/*")))).otherwise(F.col("i.symbols"))
    return p.select(*by, "path", "osv", F.col("i.path").alias("package"), F.explode(listed).alias("symbol")).distinct()


def unique_symbols(found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(osv, package, path, symbol) without unexported symbols of a group that has an exported one."""
    exported = F.substring_index(F.col("symbol"), ".", -1).rlike(r"\A[A-Z]")
    group = [*by, "osv", "package", "path"]
    best = found.groupBy(*group).agg(F.max(exported).alias("any_exported"))
    return shuffled(found).join(best, group).where(exported | ~F.col("any_exported")).drop("any_exported")


def replaced(modules: DataFrame) -> DataFrame:
    """Modules (path, version, replace) as what they stand for, with the original path."""
    r = F.col("replace")
    return modules.select(F.col("path").alias("original"), F.when(r.isNotNull(), r["path"]).otherwise(F.col("path")).alias("path"), F.when(r.isNotNull(), text(r["version"])).otherwise(text(F.col("version"))).alias("version"))
