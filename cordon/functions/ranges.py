"""Version ranges of an advisory: containment, affectedness, fixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import semver

#: Ranges as they are compared: events sorted, each with the key of its version.
KEYED = f"array<struct<semver:boolean,events:array<struct<finite:int,at:{semver.KEY_TYPE},ord:int,enters:boolean>>>>"


def keyed(ranges: Column) -> Column:
    """Ranges with events in version order ("0" first, ties in given order), keys computed once.

    An event with an introduced version enters the affected region there, one with a fixed version leaves it; one
    with neither counts for nothing but makes a range not empty.
    """

    def event(e: Column, i: Column) -> Column:
        intro, fixed = F.coalesce(e["introduced"], F.lit("")), F.coalesce(e["fixed"], F.lit(""))
        version = F.when(intro != "", intro).otherwise(fixed)
        return F.struct(
            F.when(version == "0", 0).otherwise(1).alias("finite"),
            # most ranges begin at 0
            F.when(version == "0", semver.zero()).otherwise(semver.key(version)).alias("at"),
            i.alias("ord"),
            F.when(intro != "", True).when(fixed != "", False).alias("enters"),
        )

    return F.transform(
        ranges,
        lambda r: F.struct((F.coalesce(r["type"], F.lit("")) == "SEMVER").alias("semver"), F.array_sort(F.transform(F.coalesce(r["events"], F.array()), event)).alias("events")),
    )


def contains(keyed_range: Column, version_key: Column) -> Column:
    """Whether a keyed range holds a version: half-open intervals, walked in order; a range without events holds all."""
    events = keyed_range["events"]
    walked = F.aggregate(
        events,
        F.lit(False),
        lambda inside, e: F.when(~inside & e["enters"], (e["finite"] == 0) | (version_key >= e["at"])).when(inside & ~e["enters"], version_key < e["at"]).otherwise(inside),
    )
    return (F.size(events) == 0) | walked


def affects(keyed_ranges: Column, version_key: Column) -> Column:
    """No ranges, or none of semantic versions: affected; otherwise some range of semantic versions holds the version."""
    any_semver = F.exists(keyed_ranges, lambda r: r["semver"])
    return ~any_semver | F.exists(keyed_ranges, lambda r: r["semver"] & contains(r, version_key))


def usable(version: Column) -> Column:
    """A version that can be affected at all."""
    return ~F.coalesce(version, F.lit("")).isin("", "(devel)")


def latest_fix(ranges: Column) -> Column:
    """The latest fix that no later introduction supersedes; empty if there is none. Ranges count in the order given."""
    state = "struct<fix:string,at:" + semver.KEY_TYPE + ">"
    none = F.struct(F.lit("").alias("fix"), semver.lowest().alias("at")).cast(state)

    def later(acc: Column, e: Column) -> Column:
        fixed = F.coalesce(e["fixed"], F.lit(""))
        newer = lambda k: F.when(acc["at"] < k, F.struct(fixed.alias("fix"), k.alias("at"))).otherwise(acc)
        return F.when(fixed == "", acc).otherwise(semver.let(semver.key(fixed), newer))

    def one(acc: Column, r: Column) -> Column:
        events = F.coalesce(r["events"], F.array())

        def unless_back(best: Column) -> Column:
            back = F.exists(events, lambda e: ~F.coalesce(e["introduced"], F.lit("")).isin("", "0") & (best["at"] < semver.key(e["introduced"])))
            return F.when(back, none).otherwise(best)

        return F.when(F.coalesce(r["type"], F.lit("")) != "SEMVER", acc).otherwise(semver.let(F.aggregate(events, acc, later), unless_back))

    return F.aggregate(ranges, none, one)["fix"]


def fixes(ranges: Column) -> Column:
    """All fixed versions of ranges of semantic versions."""
    semver_ranges = F.filter(ranges, lambda r: F.coalesce(r["type"], F.lit("")) == "SEMVER")
    found = F.flatten(F.transform(semver_ranges, lambda r: F.transform(F.coalesce(r["events"], F.array()), lambda e: F.coalesce(e["fixed"], F.lit("")))))
    return F.filter(found, lambda f: f != "")


def earliest_fix(ranges: Column, keyed_ranges: Column, version_key: Column) -> Column:
    """The earliest fix above the version that lies in no range itself, with its ``v``; empty if there is none.

    ``ranges`` are all those of the module in the entry, ``keyed_ranges`` the same keyed.
    """
    candidates = F.transform(fixes(ranges), lambda f: F.struct(semver.key(f).alias("at"), f.alias("fix")))
    ok = F.filter(F.array_sort(candidates), lambda c: (version_key < c["at"]) & ~F.exists(keyed_ranges, lambda r: contains(r, c["at"])))
    first = F.coalesce(F.get(ok, F.lit(0))["fix"], F.lit(""))
    return semver.let(first, lambda f: F.when((f != "") & ~f.startswith("v"), F.concat(F.lit("v"), f)).otherwise(f))
