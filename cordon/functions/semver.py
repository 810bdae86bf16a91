"""Semantic versions as column expressions: validity, a sortable key, order, and toolchain tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = r"(?:0|[1-9][0-9]*)"
_PRE = rf"(?:{_NUM}|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
#: v1, v1.2, v1.2.3, v1.2.3-pre.1+build; numeric identifiers have no leading zeros.
PATTERN = rf"\Av({_NUM})(?:\.({_NUM})(?:\.({_NUM})(?:-({_PRE}(?:\.{_PRE})*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?)?)?\z"

KEY_TYPE = (
    "struct<ok:int,major:struct<len:int,digits:string>,minor:struct<len:int,digits:string>,patch:struct<len:int,digits:string>,"
    "release:int,pre:array<struct<kind:int,len:int,text:string>>>"
)
_NO_PRE = "array<struct<kind:int,len:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it: inside lambdas Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical(v: Column) -> Column:
    """One leading ``v``, then one leading ``go``, give way to one ``v``, unless what is left begins with either."""

    def bare(t: Column) -> Column:
        cut = F.when(t.startswith("vgo"), 4).when(t.startswith("go"), 3).when(t.startswith("v"), 2).otherwise(1)
        return let(F.substring(t, cut, F.length(t)), lambda b: F.when(b.startswith("v") | b.startswith("go"), b).otherwise(F.concat(F.lit("v"), b)))

    return let(F.coalesce(v, F.lit("")), bare)


def valid(v: Column) -> Column:
    return canonical(v).rlike(PATTERN)


def lowest() -> Column:
    """The key of every invalid version, of literals only."""
    zero = F.struct(F.lit(0).alias("len"), F.lit("").alias("digits"))
    none = F.struct(F.lit(0).alias("ok"), zero.alias("major"), zero.alias("minor"), zero.alias("patch"), F.lit(0).alias("release"), F.array().cast(_NO_PRE).alias("pre"))
    return none.cast(KEY_TYPE)


def zero() -> Column:
    """The key of version 0, of literals only."""
    n = F.struct(F.lit(1).alias("len"), F.lit("0").alias("digits"))
    key = F.struct(F.lit(1).alias("ok"), n.alias("major"), n.alias("minor"), n.alias("patch"), F.lit(1).alias("release"), F.array().cast(_NO_PRE).alias("pre"))
    return key.cast(KEY_TYPE)


def key(v: Column) -> Column:
    """A struct whose order is the versions': invalid ones are equal and below all others.

    The expression is large; make it a column once, where versions are loaded, and compare that column.
    """

    def of(parts: Column) -> Column:
        def number(i: int) -> Column:
            digits = F.when(parts[i] == "", F.lit("0")).otherwise(parts[i])
            return F.struct(F.length(digits).alias("len"), digits.alias("digits"))

        def identifier(x: Column) -> Column:
            return let(x.rlike(r"\A[0-9]+\z"), lambda n: F.struct(F.when(n, 0).otherwise(1).alias("kind"), F.when(n, F.length(x)).otherwise(0).alias("len"), x.alias("text")))

        return F.struct(
            F.lit(1).alias("ok"),
            number(0).alias("major"),
            number(1).alias("minor"),
            number(2).alias("patch"),
            F.when(parts[3] == "", 1).otherwise(0).alias("release"),
            F.when(parts[3] == "", F.array().cast(_NO_PRE)).otherwise(F.transform(F.split(parts[3], r"\."), identifier)).alias("pre"),
        )

    # a canonical version never begins with "=", so only a match does; its parts hold no blank
    matched = F.regexp_replace(canonical(v), PATTERN, "=$1 $2 $3 $4")
    return let(matched, lambda m: F.when(m.startswith("="), let(F.split(F.substring(m, 2, 1 << 30), " ", -1), of)).otherwise(lowest()))


def less(a: Column, b: Column) -> Column:
    return key(a) < key(b)


def from_tag(tag: Column) -> Column:
    """A toolchain's tag (``go1.20rc1``, ``go1.20-pre4``; first field) as a version; empty if it is none."""
    t = F.regexp_extract(F.coalesce(tag, F.lit("")), r"\A\s*(\S*)", 1)
    shape = r"\Ago([0-9]+\.[0-9]+)(\.[0-9]+)?(?:-?(beta|rc|pre)(?:\.?)([0-9]+))?\z"
    patch = F.when(F.regexp_extract(t, shape, 2) == "", ".0").otherwise(F.regexp_extract(t, shape, 2))
    pre = F.when(F.regexp_extract(t, shape, 3) == "", "").otherwise(F.concat(F.lit("-"), F.regexp_extract(t, shape, 3), F.lit("."), F.regexp_extract(t, shape, 4)))
    return (
        F.when(t == "go1", "v1.0.0")
        .when((t == "go1.0") | ~t.rlike(shape), "")
        .otherwise(F.concat(F.lit("v"), F.regexp_extract(t, shape, 1), patch, pre))
    )


def _tag_parts(v: Column) -> tuple[Column, Column, Column, Column]:
    c = canonical(v)
    part = lambda i: F.when(F.regexp_extract(c, PATTERN, i) == "", "0").otherwise(F.regexp_extract(c, PATTERN, i))
    return part(1), part(2), part(3), F.regexp_extract(c, PATTERN, 4)


def to_tag(v: Column) -> Column:
    """A version as the toolchain's tag: ``.0`` stays from 1.21 on for releases, a pre-release keeps its ``-``; empty if invalid."""
    major, minor, patch, pre = _tag_parts(v)
    stays = (pre == "") & ((major.cast("int") > 1) | ((major.cast("int") == 1) & (minor.cast("int") >= 21)))
    plain = F.concat(major, F.lit("."), minor)
    number = F.when((patch != "0") | stays, F.concat(plain, F.lit("."), patch)).when(minor == "0", major).otherwise(plain)
    named = r"\A(alpha|beta|rc|pre)\.([0-9]+)\z"
    end = F.when(pre == "", "").when(pre.rlike(named), F.concat(F.lit("-"), F.regexp_replace(pre, named, "$1$2"))).otherwise(F.concat(F.lit("-"), pre))
    return F.when(valid(v), F.concat(F.lit("go"), number, end)).otherwise("")


def display_tag(v: Column) -> Column:
    """As reports print it: ``v0.0.0...`` is ``master``, ``.0`` and the ``-`` always go; invalid versions say so."""
    major, minor, patch, pre = _tag_parts(v)
    number = F.when(patch == "0", F.concat(major, F.lit("."), minor)).otherwise(F.concat(major, F.lit("."), minor, F.lit("."), patch))
    end = F.when(pre == "", "").otherwise(F.regexp_replace(pre, r"\A(alpha|beta|rc|pre)\.", "$1"))
    return (
        F.when(canonical(v).startswith("v0.0.0"), "master")
        .when(~valid(v), F.concat(F.lit("<invalid version "), F.coalesce(v, F.lit("")), F.lit(">")))
        .otherwise(F.concat(F.lit("go"), number, end))
    )


def module_version(module: Column, version: Column) -> Column:
    """What a report prints for a module's version: a tag for the standard library and the toolchain."""
    return F.when(F.coalesce(version, F.lit("")) == "", "").when(module.isin("stdlib", "toolchain"), display_tag(version)).otherwise(version)
