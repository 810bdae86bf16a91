"""Paths as arrays of elements: cleaning, one relative to another, and files of modules that are vendored, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import text


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that it names several times, which is computed once for a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _elements(path: Column) -> Column:
    """A cleaned path's elements: without empty ones and ``.``; ``..`` takes the element before it, stays at the start of a relative path, and is nothing at a root."""
    rooted = F.startswith(path, F.lit("/"))
    none = F.array().cast("array<string>")

    def step(done: Column, e: Column) -> Column:
        back = (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        up = F.when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(rooted, done).otherwise(F.array_append(done, e))
        return F.when((e == "") | (e == "."), done).when(e == "..", up).otherwise(F.array_append(done, e))

    # most paths hold no dots that take an element back
    plain = F.array_remove(F.array_remove(F.split(path, "/"), ""), ".")
    return F.when(F.contains(path, F.lit("..")), F.aggregate(F.split(path, "/"), none, step)).otherwise(plain)


def _joined(rooted: Column, elements: Column) -> Column:
    return F.when(rooted, F.concat(F.lit("/"), F.array_join(elements, "/"))).when(F.size(elements) == 0, ".").otherwise(F.array_join(elements, "/"))


def clean(path: Column) -> Column:
    """The shortest equal path; an empty one is ``.``."""
    return _once(text(path), lambda p: _once(_elements(p), lambda e: _joined(F.startswith(p, F.lit("/")), e)))


def relative(base: Column, path: Column) -> Column:
    """A path as seen from a folder; null where one is rooted and the other is not, or the folder lies above by an unknown name (``..``)."""

    def parts(t: Column) -> Column:
        return F.struct(*[_elements(t[k]).alias(k) for k in "bp"])

    def seen(t: Column) -> Column:
        b, p = t["b"], t["p"]
        n = F.least(F.size(b), F.size(p))
        same = F.transform(F.arrays_zip(F.slice(b, F.lit(1), n).alias("x"), F.slice(p, F.lit(1), n).alias("y")), lambda z: z["x"] == z["y"])
        first = F.coalesce(F.nullif(F.array_position(same, False).cast("int"), F.lit(0)) - 1, n)
        # below the folder, or nothing in common: no need to look at each element
        quick = F.when(F.slice(p, F.lit(1), F.size(b)) == b, F.size(b)).when(F.get(b, F.lit(0)) != F.get(p, F.lit(0)), 0)
        return _once(quick.otherwise(first), lambda k: from_common(b, p, k))

    def from_common(b: Column, p: Column, k: Column) -> Column:
        out = F.concat(F.array_repeat(F.lit(".."), F.size(b) - k), F.slice(p, k + 1, F.size(p)))
        known = ~F.array_contains(F.slice(b, k + 1, F.size(b)), "..")
        return F.when(known, F.when(F.size(out) == 0, ".").otherwise(F.array_join(out, "/")))

    rooted = lambda c: F.startswith(c, F.lit("/"))
    alike = lambda t: rooted(t["b"]) == rooted(t["p"])
    return _once(F.struct(text(base).alias("b"), text(path).alias("p")), lambda t: F.when(alike(t), _once(parts(t), seen)))


def module_directory(directory: Column, path: Column, module: Column) -> Column:
    """A module's folder: as given, else that below the first ``vendor`` folder on the file's path, else empty."""
    before = F.substring_index(text(path), "/vendor/", 1)
    vendored = F.concat(before, F.lit("/vendor/"), text(module))
    return F.when(text(directory) != "", directory).when(F.contains(text(path), F.lit("/vendor/")), clean(vendored)).otherwise("")


def module_file(path: Column, directory: Column, module: Column, separator: str = "/") -> Column:
    """A file relative to its module's folder, by slashes; empty for an empty path or where no relative path exists.

    ``separator`` is that of the platform on which the paths were found; a module of unknown folder is seen from ``.``.
    """
    slashes = (lambda c: F.replace(text(c), F.lit(separator), F.lit("/"))) if separator != "/" else text
    p = slashes(path)
    return F.when(p == "", "").otherwise(text(relative(module_directory(slashes(directory), p, module), p)))


def shorter(path: Column, current: Column) -> Column:
    """A path relative to the current folder if that has fewer elements; else as it is."""
    whole = F.size(F.split(text(path), "/"))
    seen = _once(relative(current, path), lambda r: F.when(F.size(F.split(r, "/")) < whole, r).otherwise(path))
    return F.when(text(path) == "", "").otherwise(seen)
