"""Names of functions as linkers and loaders write them, type arguments included, as column expressions.

Type arguments stand between the first ``[`` and the last ``]`` of a name; dots and slashes between them belong to other names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import text

#: What names start with that a compiler made, by the release of the toolchain (minor version): up to 18, and from 20 on. Between them none counts.
MADE_UP_TO_18, MADE_FROM_20 = ("go.", "type."), ("go:", "type:")


def without_arguments(name: Column) -> Column:
    """A name less all from its first ``[`` to its last ``]``; as it is if either is missing or they stand the other way round."""
    return F.regexp_replace(text(name), r"(?s)\A([^\[]*)\[.*\]", "$1")


def _parts(name: Column) -> tuple[Column, Column, Column]:
    """Without arguments: all up to before the last slash; the slash and all that follows; how much longer the arguments make the name."""
    plain = without_arguments(name)
    head = F.regexp_extract(plain, r"(?s)\A(.*)/[^/]*\z", 1)
    return head, F.substring(plain, F.length(head) + 1, F.length(plain)), F.length(text(name)) - F.length(plain)


def package_of(name: Column, minor: Column | int = 20) -> Column:
    """The package of a function's name: up to the first dot after the last slash; empty where there is none, or the compiler made the name."""
    release = F.lit(minor) if isinstance(minor, int) else minor
    head, tail, _ = _parts(name)
    starts = lambda ps: F.startswith(text(name), F.lit(ps[0])) | F.startswith(text(name), F.lit(ps[1]))
    made = ((release >= 20) & starts(MADE_FROM_20)) | ((release <= 18) & starts(MADE_UP_TO_18))
    return F.when(made | ~F.contains(tail, F.lit(".")), "").otherwise(F.concat(head, F.substring_index(tail, ".", 1)))


def receiver_of(name: Column) -> Column:
    """What stands between the first and the last dot after the last slash, type arguments included; empty if there are no two such dots.

    The last dot is that of the whole name, as a method follows its receiver's arguments.
    """
    head, tail, _ = _parts(name)
    rest = F.substring(text(name), F.length(head) + 1, F.length(text(name)))
    two = F.length(tail) - F.length(F.replace(tail, F.lit("."), F.lit(""))) >= 2
    return F.when(two, F.regexp_extract(rest, r"(?s)\A[^.]*\.(.*)\.[^.]*\z", 1)).otherwise("")


def base_of(name: Column) -> Column:
    """What follows the last dot that is in no type argument, with arguments that follow it."""
    whole, plain = text(name), without_arguments(name)
    last = F.length(plain) - F.length(F.substring_index(plain, ".", -1))
    bracket = F.instr(whole, "[")
    after = (whole != plain) & (last > bracket)
    return F.when(~F.contains(plain, F.lit(".")), whole).when(after, F.substring_index(whole, ".", -1)).otherwise(F.substring(whole, last + 1, F.length(whole)))


def bare_receiver(receiver: Column, package: Column) -> Column:
    """A receiver type without the first mention of its package; a pointer's star stays."""
    r, p = text(receiver), F.concat(text(package), F.lit("."))
    at = F.locate_in(r, p) if hasattr(F, "locate_in") else F.position(p, r)
    return F.when(at > 0, F.concat(F.substring(r, F.lit(1), at - 1), F.substring(r, at + F.length(p), F.length(r)))).otherwise(r)


def shown(receiver: Column, package: Column, name: Column) -> Column:
    """``receiver.name``, or ``package.name`` of a function without receiver."""
    return F.concat(F.when(text(receiver) == "", text(package)).otherwise(receiver), F.lit("."), text(name))
