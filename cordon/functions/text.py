"""What reports say: names, positions, messages and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEVELS, text
from . import semver


def split_pattern(pattern: Column) -> Column:
    """``module@version``, cut at the last ``@``; null unless both parts are there and the version is valid."""
    path, version = F.regexp_extract(pattern, r"\A(.+)@(.+)\z", 1), F.regexp_extract(pattern, r"\A(.+)@(.+)\z", 2)
    return F.when((path != "") & semver.valid(version), F.struct(path.alias("path"), version.alias("version")))


def assumed_name(package: Column) -> Column:
    """The name under which a package is likely imported: its last element, a ``vN`` and ``go-`` aside, up to a character that is in no identifier."""
    last = F.substring_index(package, "/", -1)
    before = F.substring_index(F.regexp_replace(package, r"/[^/]*\z", ""), "/", -1)
    base = F.when(last.rlike(r"\Av[0-9]+\z") & F.contains(package, F.lit("/")), before).otherwise(last)
    return F.regexp_extract(F.regexp_replace(base, r"\Ago-", ""), r"\A([A-Za-z0-9_\p{L}\p{Nd}&&[^\x00-\x2f]]*)", 1)


def function_name(frame: Column) -> Column:
    """Receiver without its star, and the function without closure numbers."""
    receiver = F.regexp_replace(text(frame["receiver"]), r"\A\*", "")
    name = F.substring_index(text(frame["function"]), "$", 1)
    return F.when(receiver == "", name).otherwise(F.concat(receiver, F.lit("."), name))


def symbol(frame: Column, short: bool = True) -> Column:
    package = text(frame["package"])
    shown = assumed_name(package) if short else package
    full = F.when(package == "", function_name(frame)).otherwise(F.concat(shown, F.lit("."), function_name(frame)))
    return F.when(text(frame["function"]) == "", "").otherwise(full)


def document_symbol(frame: Column) -> Column:
    """package.receiver.function, with the receiver's star."""
    return F.when(text(frame["function"]) == "", "").otherwise(F.concat_ws(".", *[F.nullif(text(frame[c]), F.lit("")) for c in ("package", "receiver", "function")]))


def position(p: Column) -> Column:
    return F.when(F.coalesce(p["line"], F.lit(0)) <= 0, "").otherwise(F.concat_ws(":", text(p["filename"]), p["line"].cast("string"), F.coalesce(p["column"], F.lit(0)).cast("string")))


def compact(trace: Column) -> Column:
    """The vulnerable symbol, up to two frames before the exit of the top module, and the exit frame."""
    top = F.element_at(trace, -1)["module"]
    first = F.array_position(F.transform(trace, lambda f: text(f["module"])), text(top)).cast("int") - 1
    n = F.size(trace)
    exit_ = F.when(first == 0, n - 1).otherwise(first)
    at = lambda i: F.slice(trace, i + 1, F.lit(1))
    empty = F.slice(trace, 1, 0)
    parts = F.concat(
        at(F.lit(0)),
        F.when(exit_ > 2, at(exit_ - 2)).otherwise(empty),
        F.when(exit_ > 1, at(exit_ - 1)).otherwise(empty),
        F.when(exit_ > 0, at(exit_)).otherwise(empty),
    )
    return F.when(n < 1, empty).otherwise(parts)


def compact_line(trace: Column) -> Column:
    """``position: A calls B, which eventually calls C`` of the compact trace."""
    c = compact(trace)
    n = F.size(c)
    where = position(F.element_at(c, -1)["position"])
    return F.when(n < 1, "").otherwise(
        F.concat(
            F.when(where == "", "").otherwise(F.concat(where, F.lit(": "))),
            F.when(n > 1, F.concat(symbol(F.element_at(c, -1)), F.lit(" calls "))).otherwise(""),
            F.when(n > 2, F.concat(symbol(F.get(c, n - 2)), F.lit(", which"), F.when(n > 3, " eventually").otherwise(""), F.lit(" calls "))).otherwise(""),
            symbol(F.get(c, F.lit(0))),
        )
    )


def english_list(xs: Column) -> Column:
    """``a``; ``a and b``; ``a, b, and c``."""
    n = F.size(xs)
    return (
        F.when(n <= 0, "")
        .when(n == 1, F.get(xs, F.lit(0)))
        .when(n == 2, F.array_join(xs, " and "))
        .otherwise(F.concat(F.array_join(F.slice(xs, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(xs, -1)))
    )


def purl(kind: str, module: Column, version: Column) -> Column:
    """A package URL of a type: the module escaped as one path segment."""
    escaped = F.url_encode(text(module))
    for a, b in (("+", "%20"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%40", "@"), ("%7E", "~"), ("*", "%2A")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.concat(F.lit(f"pkg:{kind}/"), escaped, F.when(text(version) == "", "").otherwise(F.concat(F.lit("@"), version)))


def level_of(frame: Column) -> Column:
    """3 for a called symbol, 2 for an imported package, 1 for a required module."""
    return F.when(text(frame["function"]) != "", 3).when(text(frame["package"]) != "", 2).otherwise(1)


def severity(level: Column, scan_level: str) -> Column:
    """error, warning or note, by the level found and the level that was scanned for."""
    if scan_level == "symbol":
        return F.when(level == 3, "error").when(level == 2, "warning").otherwise("note")
    if scan_level == "package":
        return F.when(level >= 2, "error").otherwise("warning")
    return F.lit("error")


def result_message(level: Column, elements: Column, scan_level: str) -> Column:
    """The message of a result: ``elements`` are the sorted packages (modules, at module level)."""
    n = F.size(elements)
    many = F.when(n == 1, "").otherwise("s")
    listed = F.concat(F.lit(" ("), english_list(elements), F.lit(")"))
    # fixed values: the texts of messages
    advice = ". Run the call-level analysis to understand whether your code actually calls the vulnerabilities."
    imports = ", but doesn’t appear to call any of the vulnerable symbols." if scan_level == "symbol" else advice
    verb = "call" if scan_level == "symbol" else "import"
    depends = f", but doesn't appear to {verb} any of the vulnerable symbols." if scan_level != "module" else advice
    said = (
        F.when(level == 3, F.concat(F.lit("calls vulnerable functions in "), n.cast("string"), F.lit(" package"), many, listed, F.lit(".")))
        .when(level == 2, F.concat(F.lit("imports "), n.cast("string"), F.lit(" vulnerable package"), many, listed, F.lit(imports)))
        .otherwise(F.concat(F.lit("depends on "), n.cast("string"), F.lit(" vulnerable module"), many, listed, F.lit(depends)))
    )
    return F.concat(F.lit("Your code "), said)


def file_location(frame: Column, top_module: Column) -> Column:
    """(uri, base): a file of the top module below SRCROOT, of the standard library below GOROOT, others below GOMODCACHE as module@version/file."""
    name = text(frame["position"]["filename"])
    own = text(frame["module"]) == top_module
    std = frame["module"] == "stdlib"
    uri = F.when(own | std, name).otherwise(F.concat(text(frame["module"]), F.lit("@"), text(frame["version"]), F.lit("/"), name))
    return F.struct(uri.alias("uri"), F.when(own, "SRCROOT").when(std, "GOROOT").otherwise("GOMODCACHE").alias("base"))


def exchange_status(level: Column, scan_level: str) -> Column:
    """(status, justification) of an exploitability statement."""
    reached = level >= LEVELS.index(scan_level) + 1
    return F.struct(
        F.when(reached, "affected").otherwise("not_affected").alias("status"),
        F.when(reached, F.lit(None).cast("string")).when(level == 2, "vulnerable_code_not_in_execute_path").otherwise("vulnerable_code_not_present").alias("justification"),
    )


def description(summary: Column, details: Column) -> Column:
    return F.when(text(summary) == "", text(details)).otherwise(summary)


def platforms(affected: Column, module: Column | None = None) -> Column:
    """Sorted os, os/arch or arch of the entry's packages; of one module if it is given and not empty."""
    rows = affected if module is None else F.filter(affected, lambda a: (module == "") | (text(a["package"]["name"]) == module))

    def of(p: Column) -> Column:
        goos, arch = (F.coalesce(p[c], F.array().cast("array<string>")) for c in ("goos", "goarch"))
        both = F.flatten(F.transform(goos, lambda o: F.transform(arch, lambda a: F.concat(o, F.lit("/"), a))))
        return F.when(F.size(arch) == 0, goos).when(F.size(goos) == 0, arch).otherwise(both)

    imports = F.flatten(F.transform(rows, lambda a: F.coalesce(a["ecosystem_specific"]["imports"], F.array())))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(imports, of))))


def review_status(c: Column) -> Column:
    """The text of a review status as its number; another text is an error."""
    t = text(c)
    return F.when(t == "", 0).when(t == "UNREVIEWED", 1).when(t == "REVIEWED", 2).otherwise(F.raise_error(F.concat(F.lit("unknown review status: "), t)))


def relative_file(filename: Column, directory: Column) -> Column:
    """A file below a directory, by slashes; other files as they are."""
    f, d = F.replace(text(filename), F.lit("\\"), F.lit("/")), F.concat(F.rtrim(F.replace(text(directory), F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
    return F.when((d != "/") & F.startswith(f, d), F.substring(f, F.length(d) + 1, F.length(f))).otherwise(f)
