"""Expressions over keys, descriptions and cells of a CSV with one column a locale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingoframe.functions.strings import found, stripped, strict_json

EMPTY, ARRAY, SCALAR = "empty array scalar".split()
TOKENS = (("format-slot", r"\{[0-9]+\}"), ("newline", r"\\n"))
#: Signs of a syntax that such files don't have; not looked for in arrays.
PROBES = (
    ("angle-tag", r"<[^>]+>"),
    ("html-entity", r"&[#0-9A-Za-z]+;"),
    ("bbcode", r"\[/?[A-Za-z][-=. _0-9A-Za-z]*\]"),
    ("curly-nonnum", r"\{[^0-9}][^}]*\}"),
    ("dollar-var", r"\$\{?[_A-Za-z]"),
    ("percent-spec", r"%[0-9]*[A-Za-z]"),
    ("at-var", r"@[a-zA-Z_]"),
    ("other-escape", r"\\[a-mo-zA-Z]"),
)
KEY_CONSTRUCTS = (("variant-suffix", r"-(-?[0-9]+)\z"), ("template-slot", r"(^|_)X(_|\z)"))


def namespace(key: Column) -> Column:
    """What stands before the first colon, '' without one."""
    return F.when(F.instr(key, ":") > 0, F.substring_index(key, ":", 1)).otherwise("")


def name(key: Column) -> Column:
    return F.when(F.instr(key, ":") > 0, F.substr(key, F.instr(key, ":") + 1)).otherwise(key)


def tags(description: Column) -> Column:
    """Bracketed words of a description, in order."""
    return found(description, r"\[([^\x5d]+)\]", 1)


def shape(value: Column) -> Column:
    """empty, array (exactly one JSON array) or scalar. A null counts as empty."""
    s = stripped(F.coalesce(value, F.lit("")))
    return F.when(s == "", EMPTY).when(s.startswith("[") & s.endswith("]") & strict_json(s), ARRAY).otherwise(SCALAR)


def elements(value: Column) -> Column:
    """Elements of an array cell as texts, else null."""
    return F.when(shape(value) == ARRAY, F.from_json(stripped(value), "array<string>"))


def slots(value: Column) -> Column:
    """Distinct numbers of the {N} slots, sorted as texts."""
    return F.array_sort(F.array_distinct(found(value, r"\{([0-9]+)\}", 1)))


def key_constructs(key: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.regexp_like(key, F.lit(p)), F.lit(kind)) for kind, p in KEY_CONSTRUCTS]))
