"""Expressions over keys and values of Clausewitz localisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingoframe.functions.strings import found, squeezed

COLOURS = "YGRHLTWOgbB"
INLINE = (
    ("colour-open", r"§[A-Za-z]"),
    ("colour-close", r"§!"),
    ("icon", r"(?U)£\w+"),
    ("flag", r"@[A-Z]{3}"),
    ("variable", r"\$[^$]*\$"),
    ("scope-fn", r"\[[^\]]*\]"),
    ("newline", r"\\n"),
)
#: Syntax of another dialect: any of these is drift.
PROBES = (("other-escape", r"\\[A-Za-z&&[^nt]]"), ("newstyle-fmt", r"(?U)#\w+\b[^#]*[#]!"), ("newstyle-icon", r"(?U)@\w+!"), ("curly-brace", r"\{[^}]*\}"))
CLEANED = (r"\[[^\]]*\]", r"\$[^$]*\$", r"(?U)£\w+", r"@[A-Z]{3}", r"§[A-Za-z]", r"§!", r"\\n", r"\\t")
CORE_PARTS = {"title": ("t", "title"), "body": ("d", "desc", "warning"), "tooltip": ("tt",), "option": ("do", "opt")}
REFERENCE = r"\$([^$|]+)(\|[^$]*)?\$"


def _pieces(key: Column) -> Column:
    return F.split(key, r"\.")


def _number_at(key: Column) -> Column:
    """Place (from 1) of the first all-digit segment, 0 without one."""
    return F.array_position(F.transform(_pieces(key), lambda s: F.regexp_like(s, F.lit(r"(?U)^\d+\z"))), True)


def is_dotted(key: Column) -> Column:
    return key.contains(".") & (_number_at(key) > 0)


def namespace(key: Column) -> Column:
    """Segments before the first number of a key with dots; '' for others."""
    at = _number_at(key)
    head = F.when(at > 0, F.slice(_pieces(key), F.lit(1), (at - 1).cast("int"))).otherwise(_pieces(key))
    return F.when(key.contains("."), F.array_join(head, ".")).otherwise("")


def event_id(key: Column) -> Column:
    at = _number_at(key)
    return F.when(at > 0, F.get(_pieces(key), (at - 1).cast("int"))).otherwise("")


def part(key: Column) -> Column:
    """What follows the number."""
    at = _number_at(key).cast("int")
    pieces = _pieces(key)
    return F.when(at > 0, F.array_join(F.slice(pieces, at + 1, F.size(pieces)), ".")).otherwise("")


def country_tag(key: Column) -> Column:
    return F.regexp_extract(key, r"^([A-Z]{3})(_|\z)", 1)


def suffix(key: Column) -> Column:
    return F.regexp_extract(key, r"_([a-zA-Z][a-zA-Z0-9]*)\z", 1)


def part_kind(part_: Column) -> Column:
    """none, tooltip, title, body, option or named-variant; the order of the cases matters."""
    head = F.substring_index(part_, ".", 1)
    base = F.regexp_replace(head, r"(?U)\d+\z", "")
    kind = F.when(F.coalesce(part_, F.lit("")) == "", "none").when(part_.contains(".tt") | (base == "tt"), "tooltip")
    for name, words in CORE_PARTS.items():
        kind = kind.when(base.isin(*words), name)
    return kind.when(F.regexp_like(base, F.lit(r"^[a-z]\z")) | F.regexp_like(head, F.lit(r"(?U)^\d+\z")), "option").otherwise("named-variant")


def variable_format(token: Column) -> Column:
    """The format of $NAME|format$, null without one."""
    inner = F.regexp_replace(token, r"^\$+|\$+\z", "")
    return F.when(inner.contains("|"), F.substr(inner, F.instr(inner, "|") + 1))


def scope_form(token: Column) -> Column:
    """(form, has_format) of a [scope function]."""
    inner = F.regexp_extract(token, r"^\[([^\]]*)\]\z", 1)
    optional = inner.startswith("?")
    body = F.substring_index(F.when(optional, F.substr(inner, F.lit(2))).otherwise(inner), "|", 1)
    form = F.concat(F.when(optional, "optional-").otherwise(""), F.when(body.contains("."), "scoped").otherwise("bare"))
    return F.struct(form.alias("form"), inner.contains("|").alias("has_format"))


def clean_text(value: Column) -> Column:
    """The words only: constructs give way to blanks, in order, and white space is squeezed."""
    for pattern in CLEANED:
        value = F.regexp_replace(value, pattern, " ")
    return squeezed(value)


def colour_counts(value: Column) -> tuple[Column, Column]:
    return F.regexp_count(value, F.lit("§[A-Za-z]")), F.regexp_count(value, F.lit("§!"))


def signature(value: Column, advisory: bool = False) -> Column:
    """Tokens that a translation must keep, as an array with repeats; variables without their formats.

    advisory: line breaks and colour marks count as well."""
    names = F.transform(found(value, r"\$([^$]*)\$", 1), lambda n: F.concat(F.lit("$"), F.substring_index(n, "|", 1), F.lit("$")))
    parts = [names, found(value, INLINE[5][1]), found(value, INLINE[2][1]), found(value, INLINE[3][1])]
    if advisory:
        parts += [F.transform(found(value, r"\\n"), lambda _: F.lit("\\n")), F.transform(found(value, "§[A-Za-z!]"), lambda _: F.lit("§"))]
    return F.concat(*parts)


def references(value: Column) -> Column:
    return found(value, REFERENCE, 1)


def is_engine_value(name: Column) -> Column:
    return F.regexp_like(name, F.lit(r"^[A-Z][_A-Z0-9]*\z"))
