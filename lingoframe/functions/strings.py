"""String expressions that several formats share, with the semantics of Unicode text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a backslash and this letter stand for; any other letter stands for itself.
ESCAPES = dict(zip("abfnrtv", "\a\b\f\n\r\t\v"))


def stripped(text: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def blank(text: Column) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(stripped(text), F.lit("")) == ""


def squeezed(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def unescaped(raw: Column) -> Column:
    """Backslash escapes resolved in one pass; an unknown one leaves its letter, a backslash at the end stays."""
    parts = F.regexp_extract_all(raw, F.lit(r"(?s)\\.|[^\\]+|\\\z"), F.lit(0))

    def one(p: Column) -> Column:
        letter = F.substring(p, 2, 1)
        value = letter
        for c, real in ESCAPES.items():
            value = F.when(letter == c, F.lit(real)).otherwise(value)
        return F.when(p.startswith("\\") & (F.length(p) == 2), value).otherwise(p)

    return F.when(raw.isNotNull(), F.array_join(F.transform(parts, one), ""))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern, an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def counted(items: Column) -> Column:
    """A multiset: sorted (token, n) pairs."""
    return F.transform(sorted_set(items), lambda t: F.struct(t.alias("token"), F.size(F.filter(items, lambda x: x == t)).alias("n")))


def surplus(left: Column, right: Column) -> Column:
    """What the multiset of left has beyond that of right, as sorted (token, n) pairs. array_except would forget counts."""
    of = lambda items, t: F.size(F.filter(items, lambda x: x == t))
    gap = F.transform(sorted_set(left), lambda t: F.struct(t.alias("token"), (of(left, t) - of(right, t)).alias("n")))
    return F.filter(gap, lambda g: g["n"] > 0)


def shown(pairs: Column) -> Column:
    """token x n, joined by blanks."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["token"], F.lit("x"), p["n"].cast("string"))), " ")


def strict_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value. The parser ignores what follows a value, so the text is parsed inside an
    array and inside an object: what can follow it in one is an error in the other."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()


def hex_id(prefix: Column, parts: list[Column], separator: str, digits: int) -> Column:
    """prefix:first digits of the SHA-1 of the parts, nulls being empty."""
    whole = F.concat_ws(separator, *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(prefix, F.lit(":"), F.substring(F.sha1(whole), 1, digits))
