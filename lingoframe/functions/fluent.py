"""Expressions over Fluent units and placeables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingoframe.functions.strings import found, stripped

IDENT = r"[a-zA-Z][-_a-zA-Z0-9]*"
EMPTY = tuple('|{""}|{ "" }'.split("|"))
GENDER = ("fem", "masc", "neut")
ENUMS = {"buff-kind": "burning bleeding curse crippled frozen mysterious", "weapon-kind": "sword axe hammer bow staff sceptre", "hire-period": "day week unknown", "time-unit": "days hours minutes seconds"}
CLDR = tuple("few many one other two zero".split())
ENGINE = ("gender", *[f"{who}_gender" for who in ("attacker", "player", "user", "victim")])


def is_empty(text: Column) -> Column:
    return stripped(F.coalesce(text, F.lit(""))).isin(*EMPTY)


def attribute_role(attr: Column) -> Column:
    """value for no attribute, else metadata, gender, variant, enum or other."""
    enums = [w for words in ENUMS.values() for w in words.split()]
    return F.when(attr.isNull(), "value").when(attr.isin("desc", "stat"), "metadata").when(attr.isin(*GENDER), "gender").when(F.regexp_like(attr, F.lit(r"(?U)^a\d+\z")), "variant").when(attr.isin(enums), "enum").otherwise("other")


def attribute_family(attr: Column) -> Column:
    out = F.lit(None).cast("string")
    for fam, words in ENUMS.items():
        out = F.when(attr.isin(words.split()), fam).otherwise(out)
    return out


def variables(text: Column) -> Column:
    """Every $name, in string literals too."""
    return found(text, rf"\$({IDENT})", 1)


def charset(name: Column) -> Column:
    has = lambda p: F.regexp_like(name, F.lit(p))
    return F.when(has("[A-Z]") & ~has("[a-z]"), "UPPER").when(has("-"), "has-hyphen").when(has("[0-9]"), "has-digit").otherwise("lower_snake")


def is_engine(name: Column) -> Column:
    return name.isin(*ENGINE) | name.endswith("_gender")


def variant_keys(text: Column) -> Column:
    """(key, starred) of every bracketed key, wherever it stands."""
    pattern = r"(\*)?\[\s*([- ._a-zA-Z0-9]+?)\s*\]"
    return F.transform(found(text, pattern), lambda t: F.struct(F.regexp_extract(t, pattern, 2).alias("key"), t.startswith("*").alias("starred")))


def is_number_key(key: Column) -> Column:
    return F.regexp_like(key, F.lit(r"(?U)^-*\d+\z"))


def classify(inner: Column) -> Column:
    """(kind, detail) of a stripped placeable: var, selector, term-ref, literal, function, msg-ref or other."""
    pick = lambda p, g=1: F.regexp_extract(inner, p, g)
    arrow = inner.contains("->")
    call, ref = r"^([A-Z][_A-Z0-9]+)(?U)\s*\(", rf"^({IDENT}(\.{IDENT})?)\z"
    kind = (
        F.when(arrow, "selector").when(inner.startswith("$"), "var").when(inner.startswith("-"), "term-ref").when(inner.startswith('"'), "literal")
        .when(F.regexp_like(inner, F.lit(call)), "function").when(F.regexp_like(inner, F.lit(ref)), "msg-ref").otherwise("other")
    )
    whole = lambda x: F.when(x == "", inner).otherwise(x)
    detail = (
        F.when(kind == "selector", pick(rf"\$({IDENT})")).when(kind == "var", whole(pick(rf"^\$({IDENT})"))).when(kind == "term-ref", whole(pick(rf"^(-{IDENT})")))
        .when(kind == "literal", F.when(F.length(inner) >= 2, F.substr(inner, F.lit(2), F.length(inner) - 2)).otherwise("")).when(kind == "function", pick(call)).otherwise(inner)
    )
    return F.struct(kind.alias("kind"), detail.alias("detail"))
