"""Scans that expressions can't make, since each sign's meaning depends on those before it: plain functions over one
text, and Arrow-batched functions over columns of texts that apply them to the distinct texts of a batch."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingoframe.functions.fluent import IDENT
from lingoframe.functions.gettext import ALONE, KNOWN

_VARIABLE = re.compile(rf"\$({IDENT})")
_ANGLE = re.compile(r"<\s*(/)?\s*([a-zA-Z]\w*)[^>]*?(/)?\s*>")
_KEY = re.compile(r"(\*)?\[\s*([- ._a-zA-Z0-9]+?)\s*\]")
CLDR = frozenset("zero one two few many other".split())


def outside_strings(text: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, str]]:
    """(place, sign) of the signs that stand in no "string literal"; quotes themselves are left out."""
    quoted = escaped = False
    for i in range(start, len(text) if stop is None else stop):
        sign = text[i]
        if escaped:
            escaped = False
        elif sign == '"':
            quoted = not quoted
        elif quoted:
            escaped = sign == "\\"
        else:
            yield i, sign


def depth_change(line: str) -> int:
    """Braces opened less those closed."""
    return sum({"{": 1, "}": -1}.get(sign, 0) for _, sign in outside_strings(line))


def balanced(text: str) -> bool:
    """Whether braces close in order and all do."""
    depth = 0
    for _, sign in outside_strings(text):
        depth += {"{": 1, "}": -1}.get(sign, 0)
        if depth < 0:
            return False
    return depth == 0


def placeables(text: str) -> list[tuple[int, int, str]]:
    """(start, end, stripped inside) of the outermost {...}. From one that doesn't close on, nothing is given."""
    out, at = [], 0
    while (start := text.find("{", at)) >= 0:
        depth = 0
        for i, sign in outside_strings(text, start):
            depth += {"{": 1, "}": -1}.get(sign, 0)
            if not depth:
                break
        else:
            return out
        at = i + 1
        out.append((start, at, text[start + 1 : i].strip()))
    return out


def kind_of(inner: str) -> tuple[str, str]:
    """The same as fluent.classify, for one text."""
    name = _VARIABLE.search(inner)
    if "->" in inner:
        return "selector", name[1] if name else ""
    if inner.startswith("$"):
        return "var", name[1] if name and name.start() == 0 else inner
    if inner.startswith("-"):
        term = re.match(f"-{IDENT}", inner)
        return "term-ref", term[0] if term else inner
    if inner.startswith('"'):
        return "literal", inner[1:-1]
    if call := re.match(r"([A-Z][_A-Z0-9]+)\s*\(", inner):
        return "function", call[1]
    return ("msg-ref", inner) if re.fullmatch(rf"{IDENT}(\.{IDENT})?", inner) else ("other", inner)


def selector_marks(text: str, start: int, end: int) -> tuple[int, list[tuple[int, int, str]]] | None:
    """Where the arrow of the selector text[start:end] ends, and (start, end, key) of its own variant keys, which begin lines;
    None without an arrow at its own depth."""
    depth, arrow, keys, fresh, skip, last = 0, None, [], False, -1, start
    for i, sign in outside_strings(text, start + 1, end - 1):
        if i != last + 1:  # a literal came between
            fresh = False
        last = i
        if i < skip:
            continue
        if sign == "\n":
            fresh = True
        elif sign in "{}":
            depth, fresh = depth + (1 if sign == "{" else -1), False
        elif not depth and arrow is None and text.startswith("->", i):
            arrow, skip, fresh = i + 2, i + 2, False
        elif not depth and arrow is not None and fresh and re.match(r"\*?\[", text[i : i + 2]):
            close = text.find("]", i, end - 1)
            if close < 0:
                break
            keys.append((i, close + 1, text[i:close].lstrip("*")[1:].strip()))
            skip, fresh = close + 1, False
        elif sign not in " \t":
            fresh = False
    return None if arrow is None else (arrow, keys)


def placeable_tokens(text: str, base: int = 0) -> list[tuple[int, int, str, str | None]]:
    """(start, end, syntax, payload) of the pieces of syntax, in order and without overlap: what no piece covers is what a
    translator sees. Selectors give a head, keys and a close; what their variants hold is scanned in its turn."""
    out: list[tuple[int, int, str, str | None]] = []
    for start, end, inner in placeables(text):
        marks = selector_marks(text, start, end) if kind_of(inner)[0] == "selector" else None
        if marks is None:
            out.append((base + start, base + end, "placeable", inner))
            continue
        name = _VARIABLE.search(text[start : marks[0]])
        pieces = [(start, marks[0], "selector-head", name[1] if name else ""), *[(a, b, "selector-key", key) for a, b, key in marks[1]], (end - 1, end, "selector-close", None)]
        for piece, after in zip(pieces, [*pieces[1:], None]):
            out.append((base + piece[0], base + piece[1], *piece[2:]))
            if after:
                out += placeable_tokens(text[piece[1] : after[0]], base + piece[1])
    return out


def complement(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The stretches that no span covers."""
    cuts = [0, *[x for span in spans for x in span], len(text)]
    return [text[a:b] for a, b in zip(cuts[::2], cuts[1::2]) if a < b]


def own_keys(inner: str) -> list[tuple[str, bool]]:
    """(key, starred) of a selector's own variants only."""
    text = "{" + inner + "}"
    marks = selector_marks(text, 0, len(text))
    return [(key, text[a] == "*") for a, _, key in (marks[1] if marks else [])]


def unit_problems(text: str, compat: bool = False) -> list[tuple[str, str, str]]:
    """(severity, rule, detail) of one unit's structure. compat: keys are any bracketed words inside a selector, so that
    those of nested ones and of prose count too; by default a selector's own keys."""
    if not balanced(text):
        return [("ERROR", "ftl.brace_balance", "")]
    out: list[tuple[str, str, str]] = []
    for _, _, inner in placeables(text):
        kind, _ = kind_of(inner)
        if kind == "other":
            out.append(("WARN", "ftl.unclassified_placeable", inner[:40]))
        if kind != "selector":
            continue
        keys = [(k, bool(star)) for star, k in _KEY.findall(inner)] if compat else own_keys(inner)
        stars = sum(star for _, star in keys)
        if stars != 1:
            out.append(("ERROR", "ftl.selector_default", str(stars)))
        out += [("WARN", "ftl.variant_key", k) for k, _ in keys if k not in CLDR and not k.lstrip("-").isdigit()]
        out += [p for p in unit_problems(inner.partition("->")[2], compat) if p[1] != "ftl.brace_balance"]
    return out


def tag_problems(text: str) -> list[tuple[str, str, str]]:
    """Closing tags that don't fit the innermost open one (which stays open), and what is open at the end."""
    stack: list[str] = []
    out = []
    for m in _ANGLE.finditer(text):
        name = m[2].lower()
        if name not in KNOWN or name in ALONE:
            continue
        if m[1]:
            if stack and stack[-1] == name:
                stack.pop()
            else:
                out.append(("ERROR", "po.markup.unbalanced", m[0]))
        elif not m[3]:
            stack.append(name)
    if stack:
        out.append(("ERROR", "po.markup.unclosed", ",".join(stack)))
    return out


_STRING, _INT = (T.StringType(), pa.string()), (T.IntegerType(), pa.int32())
SPANS = {"start": _INT, "end": _INT, "inner": _STRING}
TOKENS = {"start": _INT, "end": _INT, "syntax": _STRING, "payload": _STRING}
PROBLEMS = {"severity": _STRING, "rule": _STRING, "detail": _STRING}


def _column(scan: Callable[[str], object], kind: T.DataType, arrow: pa.DataType):
    """An Arrow function over a column that scans each distinct text of a batch once; a null text gives a null."""

    @F.arrow_udf(kind)
    def apply(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        return pa.array([scan(t) for t in coded.dictionary.to_pylist()], arrow).take(coded.indices)

    return apply


def _structs(scan: Callable[[str], list[tuple]], fields: dict[str, tuple[T.DataType, pa.DataType]]):
    """The same for a scan that gives rows of these fields."""
    kind = T.ArrayType(T.StructType([T.StructField(n, k) for n, (k, _) in fields.items()]))
    arrow = pa.list_(pa.struct([(n, a) for n, (_, a) in fields.items()]))
    return _column(lambda text: [dict(zip(fields, row)) for row in scan(text)], kind, arrow)


placeables_of = _structs(placeables, SPANS)
tokens_of = _structs(placeable_tokens, TOKENS)
is_balanced = _column(balanced, T.BooleanType(), pa.bool_())
unit_problems_of = _structs(unit_problems, PROBLEMS)
unit_problems_compat = _structs(lambda t: unit_problems(t, True), PROBLEMS)
tag_problems_of = _structs(tag_problems, PROBLEMS)
complement_of = _column(lambda t: complement(t, [(a, b) for a, b, *_ in placeable_tokens(t)]), T.ArrayType(T.StringType()), pa.list_(pa.string()))


class Placeables:
    """For SQL: SELECT * FROM t, LATERAL placeables(text)."""

    def eval(self, text: str):
        if text is not None:
            for start, end, inner in placeables(text):
                yield start, end, inner, *kind_of(inner)


def register(spark) -> None:
    """Make the scans callable from SQL."""
    spark.udtf.register("placeables", F.udtf(Placeables, returnType="start int, end int, inner string, kind string, detail string"))
    for name, f in (("placeable_tokens", tokens_of), ("is_balanced", is_balanced), ("unit_problems", unit_problems_of), ("tag_problems", tag_problems_of)):
        spark.udf.register(name, f)
