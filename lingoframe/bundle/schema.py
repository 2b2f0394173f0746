"""A checker for the part of JSON Schema that bundle contracts use."""

from __future__ import annotations

import re

_TYPES = dict(array=list, boolean=bool, integer=int, null=type(None), number=(int, float), object=dict, string=str)


def _is(value: object, kind: str) -> bool:
    return isinstance(value, _TYPES[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def problems(value: object, schema: dict, at: str = "$", root: dict | None = None) -> list[str]:
    """What in a value the schema forbids: type, const, enum, pattern, minimum, required, additionalProperties, properties, items, $ref."""
    root = root or schema
    if "$ref" in schema:
        target = root
        for step in schema["$ref"].removeprefix("#/").split("/"):
            target = target[step]
        return problems(value, target, at, root)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: is no {'/'.join(kinds)}"]
    out = []
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: is not {schema['const']!r}")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: {value!r} is not allowed")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: doesn't match {schema['pattern']}")
    if _is(value, "number") and "minimum" in schema and value < schema["minimum"]:
        out.append(f"{at}: is below {schema['minimum']}")
    if isinstance(value, list) and "items" in schema:
        out += [p for i, x in enumerate(value) for p in problems(x, schema["items"], f"{at}[{i}]", root)]
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}: lacks {k}" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in known:
                out += problems(x, known[k], f"{at}.{k}", root)
            elif more is False:
                out.append(f"{at}: has {k}")
            elif isinstance(more, dict):
                out += problems(x, more, f"{at}.{k}", root)
    return out
