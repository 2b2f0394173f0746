"""The one-language bundle of Fluent units with their pieces of syntax as labelled spans: rows, file index, statistics,
manifest, and the checks of all of them."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingoframe import registry
from lingoframe.bundle import artifact
from lingoframe.functions import fluent as L
from lingoframe.functions import scanners
from lingoframe.operators.common import neighbours, numbered

KINDS = "function literal markup msg-ref other selector term-ref var".split()
ORIGINS = "project spec unknown".split()
#: What the registry calls an origin, and what the contract does.
CONTRACT = {"fluent": "spec", "project": "project"}
BLANK = 'fluent {""} intentional blank'
VERSIONS = {"bundle_version": "0.3.0", "source_format": "fluent-ftl", "producer_version": "0.1.0+norm=strip-join-lf"}
REQUIRED = "line_id seq native_ref file line_no source_text placeholders".split()
OPTIONAL = "key structural_role empty empty_reason context targets".split()
SPAN_REQUIRED, SPAN_OPTIONAL = "start end token kind origin".split(), ["detail"]
MANIFEST = "bundle_version source_id source_format source_language line_count content_hash files".split()
#: A whole placeable, a selector's head, a variant key, a selector's end.
SHAPES = r"(?s)\A(\{.*\}|\{.*->|\*?\[.*\]|\*.*\]|\})\z"
STYLE = "Spans of Fluent syntax in braces: variables, terms, messages, functions and literals as a whole; of a selector its head, each variant key and its closing brace, so that what the variants say stays outside all spans. To be read by people; programs take lines[].placeholders."


def line_id(kind: Column, id_: Column, attr: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u001f", kind, id_, F.coalesce(attr, F.lit(""))), 256), 1, 16)


def _origin(construct: str, name: Column) -> Column:
    """The contract's word for where a construct comes from; what the registry lacks is unknown."""
    out = F.lit("unknown")
    for ours, word in CONTRACT.items():
        names = [n for f, c, n, _, o in registry.rows() if (f, c, o) == ("ftl", construct, ours)]
        out = F.when(name.isin(names), word).otherwise(out) if names else out
    return out


def _label(p: Column, text: Column) -> Column:
    """A piece with its kind, origin and detail. A whole selector is a problem that verify() reports."""
    c = L.classify(p["payload"])
    piece = p["syntax"] != "placeable"
    kind = F.when(piece, "selector").otherwise(c["kind"])
    key = F.when(L.is_number_key(p["payload"]), "spec").otherwise(_origin("variant-key", p["payload"]))
    origin = (
        F.when(p["syntax"] == "selector-key", key).when(piece, _origin("piece", p["syntax"]))
        .when(kind == "function", _origin("function", c["detail"])).otherwise(_origin("placeable", kind))
    )
    detail = F.nullif(F.when(piece, p["payload"]).otherwise(c["detail"]), F.lit(""))
    token = F.substring(text, p["start"] + 1, p["end"] - p["start"])
    return F.struct(p["start"].alias("start"), p["end"].alias("end"), token.alias("token"), kind.alias("kind"), origin.alias("origin"), detail.alias("detail"))


def _there(units: DataFrame) -> DataFrame:
    """Units that have a text. A message that only holds attributes has no value, which is no unit; {""} is one."""
    return units.where(F.col("text") != "")


def rows(units: DataFrame) -> DataFrame:
    """The contract's fields, in their order: line_id, seq (from 1: by file, place, value before attributes), native_ref (kind, id, attr),
    file, line_no, key, source_text, placeholders, structural_role, empty and empty_reason (null if not), context (comment,
    section; null without both). units: sources.fluent.units(..., include_empty=True); those without a text are left out."""
    out = _there(units).withColumn("lf_tokens", F.when(F.contains("text", F.lit("{")), scanners.tokens_of("text")).otherwise(F.array().cast("array<struct<start:int,end:int,syntax:string,payload:string>>")))
    out = out.withColumn("placeholders", F.transform("lf_tokens", lambda p: _label(p, F.col("text"))))
    out = numbered(out, "file", ["ord", "pos"], start=1)
    context = F.struct(F.nullif("comment", F.lit("")).alias("comment"), F.nullif("section", F.lit("")).alias("section"))
    return out.select(
        line_id(F.col("kind"), F.col("id"), F.col("attr")).alias("line_id"), F.col("seq").cast("bigint").alias("seq"), F.struct("kind", "id", "attr").alias("native_ref"), "file", F.col("line").cast("bigint").alias("line_no"),
        F.col("id").alias("key"), F.col("text").alias("source_text"), "placeholders", F.col("role").alias("structural_role"), F.when(F.col("empty"), F.lit(True)).alias("empty"), F.when(F.col("empty"), F.lit(BLANK)).alias("empty_reason"),
        F.when(context["comment"].isNotNull() | context["section"].isNotNull(), context).alias("context"),
    )


def files_index(made: DataFrame, files: DataFrame) -> DataFrame:
    """Every file, those without units too: path, line_count and encoding."""
    counts = made.groupBy("file").agg(F.count("*").alias("line_count"))
    return files.select("file").distinct().join(counts, "file", "left").select(F.col("file").alias("path"), F.coalesce("line_count", F.lit(0)).cast("bigint").alias("line_count"), F.lit("utf-8").alias("encoding"))


def statistics(made: DataFrame, units: DataFrame) -> DataFrame:
    """(what, name, n): kinds and origins of spans, rows and spans, empty units, units with a comment, a section or either, units
    that one span covers wholly, with another role, and the units left out for want of a text."""
    pair = lambda what, c: F.struct(F.lit(what).alias("what"), c.alias("name"))
    flag = lambda when, name: F.when(when, F.lit(name))
    empty, context = F.coalesce("empty", F.lit(False)), F.col("context")
    masked = (F.size("placeholders") == 1) & (F.get("placeholders", F.lit(0))["start"] == 0) & (F.get("placeholders", F.lit(0))["end"] == F.length("source_text"))
    flags = F.array_compact(F.array(
        F.lit("rows"), flag(empty, "empty"), flag(context.isNotNull(), "with_context"), flag(context["comment"].isNotNull(), "with_comment"), flag(context["section"].isNotNull(), "with_section"),
        flag(masked & empty, "fully_masked_empty"), flag(masked & ~empty, "fully_masked_nonempty"), flag(F.col("structural_role") == "other", "role_other"),
    ))
    spans = F.flatten(F.transform("placeholders", lambda p: F.array(pair("kind", p["kind"]), pair("origin", p["origin"]), pair("unit", F.lit("placeholders")))))
    each = made.select(F.inline(F.concat(spans, F.transform(flags, lambda f: pair("unit", f)))))
    absent = units.where("text = ''").select(F.lit("unit").alias("what"), F.when(F.col("attr").isNull(), "skipped_absent_value").otherwise("skipped_absent_attr").alias("name"))
    return each.unionByName(absent).groupBy("what", "name").agg(F.count("*").alias("n"))


def verify(made: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(line_id, problem): fields that must be there, ids and numbers unique and dense, spans in order, in bounds, of a known
    shape, kind and origin and equal to their slice, no syntax outside them, files and counts as in the index."""
    text, spans, ref = F.col("source_text"), F.col("placeholders"), F.col("native_ref")
    later = F.zip_with(F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), lambda b, a: b["start"] < a["end"])
    gaps = F.concat(F.array(F.lit(0)), F.transform(spans, lambda p: p["end"]))
    heads = F.concat(F.transform(spans, lambda p: p["start"]), F.array(F.length(text)))
    left = F.zip_with(gaps, heads, lambda a, b: F.substring(text, a + 1, b - a))
    syntax = F.when(F.exists(spans, lambda p: p["kind"] == "selector"), r"[{}]|->").otherwise(r"[{}]")
    bad = [
        *[(f"no {c}", F.col(c).isNull()) for c in REQUIRED if c != "line_id"],
        ("native_ref", ref["kind"].isNull() | ref["id"].isNull()),
        ("line_no", F.col("line_no") < 1),
        ("structural_role", F.col("structural_role") == ""),
        ("empty_reason", F.col("empty_reason").isNotNull() & ~F.coalesce("empty", F.lit(False))),
        ("absent", (text == "") & ~F.coalesce("empty", F.lit(False))),
        ("span", F.exists(spans, lambda p: p["start"].isNull() | p["end"].isNull() | p["token"].isNull() | p["kind"].isNull() | p["origin"].isNull() | (p["detail"] == ""))),
        ("bounds", F.exists(spans, lambda p: (p["start"] < 0) | (p["end"] > F.length(text)) | (p["start"] >= p["end"]))),
        ("slice", F.exists(spans, lambda p: F.substring(text, p["start"] + 1, p["end"] - p["start"]) != p["token"])),
        ("overlap", F.exists(later, lambda x: x)),
        ("shape", F.exists(spans, lambda p: ~F.regexp_like(p["token"], F.lit(SHAPES)))),
        ("kind", F.exists(spans, lambda p: ~p["kind"].isin(*KINDS))),
        ("origin", F.exists(spans, lambda p: ~p["origin"].isin(*ORIGINS))),
        ("whole_selector", F.exists(spans, lambda p: (p["kind"] == "selector") & p["token"].startswith("{") & p["token"].endswith("}") & (F.length(p["token"]) > 1))),
        ("leak", F.exists(left, lambda s: F.regexp_like(s, syntax))),
        ("line_id", ~F.col("line_id").eqNullSafe(line_id(ref["kind"], ref["id"], ref["attr"]))),
    ]
    own = made.select("line_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in bad]))).alias("problem"))
    twice = made.groupBy("line_id").count().where("count > 1").select("line_id", F.lit("duplicate_id").alias("problem"))
    nobody = F.lit(None).cast("string").alias("line_id")
    dense = made.agg(F.count("*").alias("c"), F.countDistinct("seq").alias("d"), F.min("seq").alias("a"), F.max("seq").alias("z")).where("c > 0 and (c <> d or a <> 1 or z <> c)").select(nobody, F.lit("seq").alias("problem"))
    out = own.unionByName(twice).unionByName(dense)
    if index is None:
        return out
    counts = made.groupBy("file").agg(F.count("*").alias("n"))
    off = counts.join(index.select(F.col("path").alias("file"), "line_count"), "file", "full_outer")
    unlisted = off.where("line_count is null").select(nobody, F.concat(F.lit("not in files: "), "file").alias("problem"))
    off = off.where(F.col("line_count").isNotNull() & (F.coalesce("n", F.lit(0)) != F.col("line_count")))
    return out.unionByName(unlisted).unionByName(off.select(nobody, F.concat(F.lit("count of "), "file").alias("problem")))


def bare(row: dict) -> dict:
    """A row as it is written: without nulls, but for an attribute's name in native_ref."""
    out = {k: v for k, v in row.items() if v is not None}
    if "context" in out:
        out["context"] = {k: v for k, v in out["context"].items() if v is not None}
    out["placeholders"] = [{k: v for k, v in p.items() if v is not None} for p in out.get("placeholders", [])]
    return out


def key_problems(row: dict) -> list[str]:
    """Keys of a row read back that it must have and lacks, and those that the contract doesn't know."""
    out = [f"lacks {k}" for k in REQUIRED if k not in row] + [f"has {k}" for k in row if k not in REQUIRED + OPTIONAL]
    for p in row.get("placeholders", []):
        out += [f"span lacks {k}" for k in SPAN_REQUIRED if k not in p] + [f"span has {k}" for k in p if k not in SPAN_REQUIRED + SPAN_OPTIONAL]
    context = row.get("context", {"section": ""})
    if not isinstance(context, dict) or not context or set(context) - {"comment", "section"}:
        out.append("wrong context")
    return out


def manifest(source_id: str, name: str, language: str, produced_by: str, files: DataFrame, stats: DataFrame, content: str, n: int, stamp: str | bool | None = None, forced: int = 0) -> dict:
    """files: files_index(); stats: statistics(). stamp: when it was made, or True for now; by default it isn't said, so that the
    same input gives the same bytes. forced: structural errors that the export was told to ignore."""
    count = {(r.what, r.name): r.n for r in stats.collect()}
    unit = lambda k: count.get(("unit", k), 0)
    notes = (
        f"Texts are normalised (each line stripped, joined by LF), not slices of the files. {n} rows: {n - unit('empty')} with words and {unit('empty')} blank on purpose; {unit('skipped_absent_value')} messages without a value and "
        f"{unit('skipped_absent_attr')} such attributes are no units. A key is shared by a message's value and attributes: join on line_id. Of unknown origin: {count.get(('origin', 'unknown'), 0)} spans; of no known role: {unit('role_other')} units."
    ) + (f" Written in spite of {forced} structural errors." if forced else "")
    made = {k: VERSIONS[k] for k in ("bundle_version",)} | {"source_id": source_id, "source_name": name, "source_format": VERSIONS["source_format"], "source_language": language, "produced_by": produced_by, "producer_version": VERSIONS["producer_version"]}
    if stamp:
        made["produced_at"] = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if stamp is True else stamp
    listed = [r.asDict() for r in files.orderBy("path").toLocalIterator()]
    return made | {"line_count": n, "content_hash": artifact.covered(content), "placeholder_style": STYLE, "files": listed, "notes": notes}


def manifest_problems(m: dict, n: int, digest: str) -> list[str]:
    """What is missing in a manifest or doesn't fit n rows whose bytes have this SHA-256."""
    out = [f"lacks {k}" for k in MANIFEST if k not in m]
    content = m.get("content_hash", {})
    tests = {
        "bundle_version": m.get("bundle_version") == VERSIONS["bundle_version"],
        "source_id": bool(re.fullmatch("[a-z0-9][a-z0-9-]*", m.get("source_id", ""))),
        "line_count": m.get("line_count") == n,
        "files": sum(f["line_count"] for f in m.get("files", [])) == n,
        "content_hash.algorithm": content.get("algorithm") == "sha256",
        "content_hash.covers": content.get("covers") == artifact.LINES,
        "content_hash.value": content.get("value") == digest and bool(re.fullmatch("[0-9a-f]{64}", content.get("value", ""))),
    }
    return out + [f"wrong {k}" for k, good in tests.items() if not good]


def check(folder, rebuilt: DataFrame | None = None) -> list[str]:
    """Problems of a written bundle: bytes, keys and manifest; if it is built anew, also the first line that differs. Lines are
    read one by one."""
    out, digest, n, again = [], hashlib.sha256(), 0, None
    if rebuilt is not None:
        again = (artifact.line_of(bare(r.asDict(recursive=True))) for r in rebuilt.orderBy("seq").toLocalIterator(prefetchPartitions=True))
    differs = None
    with (folder / artifact.LINES).open("rb") as f:
        for n, line in enumerate(f, 1):
            digest.update(line)
            made, bad = artifact.read_lines(line)
            out += [f"line {n}: {x}" for x in [*artifact.payload_problems(line), *(["no object"] if bad else key_problems(made[0]) if made else [])]]
            if again is not None and differs is None and next(again, None) != line:
                differs = n
    if again is not None and differs is None and next(again, None) is not None:
        differs = n + 1
    out += manifest_problems(json.loads((folder / "manifest.json").read_text()), n, digest.hexdigest())
    return out + ([f"built anew it differs from line {differs} on"] if differs else [])


def in_order(made: DataFrame) -> DataFrame:
    """Rows with the ids before and after them within their file."""
    return neighbours(made, "file", ["seq"], "line_id")
