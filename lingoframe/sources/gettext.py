"""gettext catalogues: whole files to entries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingoframe.functions import gettext as G
from lingoframe.sources import files

COMMENTS = "struct<translator:array<string>,extracted:array<string>,refs:array<string>,previous:array<string>>"
RAW = f"file string, ord int, domain string, lineno int, msgctxt string, msgid string, msgid_plural string, msgstr array<string>, comments {COMMENTS}, flags array<string>, is_header boolean"
_MARKS = {".": "extracted", ":": "refs", "|": "previous"}
_KEYWORD = re.compile(r"(msgctxt|msgid_plural|msgid|msgstr)(?:\[(\d+)\]\s*|\s)(.*)", re.S)


def _inside(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value


class _Block:
    """What stands between two blank lines."""

    def __init__(self, lineno: int):
        self.lineno, self.parts, self.forms, self.flags = lineno, {}, {}, []
        self.comments = {k: [] for k in ("translator", "extracted", "refs", "previous")}
        self.commented = False

    def comment(self, line: str) -> None:
        self.commented = True
        mark = line[1:2]
        if mark == ",":
            self.flags += [f for f in map(str.strip, line[2:].split(",")) if f]
        else:
            self.comments[_MARKS.get(mark, "translator")].append(line[2 if mark in _MARKS else 1 :].strip())

    def add(self, field: str, form: int, value: str) -> None:
        if field == "msgstr":
            self.forms[form] = self.forms.get(form, "") + value
        else:
            self.parts[field] = self.parts.get(field, "") + value

    def row(self) -> dict | None:
        forms = [self.forms.get(i, "") for i in range(max(self.forms, default=-1) + 1)]
        msgid, context = self.parts.get("msgid", ""), self.parts.get("msgctxt")
        if not (msgid or context is not None or self.commented or any(forms)):
            return None
        return {"lineno": self.lineno, "msgctxt": context, "msgid": msgid, "msgid_plural": self.parts.get("msgid_plural"), "msgstr": forms, "comments": self.comments, "flags": self.flags, "is_header": msgid == "" and context is None}


def parse(text: str) -> list[dict]:
    """Entries of one catalogue, escapes as written. A block of comments alone is an entry too, and looks like a header."""
    out, block, field, form = [], None, None, 0
    for number, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        if not line.strip():
            if block and (row := block.row()):
                out.append(row)
            block = field = None
            continue
        block = block or _Block(number)
        if line[0] == "#":
            block.comment(line)
        elif m := _KEYWORD.match(line):
            field, form = m[1], int(m[2] or 0)
            if field in ("msgctxt", "msgid_plural"):
                block.parts.pop(field, None)
            block.add(field, form, _inside(m[3]))
        elif line[0] == '"' and field:
            block.add(field, form, _inside(line))
    if block and (row := block.row()):
        out.append(row)
    return out


def finished(raw: DataFrame, mark: str | None = "^") -> DataFrame:
    """Add context_prefix, display and internal_id. mark: what ends an inline context; None for catalogues without one."""
    msgid = F.col("msgid")
    out = raw.withColumn("context_prefix", G.prefix(msgid, mark) if mark else F.lit(None).cast("string"))
    out = out.withColumn("display", G.shown_text(msgid, mark) if mark else msgid)
    return out.withColumn("internal_id", F.when(~F.col("is_header"), G.internal_id(F.col("domain"), F.col("msgctxt"), msgid, F.col("msgid_plural"))))


def parsed(texts: DataFrame, domain: str | None = None, mark: str | None = "^") -> DataFrame:
    """Entries of whole catalogues (file, text); the domain is the file's stem unless given. A file is one task's work."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch["file"], batch["text"]):
                rows = parse(text)
                stem = domain or name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                made = {c: [r[c] for r in rows] for c in ("lineno", "msgctxt", "msgid", "msgid_plural", "msgstr", "comments", "flags", "is_header")}
                yield type(batch)({"file": [name] * len(rows), "ord": list(range(len(rows))), "domain": [stem] * len(rows), **made})

    return finished(texts.select("file", "text").mapInPandas(run, RAW), mark)


def read(spark: SparkSession, path: str, glob: str = "*.po*", domain: str | None = None, mark: str | None = "^", recursive: bool = True) -> DataFrame:
    """Entries of the catalogues under a path."""
    return parsed(files.whole(spark, path, glob, recursive), domain, mark)


def strings(entries: DataFrame) -> DataFrame:
    """Entries to translate."""
    return entries.where(~F.col("is_header"))


def header_facts(entries: DataFrame) -> DataFrame:
    """(domain, nplurals, revision_date) from the first header of each domain that has a msgstr; nplurals null and the date
    '' where the header lacks them."""
    heads = entries.where(F.col("is_header") & (F.size("msgstr") > 0)).groupBy("domain").agg(F.min_by(F.get("msgstr", F.lit(0)), "lineno").alias("h"))
    number = F.nullif(F.regexp_extract("h", r"nplurals *= *(\d+)", 1), F.lit("")).try_cast("int")
    return heads.select("domain", number.alias("nplurals"), F.trim(F.regexp_extract("h", r"PO-Revision-Date: *([^\\]*)", 1)).alias("revision_date"))


def inventory(spark: SparkSession, root: str, locale: str) -> DataFrame:
    """(domain, has_target) of the folders of root with a template of their own name."""
    names = files.binary(spark, root, "*.po*", True).select("file")
    pots = names.where(F.regexp_like("file", F.lit(r"^([^/]+)/\1\.pot\z"))).select(F.substring_index("file", "/", 1).alias("domain"))
    pos = names.where(F.substring_index("file", "/", -1) == f"{locale}.po").select(F.substring_index("file", "/", 1).alias("d"))
    return pots.join(pos, F.col("domain") == F.col("d"), "left").select("domain", F.col("d").isNotNull().alias("has_target"))
