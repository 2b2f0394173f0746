"""Fluent files: whole files to entries, and entries to translatable units."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingoframe.functions import fluent as L
from lingoframe.functions.scanners import depth_change
from lingoframe.sources import files

SCHEMA = "file string, line int, ord int, kind string, id string, value string, attributes array<struct<name:string,value:string>>, comment string, section string"
_DEFINED = re.compile(rf"(-?{L.IDENT})[ \t]*=(.*)", re.S)
_ATTRIBUTE = re.compile(rf"[ \t]+\.({L.IDENT})[ \t]*=(.*)", re.S)
_REMARK = re.compile(r"(#{1,3}) ?(.*)", re.S)


class _Open:
    """An entry that lines are still added to."""

    def __init__(self, line: int, name: str, first: str, comment: str | None, section: str | None, raw: str):
        self.made = {"line": line, "kind": "term" if name[0] == "-" else "message", "id": name, "comment": comment, "section": section}
        self.texts: list[tuple[str | None, list[str]]] = [(None, [first])]
        self.depth = depth_change(raw)

    def add(self, line: str) -> None:
        m = _ATTRIBUTE.fullmatch(line) if self.depth <= 0 else None
        if m:
            self.texts.append((m[1], [m[2]]))
        else:
            self.texts[-1][1].append(line)
        self.depth += depth_change(line)

    def row(self) -> dict:
        whole = [(name, "\n".join(x.strip() for x in part).strip()) for name, part in self.texts]
        return self.made | {"value": whole[0][1], "attributes": [{"name": n, "value": v} for n, v in whole[1:]]}


def parse(text: str, sections: bool = True) -> list[dict]:
    """Entries of one file. An entry begins at the left edge and ends at the next one or at a remark; # goes to the entry
    right below it, ## and ### open a section (lines of them in a row are one). What belongs to no entry is junk."""
    out: list[dict] = []
    entry: _Open | None = None
    remarks: list[str] = []
    section, titles, last = None, [], -2
    for i, line in enumerate(text.split("\n")):
        line = line.removesuffix("\r")
        if remark := _REMARK.fullmatch(line):
            if entry:
                out.append(entry.row())
            entry = None
            if len(remark[1]) == 1:
                remarks.append(remark[2])
            else:
                titles = (titles if last == i - 1 else []) + [remark[2].strip()]
                section, last, remarks = "\n".join(t for t in titles if t) or None, i, []
        elif defined := _DEFINED.fullmatch(line):
            if entry:
                out.append(entry.row())
            entry = _Open(i + 1, defined[1], defined[2], "\n".join(remarks) if remarks else None, section if sections else None, line)
            remarks = []
        elif entry:
            entry.add(line)
        elif line.strip():
            out.append({"line": i + 1, "kind": "junk", "id": None, "value": line, "attributes": [], "comment": None, "section": None})
        else:
            remarks = []
    if entry:
        out.append(entry.row())
    return out


def parsed(texts: DataFrame, sections: bool = True) -> DataFrame:
    """Entries of whole Fluent files (file, text). A file is one task's work."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch["file"], batch["text"]):
                rows = parse(text, sections)
                made = {c: [r[c] for r in rows] for c in "line kind id value attributes comment section".split()}
                yield type(batch)({"file": [name] * len(rows), "ord": list(range(len(rows))), **made})

    return texts.select("file", "text").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, sections: bool = True) -> DataFrame:
    """Entries of the *.ftl under a path."""
    return parsed(files.whole(spark, path, "*.ftl", True), sections)


def by_locale(entries: DataFrame, source: str = "en") -> DataFrame:
    """Entries of translations, with the first folder of their file as locale."""
    return entries.withColumn("locale", F.substring_index("file", "/", 1)).where((F.col("locale") != source) & F.contains("file", F.lit("/")))


def units(entries: DataFrame, include_empty: bool = False) -> DataFrame:
    """(file, line, ord, pos, id, kind, attr, role, text, empty, comment, section): a value or an attribute a row; pos counts
    from the value (0) on."""
    none = F.struct(F.lit(None).cast("string").alias("name"), F.col("value").alias("value"))
    rows = entries.where("kind <> 'junk'").select("*", F.posexplode(F.concat(F.array(none), F.col("attributes"))).alias("pos", "u"))
    attr, text = F.col("u.name"), F.col("u.value")
    rows = rows.select("file", "line", "ord", "pos", "id", "kind", attr.alias("attr"), L.attribute_role(attr).alias("role"), text.alias("text"), L.is_empty(text).alias("empty"), "comment", "section")
    return rows if include_empty else rows.where("not empty")


def marked(spark: SparkSession, path: str) -> DataFrame:
    """Files that begin with a byte order mark."""
    return files.binary(spark, path, "*.ftl", True).where(F.hex(F.substring("content", 1, 3)) == "EFBBBF").select("file")
