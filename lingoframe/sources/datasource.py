"""The readers as data sources: spark.read.format("po" | "ftl" | "clausewitz" | "locale_csv").load(path)."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Files(DataSourceReader):
    def __init__(self, path: str, suffix: str, rows):
        self.path, self.suffix, self.rows = path.removeprefix("file://"), suffix, rows

    def partitions(self):
        root = Path(self.path)
        found = [root] if root.is_file() else sorted(root.rglob(f"*{self.suffix}"))
        return [InputPartition(str(p)) for p in found] or [InputPartition("")]

    def read(self, partition):
        if partition.value:
            text = Path(partition.value).read_bytes().decode("utf-8", "replace").removeprefix("﻿")
            yield from self.rows(text, Path(partition.value))


class PoSource(DataSource):
    """(file, lineno, msgctxt, msgid, msgid_plural, msgstr, flags, is_header) of catalogues."""

    @classmethod
    def name(cls):
        return "po"

    def schema(self):
        return "file string, lineno int, msgctxt string, msgid string, msgid_plural string, msgstr array<string>, flags array<string>, is_header boolean"

    def reader(self, schema):
        from lingoframe.sources import gettext

        keys = ("lineno", "msgctxt", "msgid", "msgid_plural", "msgstr", "flags", "is_header")
        return _Files(self.options["path"], self.options.get("suffix", ".po"), lambda text, p: [(p.name, *[r[k] for k in keys]) for r in gettext.parse(text)])


class FtlSource(DataSource):
    """(file, line, kind, id, value, comment, section) of Fluent files, attributes as rows of their own with attr set."""

    @classmethod
    def name(cls):
        return "ftl"

    def schema(self):
        return "file string, line int, kind string, id string, attr string, text string, comment string, section string"

    def reader(self, schema):
        from lingoframe.sources import fluent

        def rows(text, p):
            for r in fluent.parse(text):
                for attr, value in [(None, r["value"]), *[(a["name"], a["value"]) for a in r["attributes"]]]:
                    yield p.name, r["line"], r["kind"], r["id"], attr, value, r["comment"], r["section"]

        return _Files(self.options["path"], ".ftl", rows)


class CsvSource(DataSource):
    """(file, row, key, description, values) of CSV files."""

    @classmethod
    def name(cls):
        return "locale_csv"

    def schema(self):
        from lingoframe.sources import table

        return table.SCHEMA

    def reader(self, schema):
        from lingoframe.sources import table

        delimiter = self.options.get("delimiter", ",")
        return _Files(self.options["path"], ".csv", lambda text, p: [(r["file"], r["row"], r["key"], r["description"], r["values"]) for r in table.parse(text, p.name, delimiter)])


class ClausewitzSource(DataSource):
    """(file, line, text) of Clausewitz files, for sources.clausewitz.parsed()."""

    @classmethod
    def name(cls):
        return "clausewitz"

    def schema(self):
        return "file string, line int, text string"

    def reader(self, schema):
        return _Files(self.options["path"], ".yml", lambda text, p: [(p.name, k, line) for k, line in enumerate(_lines(text), 1)])


def _lines(text: str) -> list[str]:
    """As sources.files.lines has them: what follows the last line break is a line unless it is empty."""
    rows = re.split(r"\r\n|\r|\n", text)
    return rows[:-1] if rows[-1] == "" else rows


def register(spark: SparkSession) -> None:
    for source in (PoSource, FtlSource, CsvSource, ClausewitzSource):
        spark.dataSource.register(source)
