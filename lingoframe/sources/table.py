"""CSV files with a key, a description and one column for each locale."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingoframe.sources import files

SCHEMA = "file string, row int, key string, description string, values map<string,string>"


def parse(text: str, file: str = "", delimiter: str = ",", key: str = "key", context: str | None = "description", empty_mark: str | None = None) -> list[dict]:
    """Rows of one file, numbered as records (the header is row 1). empty_mark: a cell that says it is empty on purpose, and is
    read as ''. An empty file, a header without key or context, or a row
    of another width raises ValueError."""
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    header = next(reader, None)
    if header is None:
        raise ValueError(f"{file}: no header")
    for name in (key, context):
        if name is not None and name not in header:
            raise ValueError(f"{file}: no column {name}")
    out = []
    for number, cells in enumerate(reader, 2):
        if len(cells) != len(header):
            raise ValueError(f"{file}: record {number} has {len(cells)} cells, not {len(header)}")
        named = dict(zip(header, ["" if empty_mark is not None and c == empty_mark else c for c in cells]))
        out.append({"file": file, "row": number, "key": named[key], "description": named.get(context, "") if context else "", "values": {c: v for c, v in named.items() if c not in (key, context)}})
    return out


def parsed(texts: DataFrame, delimiter: str = ",", key: str = "key", context: str | None = "description", empty_mark: str | None = None) -> DataFrame:
    """(file, row, key, description, values) of whole CSV files (file, text). A file is one task's work, since a quoted cell may
    hold line breaks."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch["file"], batch["text"]):
                rows = parse(text, name, delimiter, key, context, empty_mark)
                yield type(batch)({c: [r[c] for r in rows] for c in ("file", "row", "key", "description", "values")})

    return texts.select("file", "text").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, delimiter: str = ",", key: str = "key", context: str | None = "description", empty_mark: str | None = None) -> DataFrame:
    """The rows of the CSV files of a path."""
    return parsed(files.whole(spark, path, "*.csv"), delimiter, key, context, empty_mark)


def header(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(file, column) of the header lines."""
    first = files.whole(spark, path, "*.csv").select("file", F.split(F.regexp_extract("text", r"^([^\r\n]*)", 1), delimiter).alias("c"))
    return first.select("file", F.explode("c").alias("column"))
