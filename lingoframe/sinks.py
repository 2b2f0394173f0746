"""Where slices of files go: delimited text, JSON lines, and tab-separated units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_csv(wide: DataFrame, locales: list[str], path: str, separator: str = ",") -> None:
    """key, description and the chosen locales of selected rows, quoted as RFC 4180 has it."""
    cells = [F.coalesce(F.try_element_at("values", F.lit(x)), F.lit("")).alias(x) for x in locales]
    wide.select("key", "description", *cells).write.csv(path, sep=separator, header=True, quote='"', escape='"', emptyValue="")


def slice_json(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """An object a line, with nulls."""
    df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def tab_line(*columns: str):
    """Columns joined by tabs, with tabs and line breaks inside them written as \\t and \\n."""
    flat = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    return F.concat_ws("\t", *[flat(c) for c in columns])


def units_tsv(units: DataFrame, path: str) -> None:
    units.select(tab_line("file", "line", "id", "attr", "role", "text").alias("value")).write.text(path)


def key_text(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """key, tab, value in the order of files and lines; the first `limit` if one is given."""
    rows = entries.orderBy("file", "line").select(tab_line("key", "value").alias("value"))
    return rows if limit is None else rows.limit(limit)
