"""Clausewitz localisation files: lines to entries and warnings, all by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingoframe.sources import files

ENTRY = r'^(?s)\s*([\w.\-]+):\s*(\d*)\s*"(.*)"\s*(#.*)?\z'
HEADER = r"\A\s*l_([_a-z]+):\s*(#.*)?\z"


def parsed(lines: DataFrame) -> DataFrame:
    """(file, line, text) to the same with lang, is_entry, key, version, value and warning ('multiline?', 'malformed' or null);
    blank lines, comments and headers are dropped. A header holds until the next one of its file, '?' before the first; a
    version of more digits than a bigint has is null.

    The quotes that count are the first and the last of a line, so a comment with a quote in it is swallowed.
    """
    text = F.col("text")
    header = F.when(F.regexp_like(text, F.lit(HEADER)), F.regexp_extract(text, HEADER, 1))
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("header", header).withColumn("lang", F.coalesce(F.last("header", ignorenulls=True).over(upto), F.lit("?")))
    rows = rows.where(F.col("header").isNull() & ~F.regexp_like(text, F.lit(r"(?U)^\s*(#.*)?\z")))
    entry = F.regexp_like(text, F.lit(ENTRY))
    take = lambda g: F.when(F.col("is_entry"), F.regexp_extract(text, ENTRY, g))
    odd = F.regexp_count(text, F.lit('"')) % 2 == 1
    rows = rows.withColumn("is_entry", entry)
    return rows.select(
        "file", "line", "text", "lang", "is_entry", take(1).alias("key"), F.nullif(take(2), F.lit("")).try_cast("bigint").alias("version"), take(3).alias("value"),
        F.when(~F.col("is_entry"), F.when(odd, "multiline?").otherwise("malformed")).alias("warning"),
    )


def entries(rows: DataFrame) -> DataFrame:
    return rows.where("is_entry").select("file", "line", "lang", "key", "version", "value")


def warnings(rows: DataFrame) -> DataFrame:
    return rows.where("not is_entry").select("file", "line", F.col("warning").alias("kind"), F.substring("text", 1, 80).alias("text"))


def read(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Parsed lines of a file or of the *.yml of a folder (not of those below it)."""
    return parsed(files.lines(files.whole(spark, path, "*.yml", encoding=encoding)))


def overridden(rows: DataFrame, replaces: Column, order: list[Column]) -> DataFrame:
    """One entry a key and language: those of a replace folder win, then the last in load order."""
    best = Window.partitionBy("key", "lang").orderBy(replaces.desc(), *[c.desc() for c in order])
    return rows.withColumn("lf_turn", F.row_number().over(best)).where("lf_turn = 1").drop("lf_turn")
