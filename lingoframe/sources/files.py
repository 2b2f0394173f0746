"""Whole files as rows: (file, content), paths relative to what was asked for."""

from __future__ import annotations

import zipfile
from io import BytesIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def relative(path: Column, root: str) -> Column:
    """A path under root, else the last part of it."""
    inside = F.lit("/" + root.removeprefix("file:").strip("/") + "/")
    bare = F.regexp_replace(path, "^[a-z]+:/*", "/")
    return F.when(F.instr(bare, inside) == 1, F.substr(bare, F.length(inside) + 1)).otherwise(F.substring_index(bare, "/", -1))


def binary(spark: SparkSession, path: str, glob: str, recursive: bool = False) -> DataFrame:
    """(file, content binary) of the files under a path."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select(relative(F.col("path"), path).alias("file"), "content")


def whole(spark: SparkSession, path: str, glob: str, recursive: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """(file, text), without a byte order mark; bytes that are no UTF-8 become U+FFFD."""
    text = F.decode("content", encoding) if encoding.upper() != "UTF-8" else F.make_valid_utf8(F.col("content").cast("string"))
    return binary(spark, path, glob, recursive).select("file", F.regexp_replace(text, "^﻿", "").alias("text"))


def zipped(spark: SparkSession, path: str, suffix: str = ".yml") -> DataFrame:
    """(file, content) of the members of zip archives with this suffix."""
    packed = binary(spark, path, "*.zip", True)

    def members(batches):
        for batch in batches:
            rows = {"file": [], "content": []}
            for name, data in zip(batch["file"], batch["content"]):
                with zipfile.ZipFile(BytesIO(data)) as z:
                    for member in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        rows["file"].append(f"{name}!{member}")
                        rows["content"].append(z.read(member))
            yield type(batch)(rows)

    return packed.mapInPandas(members, "file string, content binary")


def lines(texts: DataFrame) -> DataFrame:
    """(file, line, text): lines count from 1; what follows the last line break is a line unless it is empty."""
    split = texts.select("file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("at", "row"), F.size(F.split("text", r"\r\n|\r|\n")).alias("n"))
    return split.where((F.col("at") < F.col("n") - 1) | (F.col("row") != "")).select("file", (F.col("at") + 1).alias("line"), F.col("row").alias("text"))
