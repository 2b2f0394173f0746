"""Bundles read again as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

BAD = "unread"


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of JSON lines, with a column `unread` that holds what a line is if it holds no such object, else null."""
    wide = StructType([*schema.fields, StructField(BAD, StringType())])
    made = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return spark.read.text(path).select(made.alias("r")).select("r.*")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and lines that hold none."""
    return rows.where(F.col(BAD).isNull()).drop(BAD), rows.where(F.col(BAD).isNotNull()).select(BAD)
