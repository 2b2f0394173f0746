"""One shape for what every validator reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("severity", "rule", "file", "line", "unit_id", "attr", "locale", "form_idx", "detail")
KINDS = dict(zip(NAMES, ("string", "string", "string", "bigint", "string", "string", "string", "int", "string")))


def finding(df: DataFrame, severity: str | Column, rule: str | Column, unit_id: str, detail: Column | None = None, **places: str) -> DataFrame:
    """Rows of df as findings. places: columns of df for file, line, attr, locale and form_idx; what isn't given is null."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    made = {"severity": lit(severity), "rule": lit(rule), "unit_id": F.col(unit_id), "detail": F.lit(None) if detail is None else detail} | {k: F.col(v) for k, v in places.items()}
    return df.select(*[made.get(n, F.lit(None)).cast(KINDS[n]).alias(n) for n in NAMES])


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summary(found: DataFrame) -> DataFrame:
    """How many of each severity and rule."""
    return found.groupBy("severity", "rule").agg(F.count("*").alias("n"))


def by_locale(found: DataFrame) -> DataFrame:
    """Counts by locale and rule, with totals by locale and over all ('*')."""
    counts = found.rollup("locale", "rule").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARN").alias("warnings"))
    whole = lambda c, least: F.when(F.col("g") >= least, "*").otherwise(F.col(c)).alias(c)
    return counts.select(whole("locale", 3), whole("rule", 1), "n", "errors", "warnings")
