"""The closed vocabularies as rows, for broadcast joins; what isn't in them is labelled unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingoframe.functions import clausewitz, fluent, gettext, tabular

SCHEMA = "format string, construct string, name string, role string, origin string"


def rows() -> list[tuple[str, str, str, str, str]]:
    """(format, construct, name, role, origin): a fixed number of them, whatever the data."""
    out = [("csv", "column", n, r, o) for n, r, o in [("key", "identity", "project"), ("description", "context", "project"), ("en", "source", "format"), *[(x, "translation", "format") for x in "zh fr pt pl ua th es".split()]]]
    out += [("csv", "tag", n, "status", "project") for n in ("EMPTY", "DEPRECATED")] + [("csv", "tag", n, "pos", "project") for n in ("noun", "verb")]
    out += [("csv", "shape", n, n, "format") for n in (tabular.SCALAR, tabular.ARRAY, tabular.EMPTY)]
    out += [("csv", "token", n, n, "format") for n, _ in tabular.TOKENS] + [("csv", "key", n, n, "project") for n, _ in tabular.KEY_CONSTRUCTS]
    out += [("cwz", "token", n, n, "format") for n, _ in clausewitz.INLINE] + [("cwz", "colour", c, "colour", "format") for c in clausewitz.COLOURS]
    out += [("cwz", "part", w, kind, "project") for kind, words in clausewitz.CORE_PARTS.items() for w in words]
    out += [("ftl", "attribute", n, r, "project") for n, r in [("desc", "metadata"), ("stat", "metadata"), *[(g, "gender") for g in fluent.GENDER]]]
    out += [("ftl", "attribute", w, "enum", "project") for words in fluent.ENUMS.values() for w in words.split()]
    out += [("ftl", "placeable", n, n, "fluent") for n in "literal msg-ref selector term-ref var".split()]
    out += [("ftl", "function", n, "formatter", o) for n, o in (("NUMBER", "fluent"), ("DATETIME", "fluent"), ("TAIL", "project"))]
    out += [("ftl", "variant-key", n, "plural", "fluent") for n in fluent.CLDR] + [("ftl", "piece", n, "selector", "fluent") for n in ("selector-head", "selector-key", "selector-close")]
    out += [("ftl", "engine-variable", n, "agreement", "project") for n in fluent.ENGINE]
    out += [("po", "token", n, n, "format") for n, _ in gettext.TOKENS] + [("po", "tag", n, "pango", "format") for n in gettext.PANGO] + [("po", "tag", n, "docbook", "format") for n in gettext.DOCBOOK]
    out += [("po", "family", n, slug, "project") for n, slug in gettext.SLUGS.items()] + [("po", "domain", d, g, "project") for g, ds in gettext.GROUPS.items() for d in ds]
    return out


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA)


def labelled(df: DataFrame, name_col: str, format_: str, construct: str) -> DataFrame:
    """Add role and origin; 'other' and 'unknown' where the registry lacks the name. The registry is of a fixed size."""
    part = registry(df.sparkSession).where((F.col("format") == format_) & (F.col("construct") == construct)).select(F.col("name").alias("reg_name"), "role", "origin")
    joined = df.join(F.broadcast(part), F.col(name_col) == F.col("reg_name"), "left").drop("reg_name")
    return joined.withColumn("role", F.coalesce("role", F.lit("other"))).withColumn("origin", F.coalesce("origin", F.lit("unknown")))
