"""Small tables with every awkward case, and slow versions to hold the operators against."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
VOICES = "river stone garden winter quiet morning letter window travel silver bridge harbor market evening forest candle meadow thunder orchard village lantern pepper copper violin saddle marble ribbon basket kettle feather".split()


def prose(seed, n, words=VOICES):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, an id with two texts."""
    long = prose(1, 60_000)
    rows = [(1, prose(2, 80), "en", "a"), (1, prose(2, 80), "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"), (5, long, "en", "b"), (None, prose(3, 50), "en", None), (None, prose(3, 50), "en", None), (6, "é中😀\u0000x" * 5, None, "a"), (7, prose(4, 70), "fr", "c"), (7, prose(5, 70), "fr", "c"), (8, "x" * 5000, "en", "a")]
    return documents(spark, rows)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())
