"""Which format a file has, by its own signs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingoframe.sources import files

SIGNS = (
    ("po", r"(?m)^msgid \"", r"(?m)^msgstr(\[\d+\])? \""),
    ("clausewitz", r"(?m)^\s*l_[a-z_]+:\s*(#.*)?$", r'(?m)^\s*[A-Za-z0-9_.\-]+:\s*\d*\s*".*"'),
    ("ftl", r"(?m)^-?[a-zA-Z][-_a-zA-Z0-9]*[ \t]*=", r"\{\s*[$\"-]|(?m)^[ \t]+\.[A-Za-z]"),
    ("csv", r"^[^\r\n]*\bkey\b[^\r\n]*,", r"^([^\r\n,]*,)+[^\r\n]*\R([^\r\n]*,)"),
)
SUFFIXES = (("po", r"\.pot?\z"), ("clausewitz", r"\.ya?ml\z"), ("ftl", r"\.ftl\z"), ("csv", r"\.[ct]sv\z"))


def detect(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, format, score): two points a sign found in the text, one for the suffix; 'unknown' under two points."""
    text = F.col("text")
    score = {name: sum(F.regexp_like(text, F.lit(s)).cast("int") * 2 for s in signs) for name, *signs in SIGNS}
    for name, suffix in SUFFIXES:
        score[name] = score[name] + F.regexp_like("file", F.lit(suffix)).cast("int")
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(n).alias("format")) for n, s in score.items()]))
    rows = files.whole(spark, path, glob, True).select("file", best.alias("b"))
    return rows.select("file", F.when(F.col("b.score") >= 2, F.col("b.format")).otherwise("unknown").alias("format"), F.col("b.score").alias("score"))
