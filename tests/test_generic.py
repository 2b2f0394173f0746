"""Formats of one's own, and bundles read again."""

from pyspark.sql import functions as F

from lingoframe.functions.strings import found
from lingoframe.operators import generic
from lingoframe.sources import bundle


def test_pairs(spark):
    src = spark.createDataFrame([("k", None, "old %x%", 1), ("k", None, "go %x% <1>", 2), ("j", "c", "plain", 3)], "k string, c string, text string, ord int")
    tgt = spark.createDataFrame([("k", None, "idz %y% <1> <1>", 1), ("j", "c", "zwykly", 2), ("j", None, "sierota", 3), ("k", "z", None, 4)], "k string, c string, text string, ord int")
    odd = lambda rows: rows.where(F.size(found(F.col("text"), "z")) > 1).select("k", F.lit("WARN").alias("severity"), F.lit("odd").alias("rule"), F.lit("").alias("detail"))
    got = sorted((r.rule, r.unit_id, r.detail or "") for r in generic.crosslocale(src, tgt, ["k", "c"], "k", ["%[a-z]%"], r"<\d>", problems=odd).collect())
    assert got == [("pair.counted_extra", "k", "<1>x1"), ("pair.dropped", "k", "%x%"), ("pair.invented", "k", "%y%"), ("pair.orphan", "j", "")]


def test_bundles_are_read_again(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text('{"id": "a", "n": 1}\n{"id": \nnot json\n')
    schema = spark.createDataFrame([], "id string, n int").schema
    good, bad = bundle.split(bundle.read(spark, str(tmp_path / "lines.jsonl"), schema))
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and bad.count() == 2
