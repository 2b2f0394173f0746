import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lingoframe.llm import shared


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Elsewhere)


def test_running_sums_are_those_of_a_plain_loop(spark):
    rnd = random.Random(4)
    # Half of the rows are of one group, some of no group, and many agree in all columns.
    rows = [(rnd.choice(["hot", "hot", "a", "b", None]), rnd.choice([None, *range(6)]), rnd.randrange(9)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    got = shared.running(df.withColumn("Odd.Name", F.lit(1)), "g", ["o", "v"], "v", "upto")
    assert got.columns == ["g", "o", "v", "Odd.Name", "upto"]
    key = lambda r: (r[1] is None, r[1] or 0, r[2])
    found, want = {}, {}
    for r in got.collect():
        found.setdefault(r.g, []).append((key(r), r.upto))
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=key):
            want.setdefault(g, []).append((key(r), total))
            total += r[2]
    assert {g: sorted(x) for g, x in found.items()} == {g: sorted(x) for g, x in want.items()}
    assert shared.running(df.limit(0), "g", ["o"], "v", "upto").collect() == []


def test_slabs_are_whole_rows_in_order():
    texts = ["ab", None, "", "\U0001f600" * 3, "x" * 20, "yz", None]
    got = list(shared.slabs(pa.array(texts), 5))
    assert [(a, b) for a, b, _ in got] == [(0, 4), (4, 5), (5, 7)]
    assert [t for _, _, some in got for t in some] == texts
    assert [x for x in shared.slabs(pa.nulls(3))] == [(0, 3, [None] * 3)] and not list(shared.slabs(pa.array([], pa.string())))


def test_arrow_batches_are_small_unless_the_session_was_told_a_size(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = spark.range(3000, numPartitions=1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    told = spark.conf.get(shared.BATCH_SETTING, None)
    try:
        spark.conf.unset(shared.BATCH_SETTING)
        shared.small_batches(spark)
        assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 2 * shared.BATCH_BYTES
        spark.conf.set(shared.BATCH_SETTING, "16m")
        shared.small_batches(spark)
        assert spark.conf.get(shared.BATCH_SETTING) == "16m"
    finally:
        spark.conf.set(shared.BATCH_SETTING, told) if told else spark.conf.unset(shared.BATCH_SETTING)
