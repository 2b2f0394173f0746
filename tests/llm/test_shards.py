import heapq
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingoframe.llm import shards


def slow(sizes, n):
    heap, out = [(0, s) for s in range(n)], []
    for size in sizes:
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
        out.append(s)
    return out


@given(st.lists(st.integers(1, 12), max_size=120), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_schedule_is_that_of_the_heap(sizes, n):
    sizes = sorted(sizes, reverse=True)
    kinds = sorted(set(sizes), reverse=True)
    rows, loads = shards.schedule(kinds, [sizes.count(k) for k in kinds], n)
    got = []
    for size, first, cycle in rows:
        got += [first[i] if i < len(first) else cycle[(i - len(first)) % len(cycle)] for i in range(sizes.count(size))]
    want = slow(sizes, n)
    assert got == want
    assert loads == [sum(x for x, s in zip(sizes, want) if s == k) for k in range(n)]


def test_rows_of_a_group_stay_together(spark):
    rnd = random.Random(2)
    rows = [(i, f"g{rnd.randrange(40)}", rnd.randrange(1, 50), "x") for i in range(300)]
    rows += [(900, None, 5, "x"), (901, None, 5, None), (902, "g1", None, "x"), (903, "zero", 0, "x"), (904, "minus", -4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, g string, b int, shard string")
    out = shards.assign(df, "g", "b", 7)
    assert out.columns == ["doc_id", "g", "b", "group_size", "shard"]
    got = out.collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    placed = {r.g: r.shard for r in got if r.g is not None}
    assert all(placed[r.g] == r.shard for r in got if r.g is not None)
    groups = {}
    for _, g, b, _ in rows:
        if g is not None:
            groups[g] = groups.get(g, 0) + max(b or 0, 0)
    want = [(-s, 1, g) for g, s in groups.items()] + [(-5, 0, i) for i in range(2)]
    want = [w for w in sorted(want) if w[0]]
    expected = slow([-s for s, _, _ in want], 7)
    assert all(placed[w[2]] == e for w, e in zip(want, expected) if w[1])
    assert {0 <= r.shard < 7 for r in got} == {True}


def test_zero_sizes_are_dealt_out(spark):
    df = spark.createDataFrame([(f"g{i}", 0) for i in range(20)], "g string, b int")
    assert sorted(r["count"] for r in shards.assign(df, "g", "b", 4).groupBy("shard").count().collect()) == [5] * 4


def test_clashing_and_dotted_names(spark):
    df = spark.createDataFrame([(1, "a", 5, "x", "y"), (2, "a", 5, "x", "y"), (3, "b", 7, None, "z")], "n int, `g.k` string, `s.b` int, `Odd.Name` string, lf_part string")
    out = shards.assign(df, "g.k", "s.b", 2)
    assert out.columns == [*df.columns, "group_size", "shard"]
    assert sorted((r.n, r["Odd.Name"], r.group_size, r.shard) for r in out.collect()) == [(1, "x", 10, 0), (2, "x", 10, 0), (3, None, 7, 1)]


def test_many_groups_of_one_size_keep_their_order(spark):
    df = spark.range(3000).select(F.format_string("k%05d", "id").alias("g"), F.when(F.col("id") % 3 == 0, 9).otherwise(4).alias("b")).repartition(9)
    got = {r.g: r.shard for r in shards.assign(df, "g", "b", 7).collect()}
    order = sorted(got, key=lambda g: (-(9 if int(g[1:]) % 3 == 0 else 4), g))
    assert [got[g] for g in order] == slow([9 if int(g[1:]) % 3 == 0 else 4 for g in order], 7)


def test_empty_table(spark):
    assert shards.assign(spark.createDataFrame([], "g string, b int"), "g", "b").collect() == []
    assert F is not None
