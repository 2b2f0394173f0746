import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import awkward, documents, empty, prose, words
from lingoframe.llm import suffixes

ITEMS = "item_id long, text string"


def slow(docs, items, least):
    """Longest common runs of words of all pairs by dynamic programming."""
    out = set()
    for r, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v:
                continue
            table, best = np.zeros((len(w) + 1, len(v) + 1), int), 0
            for a in range(len(w)):
                for b in range(len(v)):
                    if w[a] == v[b]:
                        table[a + 1, b + 1] = table[a, b] + 1
            best = int(table.max())
            if best >= min(least, len(v)):
                out.add((r, i, best))
    return out


@pytest.mark.parametrize("shard_words", [1 << 20, 17])
@pytest.mark.parametrize("seed", range(12))
def test_matches_are_those_of_brute_force(seed, shard_words):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "c", "the", "of"] if seed % 2 else [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 20)))) for k in range(6)]
    docs = []
    for _ in range(12):
        p = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.5:
            v = rnd.choice(items)[1].split()
            p[5:5] = [x.upper() + "," for x in v[rnd.randint(0, max(0, len(v) - 1)) :]]
        docs.append(" ".join(p))
    docs += docs[:3] + [None, ""]
    tests = suffixes.Tests(items, 6)
    batch = pa.RecordBatch.from_arrays([pa.array(docs)], names=["text"])
    got, at = [], 0
    for piece, found in suffixes._searched([batch], "text", tests, shard_words):
        got += [(r + at, *rest) for r, *rest in found]
        at += piece.num_rows
    assert at == len(docs)
    assert {(r, i, n) for r, i, n, *_ in got} == slow(enumerate(docs), items, 6)
    for r, i, n, a, b, w in got:
        assert words(docs[r][a:b]) == words(dict(items)[i])[w : w + n]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for top in (1, 3, 50):
        rank = rng.integers(0, top, 400)
        order, _ = suffixes.suffix_array(rank, 1000)
        suffix = [rank[i:].tolist() for i in order]
        assert suffix == sorted(suffix)


def test_tables(spark):
    item = prose(77, 30)
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, ""), (4, "four words are few"), (5, "exactly seven words stand in this item"), (1, item)], ITEMS)
    cut = " ".join(item.split()[4:20])
    rows = [(1, "before " + cut + " after", "en", "a"), (2, "before " + " ".join(item.split()[:12]), "en", "a"), (3, "EXACTLY seven: words - stand in this\nitem!", "en", "a"), (4, prose(5, 60), "en", "a"), (None, item, "en", None), (5, "four words are few", "en", "a"), (1, "before " + cut + " after", "en", "a"), (6, prose(6, 3000) + " " + item + " " + prose(7, 3000), "en", "a")]
    docs = documents(spark, rows).withColumn("item_id", F.lit("clash")).withColumn("a.b", F.lit(1))
    for shard_words in (1 << 20, 100):
        got = suffixes.matches(docs, bench, shard_words=shard_words).collect()
        assert sorted(((r.doc_id, r.item_id, r.words) for r in got), key=str) == sorted([(1, 1, 16)] * 4 + [(3, 5, 7), (5, 4, 4)] + [(None, 1, 30)] * 2 + [(6, 1, 30)] * 2, key=str)
        clean = suffixes.decontaminated(docs, bench, shard_words=shard_words)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 4]


def test_ids_of_any_type_and_short_items(spark):
    bench = spark.createDataFrame([("one", "zebra"), ("two", "blue zebra"), ("three", "the blue zebra"), ("none", "...")], "`Item.Id` string, text string")
    docs = spark.createDataFrame([("a", "A blue   ZEBRA!"), ("b", "the blue zebra"), ("c", "zebras are blue"), ("d", "")], "`Doc.Id` string, text string")
    got = suffixes.matches(docs, bench, "Doc.Id", item_col="Item.Id")
    assert got.schema["item_id"].dataType.simpleString() == "string" and got.schema["doc_id"].dataType.simpleString() == "string"
    rows = {(r.doc_id, r.item_id, r.words, r.text_start, r.text_end, r.item_start) for r in got.collect()}
    assert rows == {("a", "one", 1, 9, 14, 0), ("a", "two", 2, 2, 14, 0), ("b", "one", 1, 9, 14, 0), ("b", "two", 2, 4, 14, 0), ("b", "three", 3, 0, 14, 0)}
    assert sorted(r[0] for r in suffixes.decontaminated(docs, bench, item_col="Item.Id").collect()) == ["c", "d"]


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PASS_BYTES", 200)
    items = [(k, prose(100 + k, 25)) for k in range(12)]
    bench = spark.createDataFrame(items, ITEMS)
    docs = documents(spark, [(k, prose(300 + k, 20) + " " + t, "en", "a") for k, t in items] + [(50, prose(9, 90), "en", "a")])
    assert {(r.doc_id, r.item_id) for r in suffixes.matches(docs, bench).collect()} >= {(k, k) for k, _ in items}
    assert [r.doc_id for r in suffixes.decontaminated(docs, bench).collect()] == [50]


def test_awkward_and_empty(spark):
    bench = spark.createDataFrame([(1, prose(2, 80))], ITEMS)
    docs = awkward(spark)
    assert sorted(r.doc_id for r in suffixes.matches(docs, bench).collect()) == [1, 1]
    assert suffixes.decontaminated(docs, bench).count() == docs.count() - 2
    none = bench.limit(0)
    assert suffixes.matches(docs, none).collect() == [] and suffixes.decontaminated(docs, none).count() == docs.count()
    assert suffixes.matches(empty(spark), bench).collect() == [] and suffixes.decontaminated(empty(spark), bench).collect() == []


def test_a_batch_of_many_texts_is_searched_in_bounded_memory():
    import tracemalloc

    rng, some = np.random.default_rng(5), np.array([f"w{k:05}" for k in range(30_000)])
    texts = [" ".join(some[rng.integers(30_000, size=600)]) for _ in range(4000)]
    item = " ".join(texts[7].split()[40:60])
    texts[3000] += " " + item
    tests, batch = suffixes.Tests([(0, item)], 13), pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    list(suffixes._searched([batch.slice(0, 2)], "text", tests, suffixes.SHARD_WORDS))  # tables that are made once
    tracemalloc.start()
    found = [r for _, some in suffixes._searched([batch], "text", tests, suffixes.SHARD_WORDS) for r in some]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[0] for r in found] == [7, 3000] and all(r[2] == 20 for r in found)
    assert most < 100e6
