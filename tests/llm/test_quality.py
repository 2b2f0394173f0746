import math
import random

import numpy as np
from pyspark.sql import functions as F

from helpers import awkward, documents, empty, prose
from lingoframe.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def junk(seed):
    rnd = random.Random(seed)
    kind = seed % 4
    if kind == 0:
        return " ".join([rnd.choice(["buy", "now", "cheap"])] * 80)
    if kind == 1:
        return " | ".join(prose(seed, 60).split())
    if kind == 2:
        return " ".join(w + rnd.choice(["$$$", "###"]) for w in prose(seed, 60).split())
    return "!! ".join(prose(seed, 60).upper().split())


def corpus(spark, n=600):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < (0.95 if i % 5 else 0.3)
        rows.append((i, prose(1000 + i, rnd.randint(20, 120)) if good else junk(i), "en" if i % 2 else "de", f"s{i % 5}"))
        labels.append((i, int(good), 0))
    return documents(spark, rows), labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    half = spark.createDataFrame(labels[: len(labels) // 2], LABELS)
    got = {r.doc_id: r.keep for r in quality.judged(docs, half, keep=["doc_id"]).collect()}
    rest = labels[len(labels) // 2 :]
    good = [got[i] for i, q, _ in rest if q]
    bad = [got[i] for i, q, _ in rest if not q]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_shares_shrink_as_computed_by_hand(spark):
    docs, labels = corpus(spark, 200)
    rows = quality.judged(docs, spark.createDataFrame(labels, LABELS)).collect()
    z = {r.doc_id: r.evidence for r in rows}
    y = np.mean([q for _, q, _ in labels])
    odds = math.log(y / (1 - y))
    p = {i: 1 / (1 + math.exp(-(e + odds))) for i, e in z.items()}
    host = {h: [p[r.doc_id] for r in rows if r.source == h] for h in {r.source for r in rows}}
    path = {k: [p[r.doc_id] for r in rows if (r.source, r.lang) == k] for k in {(r.source, r.lang) for r in rows}}
    mean = np.mean(list(p.values()))

    def strength(groups, around):
        n = np.array([len(g) for g in groups])
        m = np.array([np.mean(g) for g in groups])
        mu = np.array(around)
        within = np.mean(mu * (1 - mu))
        between = ((n * (m - mu) ** 2).mean() - within) / n.mean()
        low, high = quality.WEIGHTS
        return high if between <= 0 else min(max(within / between - 1, low), high)

    hosts, paths = sorted(host), sorted(path)
    kh = strength([host[h] for h in hosts], [mean] * len(hosts))
    kp = strength([path[k] for k in paths], [np.mean(host[k[0]]) for k in paths])
    for r in rows:
        h = (sum(host[r.source]) - p[r.doc_id] + kh * mean) / (len(host[r.source]) - 1 + kh)
        s = (sum(path[r.source, r.lang]) - p[r.doc_id] + kp * h) / (len(path[r.source, r.lang]) - 1 + kp)
        assert math.isclose(r.host_share, h, rel_tol=1e-9) and math.isclose(r.path_share, s, rel_tol=1e-9)
        want = 1 / (1 + math.exp(-(r.evidence + math.log(s / (1 - s)))))
        assert math.isclose(r.posterior, want, rel_tol=1e-9) and r.keep == (want >= 0.5)
    assert min(r.host_share for r in rows if r.source != "s0") > max(r.host_share for r in rows if r.source == "s0")


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs, labels = corpus(spark, 200)
    labels = spark.createDataFrame(labels, LABELS)
    one = {r.doc_id: r.posterior for r in quality.judged(docs, labels).collect()}
    monkeypatch.setattr(quality, "SENT_PATHS", 0)
    other = {r.doc_id: r.posterior for r in quality.judged(docs, labels).collect()}
    assert one.keys() == other.keys() and all(math.isclose(one[k], other[k], rel_tol=1e-9) for k in one)


def test_score_is_the_dot_product(spark):
    rng = np.random.default_rng(1)
    x, w = rng.random((20, quality.N_FEATURES)), rng.standard_normal(1 + quality.N_FEATURES * (quality.N_FEATURES + 3) // 2)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    got = [r[0] for r in df.select(quality._score(F.col("x"), w)).collect()]
    assert np.allclose(sorted(got), sorted(quality.expanded(x) @ w))


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("x", F.lit(1)).withColumn("keep", F.lit("clash")).withColumn("lf_was", F.lit(2))
    some, labels = corpus(spark, 80)
    both = docs.unionByName(some.withColumns({"doc_id": F.col("doc_id") + 100, "x": F.lit(1), "keep": F.lit("c"), "lf_was": F.lit(2)}))
    marked = spark.createDataFrame([(i + 100, q, t) for i, q, t in labels] + [(1, None, 0), (None, 1, 0), (100, 1, 0)], LABELS)
    rows = quality.judged(both, marked).collect()
    assert len(rows) == both.count()
    for r in rows:
        if not (r.text or "").strip():
            assert r.posterior is None and r.evidence is None and not r.keep
        else:
            assert 0 < r.posterior < 1
    none = spark.createDataFrame([], LABELS)
    assert all(r.keep == bool((r.text or "").strip()) for r in quality.judged(docs, none).collect())
    assert quality.judged(empty(spark), marked).collect() == []


def test_kept_columns_of_any_name(spark):
    docs, labels = corpus(spark, 60)
    docs = docs.withColumn("Odd.Name", F.col("doc_id") * 2).withColumn("Lf_Row", F.lit("x"))
    marked = spark.createDataFrame(labels, LABELS)
    some = quality.judged(docs, marked, keep=["doc_id", "Odd.Name"])
    assert some.columns[:2] == ["doc_id", "Odd.Name"] and all(r["Odd.Name"] == 2 * r.doc_id for r in some.collect())
    assert quality.judged(docs, marked).columns[: len(docs.columns)] == docs.columns


def test_sample_is_the_first_by_hash(spark, monkeypatch):
    docs, labels = corpus(spark, 300)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((x, y)) or np.zeros(1 + quality.N_FEATURES * (quality.N_FEATURES + 3) // 2))
    narrow = docs.select(F.col("doc_id").alias("lf_id"), quality.features(F.col("text")).alias("lf_x"))
    marked = spark.createDataFrame(labels, LABELS)
    x = {r.lf_id: list(r.lf_x) for r in narrow.collect()}
    order = [r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    for n in (40, 150, 300, 1000):
        quality.train(narrow, marked, "doc_id", "quality", n)
        got, y = seen.pop()
        assert np.array_equal(got, np.array([x[i] for i in order[:n]])) and y.tolist() == [labels[i][1] for i in order[:n]]
    hot = narrow.withColumn("lf_id", F.when(F.col("lf_id") % 3 == 0, F.lit(7)).otherwise(F.col("lf_id")))
    quality.train(hot, marked, "doc_id", "quality", 60)
    assert len(seen.pop()[1]) == 60
