import base64
import math
import re
import resource

import corpus_pipeline
import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import functions as F

from helpers import VOICES, awkward, documents, empty, prose, words
from lingoframe.llm import bpe, compression, quality, queries, simhash


def folder(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(100, 160)] + [(i, 0, 0) for i in range(200, 220)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def corpus(spark):
    wide = [a + b for a in VOICES for b in ("", "s", "ly", "er", "ing", "ful")]
    rows = [(i, prose(i, 120, wide), "en", "a") for i in range(100, 160)]
    rows += [(i, " ".join(["buy now"] * (60 + i)), "en", "b") for i in range(200, 220)]
    rows += [(300, prose(100, 120, wide), "en", "a"), (301, prose(101, 118, wide) + " end", "en", "a")]
    rows += [(400, prose(5, 60, wide) + " " + prose(900, 40) + " " + prose(6, 60, wide), "en", "a")]
    return documents(spark, rows)


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    docs = corpus(spark)
    at = folder(spark, tmp_path, docs)
    out = corpus_pipeline.run(spark, at).collect()
    assert sorted(r.doc_id for r in out) == list(range(100, 160))
    assert all(r.decoded_same and len(r.token_ids) == r.n_tokens for r in out)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = awkward(spark).unionByName(corpus(spark)).withColumn("keep", F.col("lang")).withColumn("ratio", F.lit(3)).withColumn("lf_x", F.lit(1)).withColumn("n", F.lit("x"))
    at = folder(spark, tmp_path, docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.where("not (keep <=> lang) or ratio <> 3").count() == 0, name
        none = stage(spark, docs.limit(0), at)
        assert none.columns == docs.columns and none.count() == 0, name
    assert corpus_pipeline.run(spark, at).count() > 0


def features(text):
    n = len(text)
    count = lambda p: sum(map(len, regex.findall(p, text)))
    letters, capitals, digits, blanks, stops, calls, bars = map(count, (r"\p{L}", r"\p{Lu}", r"\p{N}", r"[ \t\n\x0b\f\r]", "[.,;:]", "[!?]", r"\|"))
    parts, lines = re.split(r"[ \t\n\x0b\f\r]+", text), text.split("\n")
    share = lambda a, b: a / b if b else 0.0
    kinds = math.log(len(set(parts))) / math.log(len(parts)) if len(parts) > 1 else 1.0
    rest = n - letters - digits - blanks - stops - calls - bars
    return [math.log1p(n) / 12, share(letters, n), share(capitals, letters), share(digits, n), share(stops, n) * 5, share(calls, n) * 5, share(bars, n) * 5, share(rest, n) * 5, min(share(letters, len(parts)) / 10, quality.LONGEST / 10), kinds, share(len(set(lines)), len(lines))]


def slow_quality(docs, labels):
    """Features by plain counting, shares by loops over all documents."""
    docs = [r for r in docs if (r.text or "").strip()]
    x = {r.doc_id: features(r.text) for r in docs}
    known = [i for i in labels if i in x]
    y = np.array([labels[i] for i in known], float)
    w = quality.fit(np.array([x[i] for i in known]), y)
    z = {i: max(min(float(quality.expanded(np.array([v]))[0] @ w), quality.FARTHEST), -quality.FARTHEST) for i, v in x.items()}
    p = {i: 1 / (1 + math.exp(-v)) for i, v in z.items()}
    host = lambda r: [p[o.doc_id] for o in docs if o.source == r.source]
    path = lambda r: [p[o.doc_id] for o in docs if (o.source, o.lang) == (r.source, r.lang)]
    mean = sum(p.values()) / len(p)

    def strength(groups):
        n, m, mu = (np.array(c, float) for c in zip(*[(len(g), np.mean(g), around) for g, around in groups if len(g) > 1]))
        within = np.mean(mu * (1 - mu))
        between = (np.mean(n * (m - mu) ** 2) - within) / np.mean(n)
        return quality.WEIGHTS[1] if between <= 0 or len(n) < 2 else min(max(within / between - 1, quality.WEIGHTS[0]), quality.WEIGHTS[1])

    one = {r.source: r for r in docs}.values()
    kh, kp = strength([(host(r), mean) for r in one]), strength([(path(r), np.mean(host(r))) for r in {(r.source, r.lang): r for r in docs}.values()])
    stay = set()
    for r in docs:
        h, s = host(r), path(r)
        a = (sum(h) - p[r.doc_id] + kh * mean) / (len(h) - 1 + kh)
        b = (sum(s) - p[r.doc_id] + kp * a) / (len(s) - 1 + kp)
        odds = z[r.doc_id] - math.log(y.mean() / (1 - y.mean())) + math.log(b / (1 - b))
        if odds >= 0:
            stay.add(r.doc_id)
    return stay


def slow_rules(docs):
    c, stay = zstandard.ZstdCompressor(level=3), set()
    for r in docs:
        data = (r.text or "").encode()
        if not data:
            continue
        ratio = lambda d: len(c.compress(d)) / len(d)
        low, high = [(lo, hi) for n, lo, hi in ((0, 0, 9), *compression.BANDS) if len(data) >= n][-1]
        starts = [*range(0, len(data) - 4095, 4096), *([len(data) - 4096] if len(data) > 4096 and len(data) % 4096 else [])]
        chunks = [ratio(data[a : a + 4096]) for a in starts]
        odd = sum(not 0.20 <= x <= 0.72 for x in chunks)
        if low <= ratio(data) <= high and odd <= 0.25 * len(chunks):
            stay.add(r.doc_id)
    return stay


def slow_duplicates(docs):
    marks, real = simhash.fingerprints_of([r.text or "" for r in docs])
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if real[i] and real[j] and sum((int(a) ^ int(b)).bit_count() for a, b in zip(marks[i], marks[j])) <= simhash.DISTANCE:
                group = [group[i] if g == group[j] else g for g in group]
    first = {}
    for k, r in enumerate(docs):
        first[group[k]] = min(first.get(group[k], r.doc_id), r.doc_id)
    return set(first.values())


def slow_decontamination(docs, item):
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    n = min(13, len(words(item)))
    return {r.doc_id for r in docs if not runs(words(r.text), n) & runs(words(item), n)}


def test_every_stage_as_by_brute_force(spark, tmp_path):
    wide = [a + b for a in VOICES for b in ("", "s", "ly", "er", "ing", "ful")]
    more = [(500 + k, prose(100 + k, 118, wide) + f" then {k}", "de", "c") for k in range(12)] + [(530 + k, prose(40 + k, 90, wide) + " ... " * (k * 9), "en", "d") for k in range(12)]
    more += [(550, prose(55, 60, wide) + " " + " ".join(prose(900, 40).split()[9:24]), "de", "c"), (551, prose(56, 60, wide) + " " + " ".join(prose(900, 40).split()[9:20]), "de", "c"), (552, None, "de", "c"), (553, " ", None, None), (554, "ok " * 4000, "en", "a"), (555, " ".join([prose(77, 150, wide)] * 6), "de", "c"), (556, prose(78, 500, wide) + " " + " ".join([prose(79, 100, wide)] * 8), "en", "a")]
    docs = corpus(spark).unionByName(documents(spark, more))
    at = folder(spark, tmp_path, docs)
    labels = {i: 1 for i in range(100, 160)} | {i: 0 for i in range(200, 220)}
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in bpe.vocabulary_lines(bpe.VOCABULARY).splitlines() if x)}
    coder = tiktoken.Encoding("other", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    slow = {"quality": lambda rows: slow_quality(rows, labels), "rules": slow_rules, "near_duplicates": slow_duplicates, "decontamination": lambda rows: slow_decontamination(rows, prose(900, 40))}
    now = docs.orderBy("doc_id").coalesce(2).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.collect()
        now = stage(spark, now, at).cache()
        stay = {r.doc_id for r in now.collect()}
        assert stay == slow[name](before), name
        assert 0 < len(stay) < len(before), name
    out = corpus_pipeline.STAGES[-1][1](spark, now, at).collect()
    assert len(out) == now.count() and all(r.token_ids == coder.encode_ordinary(r.text) and r.decoded_same for r in out)


def test_empty_corpus(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, empty(spark))).collect() == []


def test_every_operator_has_its_query():
    found = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(found) == sorted(f"op{k}" for k in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_a_large_group_of_near_duplicates_leaves_the_workers_small(spark):
    def held(batches):  # a worker is used again for later tasks, so that it has been through the stage
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024])], names=["mb"])

    words = prose(3, 200).split()
    rows = [(k, " ".join([*words[: k % 200], f"edit{k}", *words[k % 200 :]]), "en", "a") for k in range(4000)]
    stay = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    assert [r.doc_id for r in stay] == [0]
    assert spark.range(8, numPartitions=8).mapInArrow(held, "mb double").agg(F.max("mb")).first()[0] < 500
