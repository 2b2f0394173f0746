import random

import numpy as np
from pyspark.sql import functions as F

from helpers import VOICES, awkward, documents, empty, prose
from lingoframe.llm import simhash


def near(spark, words, monkey=None, **how):
    rows = [((i, 0), *[int(x) for x in w.view(np.int64)]) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "node struct<doc_id: long, h: long>, f0 long, f1 long, f2 long, f3 long")
    got = simhash.near_edges(df, pairs=True, **how).collect()
    return {tuple(sorted((r.a.doc_id, r.b.doc_id))) for r in got}


def brute(words, distance):
    out = set()
    for i in range(len(words)):
        far = np.bitwise_count(words[i] ^ words[i + 1 :]).sum(axis=1, dtype=int)
        out |= {(i, i + 1 + j) for j in np.flatnonzero(far <= distance).tolist()}
    return out


def clustered(n, seed, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, (n, 4), dtype=np.uint64)
    copies = base[: n // 2].copy()
    for row, k in zip(copies, rng.integers(0, flips + 1, len(copies))):
        for b in rng.choice(256, k, replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    return np.concatenate([base, copies])


def test_pivots_link_what_all_pairs_link():
    rng = np.random.default_rng(5)

    def near(words, flips):
        bits = np.zeros(simhash.BITS, np.uint8)
        bits[rng.permutation(simhash.BITS)[:flips]] = 1
        return words ^ np.packbits(bits, bitorder="little").view(np.uint64)

    for far in (8, 30, 45, 60):
        words = [rng.integers(0, 1 << 63, 4).astype(np.uint64) for _ in range(12)]
        for k in range(500):  # groups around twelve, and chains that reach from one to the next
            words.append(near(words[rng.integers(12 if k % 3 else len(words))], int(rng.integers(1, far))))
        words = np.stack(words)[rng.permutation(512)]
        left, right = simhash.linking_pairs(words, simhash.DISTANCE)
        assert all(sum((int(a) ^ int(b)).bit_count() for a, b in zip(words[i], words[j])) <= simhash.DISTANCE for i, j in zip(left, right))
        same = simhash.forest(512, *simhash.brute_pairs(words, simhash.DISTANCE))
        assert (simhash.forest(512, left, right) == same).all() and len(set(same.tolist())) < 512
    assert [len(x) for x in simhash.linking_pairs(words[:0], 5)] == [0, 0] and [len(x) for x in simhash.linking_pairs(words[:1], 5)] == [0, 0]


def test_recall_is_that_aimed_at_and_nothing_else_is_found(spark):
    words = clustered(1200, 1, simhash.DISTANCE)
    want = brute(words, simhash.DISTANCE)
    got = near(spark, words)
    assert got <= want and len(got) >= 0.95 * len(want)


def test_pairs_at_the_limit_are_found_too(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, (600, 4), dtype=np.uint64)
    far = base.copy()
    for row in far:
        for b in rng.choice(256, simhash.DISTANCE, replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    words = np.concatenate([base, far])
    assert len(near(spark, words)) >= 0.9 * 600


def test_recursion_inside_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 40)
    words = clustered(900, 3, 40)
    rng = np.random.default_rng(0)
    want, got = brute(words, 52), set()
    for i, j in simhash.list_pairs(words, 52, 0.95, rng):
        got |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_a_list_full_of_near_duplicates_is_linked_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, (3, 4), dtype=np.uint64)
    words = base[rng.integers(3, size=6000)] ^ np.packbits(rng.random((6000, 256)) < 0.03, axis=1, bitorder="little").view(np.uint64)
    words = np.concatenate([words, rng.integers(0, 1 << 64, (3000, 4), dtype=np.uint64)])[rng.permutation(9000)]
    want = simhash.forest(9000, *simhash.linking_pairs(words, simhash.DISTANCE))
    tracemalloc.start()
    got = simhash.linked(9000, simhash.list_pairs(words, simhash.DISTANCE, 0.95, np.random.default_rng(1), every=False))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and len(set(got.tolist())) == 3003
    assert most < 60e6  # its pairs alone, six million of them, are 96 MB for each filter that all of them pass


def test_pairs_held_are_united_now_and_then(monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 5)
    rng = np.random.default_rng(8)
    pairs = rng.integers(0, 400, (2, 300))
    got = simhash.linked(400, ((pairs[0, k : k + 3], pairs[1, k : k + 3]) for k in range(0, 300, 3)))
    assert (got == simhash.forest(400, *pairs)).all() and len(set(got.tolist())) > 50
    assert simhash.linked(3, []).tolist() == [0, 1, 2]


def test_chance_of_passing_is_as_computed():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, (40_000, 4), dtype=np.uint64)
    b = a.copy()
    for k in rng.permutation(256)[:0]:
        b[:, k // 64] ^= np.uint64(1)
    flips = rng.random((40_000, 256)) < 52 / 256
    b ^= np.packbits(flips, axis=1, bitorder="little").view(np.uint64)
    seed = np.random.default_rng(9).integers(1 << 30)
    same = simhash.strip_filters(a, 1, np.random.default_rng(seed)) == simhash.strip_filters(b, 1, np.random.default_rng(seed))
    assert abs(same.mean() - simhash.pass_chance(52)) < 0.01


def test_fingerprint_is_the_sign_of_the_sums():
    from lingoframe.llm.textgrid import Grid, mixed

    text = "Silver bridge, silver BRIDGE of a river"
    grid = Grid([text])
    s, e, _ = grid.words()
    w = grid.hashes(s, e, fold=True)
    features = {int(h) for h, a, b in zip(w, s, e) if b - a >= 4} | {int(x) for x in mixed(w[:-1] * np.uint64(3) + w[1:])}
    total = np.zeros(256)
    for f in features:
        for k in range(4):
            h = int(mixed(np.array([f], np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))[0])
            total[k * 64 : k * 64 + 64] += [1 if h >> b & 1 else -1 for b in range(64)]
    got = simhash.fingerprints_of([text, "other words here", text.upper()])[0]
    assert (np.unpackbits(got[0].view(np.uint8), bitorder="little") == (total > 0)).all() and (got[0] == got[2]).all()


def copies(seed, n):
    rnd = random.Random(seed)
    out = prose(seed, n, [a + b for a in VOICES for b in ("", "s", "ly", "er", "ing")]).split()
    edited = [rnd.choice(VOICES) if rnd.random() < 0.03 else w for w in out]
    return " ".join(out), " ".join(edited)


def test_groups_of_exact_and_near_copies(spark):
    rows = []
    for k in range(30):
        a, b = copies(k, 200)
        rows += [(k * 10, a, "en", "a"), (k * 10 + 1, b, "en", "b")]
        if k % 3 == 0:
            rows.append((k * 10 + 2, a, "en", "c"))
    single = [(1000 + k, prose(500 + k, 150), "en", "a") for k in range(60)]
    got = simhash.duplicate_groups(documents(spark, rows + single)).collect()
    assert len(got) == 70 and all(r.group_id == r.doc_id // 10 * 10 for r in got)
    assert {r.doc_id for r in got if r.is_kept} == {k * 10 for k in range(30)}
    stay = simhash.deduplicated(documents(spark, rows + single)).collect()
    assert sorted(r.doc_id for r in stay) == [k * 10 for k in range(30)] + [1000 + k for k in range(60)]


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("lf", F.lit(1)).withColumn("F0", F.lit("clash")).withColumn("node", F.lit("clash"))
    got = simhash.duplicate_groups(docs).collect()
    assert got == []
    stay = simhash.deduplicated(docs)
    assert stay.columns == docs.columns
    assert stay.count() == docs.count() - 2  # the two repeated rows
    pair = documents(spark, [(None, prose(1, 90), "en", "a"), (4, prose(1, 90), None, None), (4, prose(1, 90) + "!", "en", "a")])
    assert [r.text for r in simhash.deduplicated(pair).collect()] == [prose(1, 90)]
    assert simhash.duplicate_groups(empty(spark)).collect() == [] and simhash.deduplicated(empty(spark)).collect() == []
