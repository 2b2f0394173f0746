import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helpers import awkward, documents, empty, prose
from lingoframe.llm import attention as lm
from lingoframe.llm import bpe


def lexicon(seed=0, n=60):
    return lm.Lexicon(np.random.default_rng(seed).integers(0, 50, n))


def weights(lex, seed=1):
    """Of a model that was trained, whose nodes don't all choose alike."""
    w, rng = lm.first_weights(lex, seed), np.random.default_rng(seed)
    w["D"] = rng.standard_normal(w["D"].shape).astype(np.float32)
    w["W"] = (rng.standard_normal(w["W"].shape) * 0.3).astype(np.float32)
    return w


def batch(texts, kind="<u2"):
    return pa.RecordBatch.from_arrays([pa.array([np.array(t, kind).tobytes() for t in texts], pa.binary())], names=["ids"])


def cut(ids, counts):
    at = np.append(0, np.cumsum(counts))
    return [ids[a:b] for a, b in zip(at, at[1:])]


def slow_score(w, lex, ids):
    """Each id by itself: its context is the block it stands in and the one before."""
    total = 0.0
    units = [lm.BOS, *(np.array(ids[:-1]) + 2).tolist()] if len(ids) else []
    for t, target in enumerate(ids):
        begin = max(0, t // lm.STRIDE * lm.STRIDE - lm.STRIDE)
        x = w["E"][units[begin : t + 1]].astype(np.float64)
        s = x @ (x[-1] @ w["Q"]) + w["D"][np.arange(len(x))[::-1]]
        a = np.exp(s) / np.exp(s).sum()
        h = x[-1] + (a @ x) @ w["V"]
        for level in range(lex.depth[target]):
            z = h @ w["W"][lex.node[level, target]] + w["c"][lex.node[level, target]]
            total -= z[lex.branch[level, target]] - np.log(np.exp(z).sum())
    return total


def test_each_id_is_scored_once_as_by_the_plain_sum():
    lex = lexicon()
    w = weights(lex)
    rng = np.random.default_rng(4)
    counts = np.array([0, 1, 31, 32, 33, 64, 65, 0, 200, 5])
    ids = rng.integers(0, 60, counts.sum())
    got = lm.scores(w, lm.Blocks(ids, counts), lex, len(counts))
    assert np.allclose(got, [slow_score(w, lex, t) for t in cut(ids, counts)], rtol=1e-4)


def test_each_id_of_a_deep_tree_is_scored_as_by_the_plain_sum():
    lex = lm.Lexicon((1e6 / np.arange(1, 3001) ** 1.5).astype(np.int64))
    assert len(lex.node) > 2
    w = weights(lex)
    rng = np.random.default_rng(4)
    counts = np.array([40, 7, 300])
    ids = rng.integers(0, 3000, counts.sum())
    got = lm.scores(w, lm.Blocks(ids, counts), lex, len(counts))
    assert np.allclose(got, [slow_score(w, lex, t) for t in cut(ids, counts)], rtol=1e-4)


def test_long_texts_are_scored_in_stretches_alike():
    lex = lexicon()
    w = weights(lex)
    ids = np.random.default_rng(2).integers(0, 60, 1000)
    whole = lm.scores(w, lm.Blocks(ids, np.array([1000])), lex, 1)[0]
    some, starts = lm._unpacked(batch([ids]), "<u2")
    parts = list(lm.pieces(some, starts, 3 * lm.STRIDE))
    assert len(parts) > 5 and all(rows.tolist() == [0] for rows, _ in parts)
    assert math.isclose(sum(lm.scores(w, blocks, lex, 1)[0] for _, blocks in parts), whole, rel_tol=1e-5)


def test_equal_texts_score_equally_wherever_they_stand():
    lex = lexicon(n=3000)
    w = weights(lex)
    rng = np.random.default_rng(3)
    same = rng.integers(0, 3000, 333)
    found = set()
    for seed in range(12):
        others = [rng.integers(0, 3000, n) for n in rng.integers(0, 400, 9)]
        texts = [*others[: seed % 9], same, *others[seed % 9 :], same]
        counts = np.array([len(t) for t in texts])
        got = lm.scores(w, lm.Blocks(np.concatenate(texts), counts), lex, len(counts))
        found |= {got[seed % 9], got[-1]}
    assert len(found) == 1


def test_gradients():
    for n in (60, 3000):  # a tree of two levels and one of more
        lex = lm.Lexicon((1e6 / np.arange(1, n + 1) ** 1.5).astype(np.int64))
        w = {k: v.astype(np.float64) for k, v in weights(lex).items()}
        w["c"] = np.maximum(w["c"], -20)
        rng = np.random.default_rng(0)
        counts = np.array([70, 5, 33])
        blocks = lm.Blocks(rng.integers(0, n, counts.sum()), counts, lead=np.array([True, False, False]))
        _, g = lm.gradients(w, blocks, lex)
        for k, (rows, _, slope) in g.items():
            whole = np.zeros_like(w[k])
            whole[rows] = slope
            for _ in range(12):
                i = tuple(rng.integers(0, s) for s in w[k].shape)
                if k in "EWc":
                    i = (rng.choice(rows), *i[1:])
                was, both = w[k][i], []
                for e in (1e-5, -1e-5):
                    w[k][i] = was + e
                    both.append(lm.gradients(w, blocks, lex)[0])
                w[k][i] = was
                assert abs((both[0] - both[1]) / 2e-5 - whole[i]) < 1e-6 + 1e-2 * abs(whole[i]), (n, k)


def test_nodes_below_the_root_are_multiplied_in_one_pass_and_get_what_each_item_gives(monkeypatch):
    """Nodes of one item, of a few and of many, on several levels; each item's part of the gradients is added by itself."""
    lex = lm.Lexicon((1e6 / np.arange(1, 3001) ** 1.5).astype(np.int64))
    w = weights(lex)
    rng = np.random.default_rng(6)
    ids = lex.node.shape[1] - 1 - (rng.pareto(0.7, 900) * 5).astype(np.int64) % 3000
    ids[::2] = ids[::2] % 40
    h = rng.standard_normal((928, lm.WIDTH)).astype(np.float32)
    at = np.sort(rng.permutation(928)[:900])
    passes, plain = [], lm._grouped
    monkeypatch.setattr(lm, "_grouped", lambda w, node, *rest: passes.append(len(node)) or plain(w, node, *rest))
    alone, _, _ = lm.choices(w, lex, h, at, ids)
    loss, dh, found = lm.choices(w, lex, h, at, ids, 1.0)
    assert passes == [int((lex.depth[ids] - 1).sum())] * 2
    back, by, items = np.zeros(h.shape), np.zeros((lex.nodes, lm.WIDTH + 1, lm.FAN)), np.zeros(lex.nodes, np.int64)
    lost = np.zeros(900)
    for i, (row, word) in enumerate(zip(at, ids)):
        for level in range(lex.depth[word]):
            node, branch = lex.node[level, word], lex.branch[level, word]
            z = h[row].astype(np.float64) @ w["W"][node] + w["c"][node]
            e = np.exp(z) / np.exp(z).sum()
            lost[i] -= np.log(e[branch])
            e[branch] -= 1
            back[row] += w["W"][node] @ e
            by[node] += np.append(h[row], 1)[:, None] * e
            items[node] += 1
    assert {1, 2} <= set(np.minimum(items[1:], 2)) and items[1:].max() > 2 * lm.TILE
    assert np.allclose(loss, lost, rtol=1e-4) and np.allclose(alone, lost, rtol=1e-4) and np.allclose(dh, back, atol=1e-4)
    nodes, often, got = (np.concatenate(part) for part in zip(*found))
    assert len(set(nodes)) == len(nodes) and np.array_equal(items[nodes], often) and items.sum() == often.sum()
    assert np.allclose(got, by[nodes], atol=1e-3)


def test_chances_of_all_ids_add_up_to_one_in_any_state():
    for n in (1, 2, 31, 32, 33, 500, 2000):
        lex = lm.Lexicon(np.random.default_rng(3).integers(0, 4, n))
        w = weights(lex)
        for seed in range(3):
            h = np.repeat(np.random.default_rng(seed).standard_normal((1, lm.WIDTH)).astype(np.float32), -(-n // lm.STRIDE) * lm.STRIDE, axis=0)
            loss, _, _ = lm.choices(w, lex, h, np.arange(n), np.arange(n))
            assert math.isclose(np.exp(-loss).sum(), 1, rel_tol=1e-4)


def test_begins_with_the_shares_of_ids():
    counts = np.random.default_rng(3).integers(1, 1000, 500)
    lex = lm.Lexicon(counts)
    loss, _, _ = lm.choices(lm.first_weights(lex), lex, np.zeros((512, lm.WIDTH), np.float32), np.arange(500), np.arange(500))
    assert np.allclose(np.exp(-loss), (counts + lm.SMOOTH) / (counts + lm.SMOOTH).sum(), rtol=1e-4)
    lm.Lexicon(np.zeros(30, np.int64))


def packed(spark, texts):
    return spark.createDataFrame([(k, np.array(t, "<u2").tobytes()) for k, t in enumerate(texts)], "doc_id long, ids binary")


def test_context_decides_between_ids_of_like_frequency(spark):
    """3,000 ids of like frequency, of which each text uses those of one topic; parameters as in production."""
    rng = np.random.default_rng(7)
    topics = rng.permutation(3000).reshape(20, 150)
    texts = [rng.choice(topics[k % 20], 300).tolist() for k in range(2000)]
    ids = packed(spark, texts).repartition(2).cache()
    lex = lm.Lexicon(lm.id_counts(ids, 50_000))
    rows = lm.score_ids(ids, lm.trained(ids, lex), lex).collect()
    share = np.bincount(np.concatenate(texts)) / (300 * len(texts))
    unigram = -np.log(share[np.concatenate(texts)]).mean()
    got = sum(r.nll for r in rows) / sum(r.n_tokens for r in rows)
    print("nats an id:", got, "unigram", unigram)
    assert got < unigram - 0.5


def test_training_as_a_whole_is_that_of_its_parts(spark):
    """Two tasks, two rounds: the weights by Spark are those of the same steps and means taken by hand."""
    rng = np.random.default_rng(9)
    ids = packed(spark, [rng.integers(0, 300, n) for n in rng.integers(1, 300, 60)]).repartition(2).cache()
    parts = [[np.frombuffer(r.ids, "<u2") for r in rows] for rows in ids.rdd.glom().collect()]
    lex = lm.Lexicon(lm.id_counts(ids, 300))
    got = lm.flat(lm.trained(ids, lex, rate=0.05))
    w = lm.flat(lm.first_weights(lex))
    for turn in range(lm.ROUNDS):
        total, often = np.zeros(w.shape), np.zeros(len(w))
        for texts in parts:
            at, n, rows = lm.train_on(iter([batch(texts)]), lm.unflat(w, lex), lex, turn, lm.ROUNDS, 0.05).rows()
            total[at] += rows * n[:, None]
            often[at] += n
        there = often > 0
        w = w.copy()
        w[there] = total[there] / often[there][:, None]
    assert np.allclose(got, w, atol=1e-5) and not np.allclose(w, lm.flat(lm.first_weights(lex)), atol=1e-2)


def test_every_window_is_trained_on_once(monkeypatch):
    lex = lexicon()
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 60, n) for n in (0, 5, 40, 97, 700, 3, 8)]
    monkeypatch.setattr(lm, "STEP_IDS", 128)
    taken, plain = [], lm.gradients

    def windows(blocks):
        both = np.concatenate([np.roll(blocks.inputs, 1, axis=0), blocks.inputs, blocks.targets], axis=1)
        both[blocks.first, : lm.STRIDE] = lm.PAD
        return [x.tobytes() for x, real in zip(both, (blocks.targets >= 0).any(axis=1)) if real]

    monkeypatch.setattr(lm, "gradients", lambda w, blocks, lex: taken.extend(windows(blocks)) or plain(w, blocks, lex))
    for turn in range(lm.ROUNDS):
        lm.train_on(iter([batch(texts)]), weights(lex), lex, turn, lm.ROUNDS, 0.01)
    assert sorted(windows(lm.Blocks(np.concatenate(texts), np.array([len(t) for t in texts])))) == sorted(taken)


def test_steps_are_filled_by_texts_that_would_leave_room(monkeypatch):
    lex, texts = lexicon(), [np.random.default_rng(k).integers(0, 60, 2500) for k in range(40)]
    sizes, plain = [], lm.gradients
    monkeypatch.setattr(lm, "gradients", lambda w, blocks, lex: sizes.append(int((blocks.targets >= 0).sum())) or plain(w, blocks, lex))
    lm.train_on(iter([batch(texts)]), weights(lex), lex, 0, 1, 0.01)
    assert sum(sizes) == 40 * 2500 and max(sizes) <= 1.5 * lm.STEP_IDS
    assert np.mean(sizes[-12:]) > 0.85 * lm.STEP_IDS


def test_learns_more_than_the_shares_of_ids(spark):
    docs = documents(spark, [(i, " ".join(["a cat sat", "the dog ran", "one bird sang"][(i + k) % 3] for k in range(40)), "en", "a") for i in range(150)])
    rows = lm.language_model_scores(docs, rounds=6, every=1).collect()
    coder = bpe.Coder(bpe.vocabulary(bpe.vocabulary_lines(bpe.VOCABULARY)))
    ids, _ = coder.encode([r.text for r in docs.collect()])
    share = np.bincount(ids) / len(ids)
    unigram = -np.log(share[ids]).mean()
    assert sum(r.nll for r in rows) / sum(r.n_tokens for r in rows) < 0.7 * unigram


def test_tasks_of_a_process_share_the_pretokens_they_met(spark, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    bpe.coder.cache_clear()
    lines, made = bpe.vocabulary_lines(bpe.VOCABULARY), []
    monkeypatch.setattr(lm, "map_texts", lambda df, text_col, fields, make, keep: made.append(make) or df)
    lm.encoded(documents(spark, []), "doc_id", "text", bpe.VOCABULARY)
    merged, plain = [], bpe.merge_words
    monkeypatch.setattr(bpe, "merge_words", lambda words, vocab: merged.extend(words) or plain(words, vocab))
    first, again = made[0](), made[0]()
    assert first(["some words"]) == again(["some words"]) and sorted(merged) == [b" words", b"some"]
    for k in range(9):  # more words than are remembered
        texts = [f"{k} {prose(k, 200)}", None, ""]
        (got,) = made[0]()(texts)
        ids, counts = bpe.Coder(bpe.vocabulary(lines)).encode([t or "" for t in texts])
        assert got.to_pylist() == [ids[: counts[0]].astype("<u2").tobytes(), None, b""]
    bpe.coder.cache_clear()


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("nll", F.lit("clash")).withColumn("token_ids", F.lit("clash"))
    rows = lm.language_model_scores(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    assert got[2].n_tokens is None and got[2].nll is None and got[2].mean_nll is None
    assert got[3].n_tokens == 0 and got[3].nll == 0 and got[3].mean_nll is None
    assert got[5].mean_nll > 0 and math.isclose(got[5].perplexity, math.exp(got[5].mean_nll))
    assert [r.nll for r in rows if r.doc_id == 1][0] == [r.nll for r in rows if r.doc_id == 1][1]
    assert lm.language_model_scores(empty(spark)).collect() == []
    assert prose(1, 1)
