import random
import string

import zstandard
from pyspark.sql import functions as F

from helpers import awkward, documents, empty, prose
from lingoframe.llm import compression


def test_repetition_and_noise_go_and_prose_stays(spark):
    rnd = random.Random(1)
    noise = "".join(rnd.choice(string.ascii_letters + string.digits + "+/") for _ in range(12000))
    wide = [f"{a}{b}" for a in "river stone garden winter quiet morning letter window".split() for b in ("s", "ly", "ed", "er", "ing", "ful", "ish", "ward", "less", "en")]
    mixed_up = prose(9, 900, wide) + noise
    rows = [(1, prose(1, 400, wide), "en", "a"), (2, "buy now " * 300, "en", "a"), (3, noise[:3000], "en", "a"), (4, "short one", "en", "a"), (5, prose(2, 5000, wide) + "the same line again\n" * 2000, "en", "a"), (6, mixed_up, "en", "a")]
    got = {r.doc_id: r for r in compression.compression_bands(documents(spark, rows)).collect()}
    assert [got[i].keep for i in range(1, 7)] == [True, False, False, True, False, False]
    assert got[2].reason == "repetitive" and got[3].reason == "incompressible"


def test_as_by_plain_compression(spark):
    df = awkward(spark).withColumn("ratio", F.lit("clash"))
    z = zstandard.ZstdCompressor(level=3)
    rows = compression.compression_bands(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        if not r.text:
            assert not r.keep and r.reason == "empty" and r.ratio is None and r.n_bytes == 0
            continue
        data = r.text.encode()
        assert r.ratio == len(z.compress(data)) / len(data)
        band = compression.limits(len(data))
        chunks = [len(z.compress(data[i : i + 4096])) / 4096 for i in range(0, len(data) - 4095, 4096)] if len(data) >= 8192 else []
        bad = sum(not 0.20 <= c <= 0.72 for c in chunks)
        assert (r.chunks, r.bad_chunks) == (len(chunks), bad)
        assert r.keep == ((not band or band[0] <= r.ratio <= band[1]) and bad <= 0.25 * len(chunks))


def test_ends_and_single_chunks_are_judged():
    rnd = random.Random(3)
    noise = "".join(rnd.choice(string.ascii_letters + string.digits + "+/") for _ in range(5000))
    wide = [f"{a}{b}" for a in "river stone garden winter quiet morning letter window".split() for b in ("s", "ly", "ed", "er", "ing", "ful", "ish", "ward", "less", "en")]
    text = prose(4, 4000, wide)
    z = zstandard.ZstdCompressor(level=3)
    why = lambda t: compression.judged(t, z)[4]
    assert why(text[:8192] + noise[:4095]) == "incompressible chunks"
    assert why(text[:3000] + noise[:4096]) == "incompressible chunks"
    assert [why(text[:n]) for n in (4095, 4096, 4097, 6000, 8191, 8192, 12287, 20000)] == [""] * 8


def test_empty_table(spark):
    assert compression.compression_bands(empty(spark)).collect() == []
