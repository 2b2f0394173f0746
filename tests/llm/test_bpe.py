import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import awkward, empty
from lingoframe.llm import bpe

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCAB = bpe.vocabulary(bpe.vocabulary_lines(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=VOCAB.ranks, special_tokens={})


def same(texts, known):
    ids, counts = bpe.Coder(VOCAB).encode(texts)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == known.encode_ordinary(text), text[:80]
        at += n
    assert bpe.decode_flat(ids, counts, VOCAB) == [t.encode() for t in texts]


@given(st.lists(st.text(alphabet="abcstremdlv'  \n\t .,!19é中😀ſ 　", max_size=40), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text_is_encoded_as_by_the_public_coder(texts):
    same(texts, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=VOCAB.ranks, special_tokens={}))


def test_contractions_blanks_and_long_words(known):
    rnd = random.Random(1)
    noise = ["".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (255, 256, 257, 3000)]
    same(["'re", "ab'ss's" * 200, " 's", "x 's'll''d", "a" * 5000, "", "  ", "\n\n x", "tail  ", "we'RE they've", *noise], known)


def test_whole_table(spark, known):
    df = awkward(spark).withColumn("token_ids", F.lit("clash")).withColumn("Odd.Name", F.lit(1))
    out = bpe.encode(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "Odd.Name", "token_ids", "n_tokens", "decoded_same"]
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        if r.text is None:
            assert r.token_ids is None and r.n_tokens is None and r.decoded_same is None
        else:
            assert r.token_ids == known.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) and r.decoded_same
    back = bpe.decode(out.select("doc_id", "token_ids", F.col("text").alias("was")))
    assert back.where("not (text <=> was)").count() == 0


def test_empty_table(spark):
    assert bpe.encode(empty(spark)).collect() == []


def test_foreign_ids_are_refused(spark):
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([60000],)], "token_ids array<int>")).collect()


def test_decoding_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, [31373], "x"), (2, None, "y"), (3, [], None), (1, [31373], "x")], "doc_id int, `the.ids` array<int>, `Odd.Name` string")
    out = bpe.decode(df, "the.ids", "doc_id")
    assert out.columns == ["the.ids", "Odd.Name", "doc_id"]
    assert sorted((r["Odd.Name"] or "", r.doc_id) for r in out.collect()) == [("", ""), ("x", "hello"), ("x", "hello"), ("y", None)]
    assert bpe.decode(df.limit(0), "the.ids").collect() == []
