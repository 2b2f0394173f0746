import base64
import uuid
from pathlib import Path

import numpy as np
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from helpers import awkward, documents, empty, prose
from lingoframe.llm import bpe, queries, tokenstore

VOCAB = bpe.vocabulary(bpe.vocabulary_lines(bpe.VOCABULARY))


def ids_of(text):
    return bpe.Coder(VOCAB).encode([text])[0].tolist()


def shop(spark, n=300):
    return documents(spark, [(i, prose(i, 15 + i % 40), "en", "a") for i in range(n)])


def test_round_trip_through_files(spark, tmp_path):
    docs = shop(spark).unionByName(awkward(spark).where("doc_id > 1 or doc_id is null").withColumn("doc_id", F.col("doc_id") + 1000))
    docs = docs.withColumn("frame", F.lit("clash")).withColumn("shard", F.lit("clash"))
    dictionary = tokenstore.train_dictionary(docs)
    assert dictionary
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    frames = tokenstore.packed(docs, dictionary)
    tokenstore.write_store(frames, dictionary, path)
    back = {}
    for r in tokenstore.read_store(spark, path).collect():
        back.setdefault(r.doc_id, []).append(r.token_ids)
    for r in docs.collect():
        assert (None if r.text is None else ids_of(r.text)) in back[r.doc_id]
    assert sum(map(len, back.values())) == docs.count()
    some = {r.doc_id: r.token_ids for r in tokenstore.read_store(spark, path, [3, 77]).collect()}
    assert some == {3: ids_of(prose(3, 18)), 77: ids_of(prose(77, 52))}


def test_offsets_dictionary_and_gain(spark):
    docs = shop(spark)
    dictionary = tokenstore.train_dictionary(docs)
    rows = tokenstore.packed(docs, dictionary).collect()
    plain = tokenstore.packed(docs, b"").collect()
    known = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    by = {}
    for r in rows:
        assert r.dictionary == tokenstore.dictionary_hash(dictionary) and r.length == len(r.frame)
        assert len(np.frombuffer(known.decompress(r.frame), "<u2")) == r.n_tokens
        by.setdefault(r.shard, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert sum(r.length for r in rows) < 0.8 * sum(r.length for r in plain)


def test_store_against_a_coder_of_others(spark, tmp_path):
    """Every document of the query's index, decoded by zstandard and the public coder from the files alone."""
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in bpe.vocabulary_lines(bpe.VOCABULARY).splitlines() if x)}
    other = tiktoken.Encoding("other", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    docs = shop(spark, 200).unionByName(documents(spark, [(900, "", "en", "a"), (901, "é中😀 \n\n x's 12", "fr", None), (902, prose(8, 9000), "en", "a")]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    index = queries.op7_token_store(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in index) == sorted(texts)
    spans = {}
    for r in index:
        folder = Path(r.path.removeprefix("file://"))
        spans.setdefault(r.file, []).append((r.offset, r.length))
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict((folder / f"{r.dictionary}.dict").read_bytes()))
        ids = np.frombuffer(reader.decompress((folder / r.file).read_bytes()[r.offset : r.offset + r.length]), "<u2").tolist()
        assert ids == other.encode_ordinary(texts[r.doc_id]) and len(ids) == r.n_tokens
    for file, parts in spans.items():  # frames lie one behind the other and fill their file
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(parts[-1]) == (folder / file).stat().st_size


def test_query_leaves_a_store_that_reads_back(spark, tmp_path):
    docs = shop(spark).unionByName(awkward(spark).where("doc_id > 1 or doc_id is null").withColumn("doc_id", F.col("doc_id") + 1000))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    index = queries.op7_token_store(spark, str(tmp_path)).collect()
    assert len(index) == docs.count() and len({r.path for r in index}) == 1
    folder = Path(index[0].path.removeprefix("file://"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(None if r.text is None else ids_of(r.text))
    for r in index:  # from the files alone
        if r.n_tokens is None:
            assert r.length == 0 and None in texts[r.doc_id]
            continue
        dictionary = (folder / f"{r.dictionary}.dict").read_bytes()
        assert dictionary and tokenstore.dictionary_hash(dictionary) == r.dictionary
        frame = (folder / r.file).read_bytes()[r.offset : r.offset + r.length]
        ids = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress(frame)
        assert np.frombuffer(ids, "<u2").tolist() in texts[r.doc_id]
    assert tokenstore.read_store(spark, index[0].path).count() == len(index)
    empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op7_token_store(spark, f"{tmp_path}/none").collect() == []


def test_folders_of_a_store():
    assert {tokenstore._folder(p)[1] for p in ("/a/b", "file:/a/b", "file:///a/b")} == {"/a/b"}
    with pytest.raises((ValueError, OSError)):
        tokenstore._folder("nowhere://host/a")


def test_sample_of_long_and_of_repeated_texts(spark):
    long = documents(spark, [(i, prose(i, 12_000), "en", "a") for i in range(20)])
    assert long.where("octet_length(text) > 65536").count() == 20
    assert tokenstore.train_dictionary(long)
    same = documents(spark, [(i, prose(i if i < 40 else 0, 60), "en", "a") for i in range(4000)])
    dictionary = tokenstore.train_dictionary(same, sample=40)
    assert dictionary and dictionary == tokenstore.train_dictionary(same.repartition(7), sample=40)


def test_too_little_to_train_on(spark):
    assert tokenstore.train_dictionary(empty(spark)) == b"" and tokenstore.train_dictionary(awkward(spark)) == b""
    assert tokenstore.packed(empty(spark), b"").collect() == []
    got = {r.doc_id: r for r in tokenstore.packed(awkward(spark), b"").collect()}
    assert got[2].frame is None and got[2].length == 0 and got[2].n_tokens is None and got[3].n_tokens == 0 and got[3].frame
