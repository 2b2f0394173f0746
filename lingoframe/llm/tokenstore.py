"""Token ids as compressed binary documents with a shared dictionary.

The ids of a document are written as little-endian integers (16 bits if the vocabulary allows) and compressed by
zstandard on their own, so that a short document is read without its neighbours; a dictionary trained on serialized id
arrays of a bounded sample gives short documents the context they lack. A store has files of frames, an index of
(file, offset, length) by document, and the dictionary, whose hash every index row names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingoframe.llm import bpe
from lingoframe.llm.shared import map_texts, shared_folder

LEVEL = 3
#: Distinct documents (about) that the dictionary is trained on, the bytes from which a passage stands for a text, and the dictionary's bytes.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 1 << 16, 1 << 16


def id_type(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def train_dictionary(docs: DataFrame, text_col: str = "text", vocabulary_path: str = bpe.VOCABULARY, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary for the id arrays of these texts, or b'' if there is too little to train on.

    The sample is spread over all distinct texts by their hashes, with an expected size that does not grow with the table;
    of a text over SAMPLE_BYTES it has a passage from a place that its hash chooses. Ids play no part; null and empty texts
    are left out, of repeated ones there is one; other columns are ignored; an empty table gives b''.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    total = texts.select("h").distinct().count()
    if not total:
        return b""
    below = int(min(1.0, sample / total) * (1 << 30))
    room = F.greatest(F.char_length("text") - SAMPLE_BYTES // 4, F.lit(0)) + 1  # so many code points have no more bytes than that
    passage = F.substring("text", (F.pmod(F.xxhash64("h"), room) + 1).cast("int"), F.lit(SAMPLE_BYTES // 4))
    some = texts.where(F.pmod("h", F.lit(1 << 30)) < below).select("h", F.when(F.octet_length("text") > SAMPLE_BYTES, passage).otherwise(F.col("text")).alias("text"))
    some = some.dropDuplicates(["h"]).orderBy("h").limit(2 * sample).select("text")  # a bound against hashes that fall unluckily
    ids = bpe.encode(some, keep=[], vocabulary_path=vocabulary_path, check=False).select("token_ids").collect()
    size_of = len(bpe.vocabulary(bpe.vocabulary_lines(vocabulary_path)).tokens)
    parts = sorted(np.array(r.token_ids, id_type(size_of)).tobytes() for r in ids if r.token_ids)
    size = min(size, sum(map(len, parts)) // 8)
    if len(parts) < 16 or size < 512:
        return b""
    return zstandard.train_dictionary(size, parts, k=256, d=8, f=20, accel=4, level=LEVEL).as_bytes()


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def packed(docs: DataFrame, dictionary: bytes, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, shard, offset, length, n_tokens, dictionary (its hash) and frame for every row.

    A shard is what one task reads, offset the place of the frame in its file. A null text has a null frame of length 0
    and null n_tokens; an empty one a frame of no ids. Repeated rows are stored again; a null id is stored but can't be
    looked up; texts of any length are one frame; an empty table gives no rows; other columns are ignored.
    """
    lines = docs.sparkSession.sparkContext.broadcast(bpe.vocabulary_lines(vocabulary_path))
    name = dictionary_hash(dictionary)

    def make():
        vocab = bpe.vocabulary(lines.value)
        coder, kind = bpe.Coder(vocab), id_type(len(vocab.tokens))
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        compressor = zstandard.ZstdCompressor(level=LEVEL, **known)
        at = [0]

        def apply(texts):
            ids, counts = coder.encode([t or "" for t in texts])
            ids = ids.astype(kind)
            upto = np.append(0, np.cumsum(counts)).tolist()
            null = np.array([t is None for t in texts], bool)
            frames = [None if t is None else compressor.compress(ids[a:b].tobytes()) for t, a, b in zip(texts, upto, upto[1:])]
            lengths = np.array([len(f or b"") for f in frames], np.int64)
            offsets = at[0] + np.cumsum(lengths) - lengths
            at[0] += int(lengths.sum())
            shard = TaskContext.get().partitionId()
            return [np.full(len(texts), shard, np.int32), offsets, lengths, pa.array(counts.astype(np.int32), mask=null), [name] * len(texts), frames]

        return apply

    fields = [("shard", T.IntegerType(), pa.int32()), ("offset", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("n_tokens", T.IntegerType(), pa.int32()), ("dictionary", T.StringType(), pa.string()), ("frame", T.BinaryType(), pa.binary())]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(source, "text", fields, make, ["doc_id"])


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors see (file, hdfs, s3, gs, ...) and the folder's name there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _bytes(path: str, name: str) -> bytes:
    system, folder = _folder(path)
    with system.open_input_file(f"{folder}/{name}") as f:
        return f.read()


def write_store(frames: DataFrame, dictionary: bytes, path: str) -> None:
    """Files of frames and an index in a folder that all executors see. A task writes a file of a name of its own, and
    only the index rows of tasks that were committed count, so that repeated or lost tasks do no harm. frames: packed(). Null
    and repeated ids have their rows in the index; a null text has length 0; no rows make an index without rows."""
    system, folder = _folder(path)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/{dictionary_hash(dictionary)}.dict") as out:
        out.write(dictionary)
    schema = T.StructType([frames.schema["doc_id"], T.StructField("file", T.StringType()), *[frames.schema[c] for c in ("offset", "length", "n_tokens", "dictionary")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = f"{uuid.uuid4().hex}.frames", 0
        system, folder = _folder(path)
        with system.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                parts = [f or b"" for f in batch.column("frame").to_pylist()]
                out.write(b"".join(parts))
                lengths = np.array([len(p) for p in parts], np.int64)
                offsets = at + np.cumsum(lengths) - lengths
                at += int(lengths.sum())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([name] * len(parts)), pa.array(offsets), pa.array(lengths), batch.column("n_tokens"), batch.column("dictionary")], names=schema.names)

    frames.select("doc_id", "n_tokens", "dictionary", "frame").mapInArrow(run, schema).write.parquet(f"{path}/index")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = bpe.VOCABULARY) -> DataFrame:
    """Write a store of all rows under the shared folder and return its index: doc_id, file, offset, length, n_tokens,
    dictionary and path (the store's folder, which read_store takes). Nulls, empty texts and repeated rows are as packed()
    says; an empty table makes a store without rows."""
    dictionary = train_dictionary(docs, text_col, vocabulary_path)
    path = f"{shared_folder(docs.sparkSession)}/lingoframe-store-{uuid.uuid4().hex}"
    write_store(packed(docs, dictionary, id_col, text_col, vocabulary_path), dictionary, path)
    return docs.sparkSession.read.parquet(f"{path}/index").withColumn("path", F.lit(path))


def read_store(spark: SparkSession, path: str, ids: list[int] | None = None, vocabulary_size: int = 1 << 16) -> DataFrame:
    """doc_id and token_ids (null where the text was) of the documents of a store, or of some, reading only their frames.
    An id that stands more than once gives each of its documents; a null id only comes when all are read; a store without
    rows gives none."""
    kind = id_type(vocabulary_size)
    index = spark.read.parquet(f"{path}/index")
    if ids is not None:
        index = index.where(F.col("doc_id").isin(list(ids)))
    schema = T.StructType([index.schema["doc_id"], T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_files, decompressors = {}, {}
        system, folder = _folder(path)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["n_tokens"] is None:
                    out.append(None)
                    continue
                if (name := row["dictionary"]) not in decompressors:
                    dictionary = _bytes(path, f"{name}.dict")
                    decompressors[name] = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
                if row["file"] not in open_files:
                    open_files[row["file"]] = system.open_input_file(f"{folder}/{row['file']}")
                f = open_files[row["file"]]
                f.seek(row["offset"])
                out.append(np.frombuffer(decompressors[name].decompress(f.read(row["length"])), kind).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=schema.names)
        for f in open_files.values():
            f.close()

    return index.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, schema)
