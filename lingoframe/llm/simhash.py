"""SimHash near-duplicates by the recursion of May and Ozerov.

A document's fingerprint has 256 bits: signs of summed random signs of its longer words and pairs of neighbouring words.
Documents of one fingerprint are joined at once; the distinct fingerprints are searched for pairs within a Hamming
distance. A round takes a random strip of coordinates and a random shift, and keeps together the fingerprints whose partial
weight around a centre is at most one on that strip; the centres are the words of a perfect code, so that each fingerprint
passes exactly one filter of a strip. Filters over further strips are applied to what one filter kept, first by the keys
of one shuffle, then inside its lists, until a list is small and is compared by brute force. How deep the shuffled part
goes follows from the number of fingerprints, and how often all is repeated follows from the chance that a pair at the
distance limit, the hardest there is, passes every filter: the recall aimed at is the same at every size.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingoframe.llm.graph import connected_components
from lingoframe.llm.shared import NARROW_CHARS, map_texts, written
from lingoframe.llm.textgrid import Grid, mixed

BITS, STRIP = 256, 7
#: Greatest Hamming distance of near duplicates. Unrelated texts lie about 120 apart, with a deviation of 8.
DISTANCE = 52
RECALL = 0.95
#: Fingerprints a list of the shuffled part should have at most, on average, and those of a list that is compared as it is.
LIST, LEAF = 8192, 2048
#: Recursions inside a list; a list that is still large then is full of near duplicates.
DEEPEST = 3
#: Pairs of a list that are held before its groups are united.
HELD = 1 << 18
#: Pivots in a row with less than a 64th of a list around them, after which it has hardly a large group.
MISSES = 8
PARTS = ["f0", "f1", "f2", "f3"]
#: Bits of the filter of keys that deduplicated() sends to all tasks: 8 MB whatever the number of keys.
FILTER_BITS = 1 << 26


def _weights(n_docs: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Sums of +1 and -1 by bit: counts of each byte value first, then one small product for the eight bits of a byte."""
    sign = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32) * 2 - 1)
    out = np.empty((n_docs, BITS), np.float32)
    base = owner * 256
    for word in range(BITS // 64):
        h = mixed(feature + np.uint64((word + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        planes = h.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            at = word * 64 + k * 8
            out[:, at : at + 8] = np.bincount(base + planes[:, k], minlength=n_docs * 256).reshape(n_docs, 256).astype(np.float32) @ sign
    return out


def fingerprints_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(documents, 4) 64-bit words, and which texts have a word at all."""
    grid = Grid(texts)
    starts, ends, counts = grid.words()
    if not len(starts):
        return np.zeros((len(texts), BITS // 64), np.uint64), np.zeros(len(texts), bool)
    words = grid.hashes(starts, ends, fold=True)
    owner = np.repeat(np.arange(len(texts)), counts)
    long = (ends - starts >= 4) | (counts[owner] == 1)
    next_same = owner[1:] == owner[:-1]
    pairs = mixed(words[:-1] * np.uint64(3) + words[1:])[next_same]
    # Each feature counts once a text: else long texts would look alike by their commonest pairs.
    owners, features = np.concatenate([owner[long], owner[:-1][next_same]]), np.concatenate([words[long], pairs])
    order = np.argsort(mixed(features + owners.astype(np.uint64)))
    owners, features = owners[order], features[order]
    fresh = np.append(True, (features[1:] != features[:-1]) | (owners[1:] != owners[:-1]))
    summed = _weights(len(texts), owners[fresh], features[fresh])
    return np.packbits(summed > 0, axis=1, bitorder="little").view(np.uint64), counts > 0


def fingerprints(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add f0..f3, the four words of the fingerprint as bigint; null where a text is null or has no word."""

    def make():
        def apply(texts):
            made, real = fingerprints_of([t or "" for t in texts])
            made = made.view(np.int64)
            return [pa.array(np.ascontiguousarray(made[:, k]), mask=~real) for k in range(4)]

        return apply

    return map_texts(df, text_col, [(p, T.LongType(), pa.int64()) for p in PARTS], make, keep, NARROW_CHARS)


@lru_cache(maxsize=1)
def nearest_centre() -> np.ndarray:
    """For each value of a strip of seven bits, which of the 16 words of the Hamming code is at most one bit away."""
    code = [w for w in range(128) if not (_parity(w & 0b1010101) or _parity(w & 0b1100110) << 1 or _parity(w & 0b1111000) << 2)]
    table = np.empty(128, np.uint8)
    for v in range(128):
        table[v] = next(i for i, c in enumerate(code) if (v ^ c).bit_count() <= 1)
    return table


def _parity(x: int) -> int:
    return x.bit_count() & 1


def pass_chance(distance: int) -> float:
    """Chance that two fingerprints at this distance pass the same filter of a strip."""
    d, centre = distance / BITS, nearest_centre()
    same = [0.0] * (STRIP + 1)
    for e in range(128):
        same[e.bit_count()] += sum(centre[v] == centre[v ^ e] for v in range(128)) / 128
    return sum(n * d**k * (1 - d) ** (STRIP - k) for k, n in enumerate(same))


def repetitions(levels: int, distance: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - pass_chance(distance) ** levels))


def strip_filters(words: np.ndarray, levels: int, rng: np.random.Generator) -> np.ndarray:
    """Which filter each fingerprint passes, over `levels` random disjoint strips with random shifts, as one number."""
    bits = rng.permutation(BITS)[: levels * STRIP].reshape(levels, STRIP)
    key = np.zeros(len(words), np.int64)
    for strip in bits:
        value = np.zeros(len(words), np.uint64)
        for k, b in enumerate(strip):
            value |= ((words[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << np.uint64(k)
        key = key * 16 + nearest_centre()[value.astype(np.int64) ^ int(rng.integers(128))]
    return key


def brute_blocks(words: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j within the distance, by blocks of 256 of the first ones."""
    columns = [np.ascontiguousarray(words[:, k]) for k in range(4)]
    for a in range(0, len(words), 256):
        far = np.zeros((min(256, len(words) - a), len(words) - a), np.uint16)
        for c in columns:
            far += np.bitwise_count(c[a : a + 256, None] ^ c[None, a:])
        i, j = np.nonzero(far <= distance)
        some = j > i
        yield i[some] + a, j[some] + a


def _joined(found: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    left, right = zip(*found, (np.zeros(0, np.int64),) * 2)
    return np.concatenate(left), np.concatenate(right)


def brute_pairs(words: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j within the distance."""
    return _joined(brute_blocks(words, distance))


def _apart(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words ^ other).sum(axis=-1, dtype=np.uint16)


def _pivot(words: np.ndarray, rest: np.ndarray, pivot: int, distance: int) -> Generator[tuple[np.ndarray, np.ndarray], None, np.ndarray]:
    """Pairs that link what is around a pivot to it, and what lies beside it; returns who has yet to be compared.

    Those around a pivot are linked to it, and so to each other; what lies beyond twice the distance from it can't be within
    the distance of any of them; what lies between is compared with them until it is linked once."""
    far = _apart(words[rest], words[pivot])
    ball, near = rest[far <= distance], rest[(far > distance) & (far <= 2 * distance)]
    yield np.full(len(ball), pivot), ball
    for a in range(0, len(near), 4096):
        open_ = near[a : a + 4096]
        for member in np.array_split(ball, -(-len(ball) // 64)):
            i, j = np.nonzero(_apart(words[member][:, None], words[open_][None]) <= distance)
            linked, first = np.unique(j, return_index=True)
            yield member[i[first]], open_[linked]
            open_ = np.delete(open_, linked)
    return rest[far > distance]


def linking_blocks(words: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the distance, of any number of fingerprints, that link the same ones as all such pairs do. A list that is
    full of near duplicates takes a pass for each of its groups, not one for each of its members."""
    rest = np.arange(len(words))
    while len(rest):
        rest = yield from _pivot(words, rest, rest[0], distance)


def linking_pairs(words: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """What linking_blocks() gives, at once, without the pivots themselves."""
    left, right = _joined(linking_blocks(words, distance))
    return left[left != right], right[left != right]


def list_pairs(words: np.ndarray, distance: int, recall: float, rng: np.random.Generator, depth: int = 0, every: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a list, some at a time: brute force if it is small, else filters over one more strip, often enough, and their
    lists; pairs that pass several of them come again. Unless every pair is wanted, large groups of a large list are first
    linked by pivots and taken out, so that no filter has them again. A list that stays large is compared as a whole, or by
    pivots alone."""
    rest, misses = np.arange(len(words)), 0
    while not every and len(rest) > LEAF and misses < MISSES:
        before = len(rest)
        rest = yield from _pivot(words, rest, rng.choice(rest), distance)
        misses = 0 if before - len(rest) > before // 64 else misses + 1
    words = words[rest]
    if len(words) <= LEAF or depth == DEEPEST:
        for i, j in (brute_blocks if every or len(words) <= LEAF else linking_blocks)(words, distance):
            yield rest[i], rest[j]
        return
    for _ in range(repetitions(1, distance, 1 - (1 - recall) / 2)):
        key = strip_filters(words, 1, rng)
        order = np.argsort(key, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(some) > 1:
                for i, j in list_pairs(words[some], distance, recall, rng, depth + 1, every):
                    yield rest[some[i]], rest[some[j]]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[left], label[right])
        old = label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = label[label]
        if (label == old).all():
            return label


def linked(n: int, found: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each one's component, by pairs that come some at a time. What is linked already is let go, and
    HELD pairs and what one step brings are held at most: a list full of near duplicates has many millions of pairs."""
    label, left, right, held = np.arange(n), [], [], 0

    def merged() -> np.ndarray:
        return forest(n, np.concatenate([label, *left]), np.concatenate([np.arange(n), *right]))

    for i, j in found:
        i, j = label[i], label[j]
        new = i != j
        if not new.any():
            continue
        left.append(i[new])
        right.append(j[new])
        held += len(left[-1])
        if held > HELD:
            label, left, right, held = merged(), [], [], 0
    return merged()


def near_edges(fps: DataFrame, distance: int = DISTANCE, recall: float = RECALL, seed: int = 7, pairs: bool = False) -> DataFrame:
    """Edges (a, b) between the nodes of distinct fingerprints (node, f0..f3): all pairs found, repeated, or, by default, a
    forest for each list that links the same nodes."""
    total = fps.count()
    levels = 2
    while total / 16**levels > LIST:
        levels += 1
    rounds = repetitions(levels, distance, recall)
    node = fps.schema["node"].dataType
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("node", node), *[T.StructField(p, T.LongType()) for p in PARTS]])

    def keys(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(p)) for p in PARTS]
            words = np.stack([c.to_numpy() for c in columns], axis=1).view(np.uint64)
            nodes = batch.column(batch.schema.get_field_index("node"))
            for r in range(rounds):
                key = strip_filters(words, levels, np.random.default_rng([seed, r])) + r * 16**levels
                yield pa.RecordBatch.from_arrays([pa.array(key), nodes, *columns], names=schema.names)

    def search(key, table):
        words = np.stack([table.column(p).to_numpy() for p in PARTS], axis=1).view(np.uint64)
        rng = np.random.default_rng([seed, 1, key[0].as_py()])
        found = list_pairs(words, distance, recall, rng, every=pairs)
        if pairs:
            left, right = _joined(found)
        else:
            label = linked(len(words), found)
            left = np.flatnonzero(label != np.arange(len(words)))
            right = label[left]
        nodes = table.column("node")
        return pa.table({"a": nodes.take(pa.array(left)), "b": nodes.take(pa.array(right))})

    edge = T.StructType([T.StructField("a", node), T.StructField("b", node)])
    return fps.select("node", *PARTS).mapInArrow(keys, schema).groupBy("bucket").applyInArrow(search, edge)


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """Members of groups of near duplicates: doc_id, text_hash, group_id, group_hash, is_kept.

    A document is the pair of its id and its text's hash, so a null id and an id with several texts are defined; repeated
    rows are one document and appear once. group_id is the smallest such pair's id and stands for the document that
    stays (is_kept). Documents without near duplicates, null texts and texts without words don't appear; an empty table gives no
    rows; other columns are ignored. Groups are the connected components of the pairs found.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    marked = fingerprints(rows, "text", ["doc_id", "h"]).where("f0 is not null")
    marked = written(marked.select(F.struct("doc_id", "h").alias("node"), *PARTS), "fingerprints")
    distinct = written(marked.groupBy(*PARTS).agg(F.min("node").alias("node")), "distinct")
    same = marked.join(distinct.withColumnRenamed("node", "b"), PARTS).where("node <> b").select(F.col("node").alias("a"), "b")
    edges = near_edges(distinct, distance, recall).unionByName(same).distinct()
    roots = connected_components(written(edges, "near"), "a", "b")
    return roots.select(
        F.col("node.doc_id").alias("doc_id"),
        F.col("node.h").alias("text_hash"),
        F.col("root.doc_id").alias("group_id"),
        F.col("root.h").alias("group_hash"),
        (F.col("node") == F.col("root")).alias("is_kept"),
    )


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bits at the hashes of some keys, in words of 64; the driver gets a row a word at most."""
    rows = keys.select(F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).alias("at")).selectExpr("at div 64 AS word", "shiftleft(1L, cast(at % 64 AS int)) AS bit")
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """The rows of df, all columns, with one document of each group; of repeated rows of one document one stays.

    Rows whose text is null or has no word all stay. A filter of a fixed size, sent to all tasks, tells which rows may be
    concerned; the texts of those alone are shuffled, to be joined exactly to the (id, hash) pairs of what goes. The fuller
    the filter, the more rows take the join; the outcome is the same.
    """
    key = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"))
    groups = written(duplicate_groups(df, id_col, text_col, distance, recall), "groups")
    gone = written(groups.where(~F.col("is_kept")).select(F.struct("doc_id", F.col("text_hash").alias("h")).alias("lf_key")), "gone")
    again = df.where(F.regexp_like(text_col, F.lit(r"[\p{L}\p{N}]"))).select(key.alias("lf_key"))
    again = written(again.groupBy("lf_key").count().where("count > 1").select("lf_key"), "again")
    sent = df.sparkSession.sparkContext.broadcast(key_filter(gone.unionAll(again), "lf_key"))

    @F.arrow_udf(T.BooleanType())
    def concerned(at: pa.Array) -> pa.Array:
        at = at.to_numpy()
        return pa.array((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("lf_row"), key.alias("lf_key"))
    keyed = keyed.withColumn("lf_maybe", concerned(F.pmod(F.xxhash64("lf_key"), F.lit(FILTER_BITS))))
    stay = keyed.where("lf_maybe").join(gone.hint("merge"), "lf_key", "left_anti")
    if not again.isEmpty():
        single, many = stay.join(again.hint("merge"), "lf_key", "left_anti"), stay.join(again.hint("merge"), "lf_key", "left_semi")
        stay = single.unionByName(many.dropDuplicates(["lf_key"]))
    return keyed.where("not lf_maybe").unionByName(stay).select("lf_row.*")
