"""Byte-level BPE encoding and decoding in numpy.

Pre-tokens are cut by flag arithmetic over whole slabs of code points. Distinct pre-tokens that a task has not met
yet are grouped by length into padded matrices; in each round every row looks all its adjacent pairs up in a hash
table and merges its leftmost pair of minimum rank, then rows without a pair leave and the matrix is compacted.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingoframe.llm.shared import map_texts
from lingoframe.llm.textgrid import END, LETTER, OTHER, SPACE, Grid, mixed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longest pre-token, in bytes, that goes through matrices: their cost is quadratic in it, so longer ones use a heap.
MATRIX_BYTES = 256
#: Distinct pre-tokens a task remembers before it starts afresh.
REMEMBERED = 1 << 20
_NONE = np.uint32(0xFFFFFFFF)


class HashTable:
    """Open addressing from non-zero 64-bit keys to 32-bit values, probed by whole arrays."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, 0xFFFFFFFF where a key is missing."""
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], _NONE)
        left = np.flatnonzero((held != keys) & (held != 0))
        mask = (1 << self.bits) - 1
        at = at[left]
        while len(left):
            at = (at + 1) & mask
            held, wanted = self.keys[at], keys[left]
            hit = held == wanted
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (held != 0)
            left, at = left[more], at[more]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert distinct keys that are not there yet."""
        while (self.count + len(keys)) * 2 > len(self.keys):
            full = self.keys != 0
            old = self.keys[full], self.values[full]
            self.__init__(self.bits + 1)
            self.add(*old)
        at, mask, values = self._home(keys), (1 << self.bits) - 1, values.astype(np.uint32)
        self.count += len(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            spot, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[spot], self.values[spot] = keys[won], values[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & mask


class Vocabulary:
    """Ranks of a byte-level vocabulary, with every pair of tokens whose bytes together are a token."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.uint32)
        self.pair: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pair[((a + 1) << 32) | b] = rank
        self.pairs = HashTable(4)
        self.pairs.add(np.fromiter(self.pair.keys(), np.uint64, len(self.pair)), np.fromiter(self.pair.values(), np.uint32, len(self.pair)))
        self.length = np.fromiter(map(len, self.tokens), np.int64, size)
        self.offset = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)


@lru_cache(maxsize=2)
def vocabulary(lines: bytes) -> Vocabulary:
    return Vocabulary(lines)


def pretoken_starts(grid: Grid) -> np.ndarray:
    """Where the pre-tokens begin (with the marks after texts): contractions, then letters, numbers or other characters
    with at most one blank before them, then white space without the last character before a non-space."""
    cp, kind = grid.cp, grid.kind
    run = np.empty(len(kind), bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    start = run.copy()
    after = np.flatnonzero(run[1:] & (kind[:-1] == SPACE) & (kind[1:] != END)) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == 32]] = False
    quote = np.flatnonzero((cp[:-1] == 39) & run[:-1] & run[1:] & start[:-1] & (kind[1:] == LETTER))
    if len(quote):
        one = cp[quote + 1]
        two = cp[np.minimum(quote + 2, len(cp) - 1)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for found, k in ((quote[single], 1), (quote[double & ~single], 2)):
            start[found + 1] = False
            rest = found + 1 + k
            start[rest[kind[rest] == LETTER]] = True
    return np.flatnonzero(start)


def merge_long(word: bytes, vocab: Vocabulary) -> list[int]:
    """The same merges for one long pre-token, by a heap of (rank, place) over a linked list."""
    ids = [int(vocab.bytes[b]) for b in word]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap = [(vocab.pair[k], i) for i in range(len(ids) - 1) if (k := ((ids[i] + 1) << 32) | ids[i + 1]) in vocab.pair]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if ids[i] >= 0 else len(ids)
        if j >= len(ids) or vocab.pair.get(((ids[i] + 1) << 32) | ids[j]) != rank:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(ids) and (r := vocab.pair.get(((ids[a] + 1) << 32) | ids[b])) is not None:
                heapq.heappush(heap, (r, a))
    return [x for x in ids if x >= 0]


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.zeros(len(words), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    bucket = np.where(lengths <= MATRIX_BYTES, np.ceil(np.log2(np.maximum(lengths, 1)) * 2).astype(int), 99)
    for size in np.unique(bucket):
        rows = np.flatnonzero(bucket == size)
        if size == 99:
            for r in rows:
                ids = np.array(merge_long(words[r], vocab), np.uint32)
                counts[r] = len(ids)
                parts.append((np.full(len(ids), r), ids))
            continue
        for some in np.array_split(rows, max(1, len(rows) * int(lengths[rows].max(initial=1)) >> 20)):
            width = int(lengths[some].max(initial=1))
            flat = np.frombuffer(b"".join(words[r] for r in some), np.uint8)
            grid = np.full((len(some), width), -1, np.int64)
            grid[np.arange(width) < lengths[some][:, None]] = vocab.bytes[flat]
            live, size_of = some, lengths[some].copy()
            while len(live):
                key = ((grid[:, :-1] + 1) << 32) | grid[:, 1:]
                rank = np.full(key.shape, _NONE, np.uint32)
                there = grid[:, 1:] >= 0
                rank[there] = vocab.pairs.find(key[there].astype(np.uint64))
                best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(live), np.int64)
                least = rank[np.arange(len(live)), best] if rank.shape[1] else np.full(len(live), _NONE)
                done = least == _NONE
                if done.any():
                    counts[live[done]] = size_of[done]
                    flags = np.arange(grid.shape[1]) < size_of[done][:, None]
                    parts.append((np.repeat(live[done], size_of[done]), grid[done][flags].astype(np.uint32)))
                    on = ~done
                    live, size_of, grid, best, least = live[on], size_of[on], grid[on], best[on], least[on]
                    if not len(live):
                        break
                grid[np.arange(len(live)), best] = least
                place = np.arange(grid.shape[1] - 1)
                grid = np.take_along_axis(grid, place + (place > best[:, None]), axis=1)
                size_of -= 1
                grid = grid[:, : size_of.max()]
    if not parts:
        return np.zeros(0, np.uint32), counts
    owner = np.concatenate([a for a, _ in parts])
    ids = np.concatenate([b for _, b in parts])
    return ids[np.argsort(owner, kind="stable")], counts


def spread(offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices offset[i] .. offset[i]+length[i]-1 of all i, one after the other."""
    done = np.cumsum(length)
    return np.repeat(offset - (done - length), length) + np.arange(done[-1] if len(done) else 0)


class Coder:
    """Encodes lists of texts, and remembers the pre-tokens it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.seen, self.known = HashTable(16), 0
        self.offset, self.length, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _remember(self, keys: np.ndarray, words: list[bytes]) -> None:
        ids, counts = merge_words(words, self.vocab)
        for name, need in (("offset", self.known + len(keys)), ("length", self.known + len(keys)), ("ids", self.used + len(ids))):
            if len(old := getattr(self, name)) < need:
                grown = np.zeros(max(need, 2 * len(old)), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        span = slice(self.known, self.known + len(keys))
        self.offset[span], self.length[span] = self.used + np.cumsum(counts) - counts, counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.seen.add(keys, np.arange(self.known, self.known + len(keys)))
        self.known, self.used = self.known + len(keys), self.used + len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.known > REMEMBERED:
            self.clear()
        grid = Grid(texts)
        starts = pretoken_starts(grid)
        ends = np.append(starts[1:], len(grid.cp))
        real = grid.kind[starts] != END
        starts, ends = starts[real], ends[real]
        keys = grid.hashes(starts, ends)
        keys[keys == 0] = 1
        at = self.seen.find(keys)
        missing = np.flatnonzero(at == _NONE)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            text = grid.text
            self._remember(new, [text[a:b].encode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            at[missing] = self.seen.find(keys[missing])
        length = self.length[at]
        ids = self.ids[spread(self.offset[at], length)]
        total = np.append(0, np.cumsum(length))
        upto = total[np.searchsorted(starts, grid.ends)]
        return ids, np.diff(upto, prepend=0)


@lru_cache(maxsize=1)
def coder(lines: bytes) -> Coder:
    """One for all tasks of a process, which so share the pre-tokens they met, as many as any Coder remembers."""
    return Coder(vocabulary(lines))


def decode_flat(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """The bytes of each text, from the ids of all and how many each has."""
    length = vocab.length[ids]
    data = vocab.flat[spread(vocab.offset[ids], length)].tobytes()
    total = np.append(0, np.cumsum(length))
    upto = total[np.append(0, np.cumsum(counts))].tolist()
    return [data[a:b] for a, b in zip(upto, upto[1:])]


def vocabulary_lines(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def id_lists(ids: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.Array:
    """An Arrow list column; rows where null is set are null."""
    offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)), mask=pa.array(null))


def encode(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, vocabulary_path: str = VOCABULARY, check: bool = True) -> DataFrame:
    """Add token_ids (array<int>), n_tokens, and, unless check is off, decoded_same: whether decoding gives the text back.

    A null text has null token_ids, n_tokens and decoded_same; an empty one has no tokens. Texts of any length are encoded
    whole; repeated rows and null ids stay as they are; other columns pass, and those named as the new ones are replaced.
    The vocabulary file is read on the driver only and sent with the tasks: its size does not grow with the data.
    """
    lines = df.sparkSession.sparkContext.broadcast(vocabulary_lines(vocabulary_path))

    def make():
        vocab = vocabulary(lines.value)
        coder = Coder(vocab)

        def apply(texts: list[str | None]) -> list:
            null = np.array([t is None for t in texts], bool)
            whole = [t or "" for t in texts]
            ids, counts = coder.encode(whole)
            out = [id_lists(ids, counts, null), pa.array(counts.astype(np.int32), mask=null)]
            if check:
                same = np.array([a == b.encode("utf-8", "replace") for a, b in zip(decode_flat(ids, counts, vocab), whole)], bool)
                out.append(pa.array(same, mask=null))
            return out

        return apply

    fields = [("token_ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("n_tokens", T.IntegerType(), pa.int32())]
    if check:
        fields.append(("decoded_same", T.BooleanType(), pa.bool_()))
    return map_texts(df, text_col, fields, make, keep)


def decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "text", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """Add the text that token ids stand for. Null ids give null, none an empty text; bytes that are no UTF-8 become U+FFFD.
    Other columns, of any names, pass, and one named as the new one is replaced; repeated rows are decoded alike; an empty
    table gives an empty table.

    An id that the vocabulary doesn't have, or a null among the ids, raises an error: it can't have come from encode().
    """
    lines = df.sparkSession.sparkContext.broadcast(vocabulary_lines(vocabulary_path))
    stay = [f for f in df.schema.fields if f.name.lower() != out_col.lower()]
    names = [f.name for f in stay]
    schema = T.StructType([*stay, T.StructField(out_col, T.StringType())])

    # The Arrow functions take no names with dots, so columns go by number.
    source = df.select(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate([*names, ids_col])])

    def run(batches):
        vocab = vocabulary(lines.value)
        for batch in batches:
            column = batch.column(len(names))
            for at in range(0, len(column), 256):
                some = column.slice(at, 256)
                counts = some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = some.flatten()
                if flat.null_count or (len(flat) and not 0 <= flat.to_numpy().min() <= flat.to_numpy().max() < len(vocab.tokens)):
                    raise ValueError("token ids outside the vocabulary")
                texts = decode_flat(flat.to_numpy().astype(np.int64), counts, vocab)
                made = pa.array([None if null else t.decode("utf-8", "replace") for t, null in zip(texts, some.is_null().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(at, 256) for k in range(len(names))] + [made], names=[*names, out_col])

    return source.mapInArrow(run, schema)
