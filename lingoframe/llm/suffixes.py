"""Benchmark decontamination by suffix arrays of the training texts.

Each task cuts its documents into words (runs of letters and numbers, case folded), joins them into shards of about a
million words, and sorts all suffixes of a shard by prefix doubling, to the depth of the longest test text. Every suffix
of every test text is then searched by bisection; the suffixes of the shard that share its first words lie side by side
there, and each is followed to the end of its match. A document whose longest match with a test text reaches the limit
is reported, with where the match lies, or removed. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lingoframe.llm.shared import NARROW_CHARS, slabs
from lingoframe.llm.textgrid import Grid

#: Words of a verbatim match that make a document contaminated; a shorter test text must be there as a whole.
LEAST_WORDS = 13
#: Words a shard has when it is closed. Longer documents are cut into overlapping pieces.
SHARD_WORDS = 1 << 20
#: Bytes of test texts sent with the tasks of one pass; beyond them there are more passes.
PASS_BYTES = 32 << 20

class Tests:
    """The test texts of a pass as flat arrays of word hashes."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        grid = Grid([t for _, t in items])
        starts, ends, counts = grid.words()
        self.words = grid.hashes(starts, ends, fold=True)
        self.item = np.repeat(np.arange(len(items)), counts)
        self.ids = [i for i, _ in items]
        self.first = np.cumsum(counts) - counts
        self.left = np.repeat(self.first + counts, counts) - np.arange(len(self.words))
        self.need = np.minimum(least, counts)[self.item] if len(items) else np.zeros(0, np.int64)
        self.starts = np.flatnonzero(self.left >= self.need) if len(items) else np.zeros(0, np.int64)
        self.longest = int(counts.max(initial=0))


def suffix_array(rank: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of an array of small numbers, sorted by their first `depth` ones (at least three), and the sorted keys of the first three."""
    n = len(rank)
    base = np.uint64(int(rank.max(initial=0)) + 2)
    padded = np.zeros(n + 2, np.uint64)
    np.add(rank, 1, out=padded[:n], casting="unsafe")
    key = padded[:n] * base
    key += padded[1 : n + 1]
    key *= base
    key += padded[2:]
    del padded
    order = np.argsort(key)
    sorted_key = key[order]
    del key
    head = np.empty(n, bool)
    head[:1] = True
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=head[1:])
    place = np.empty(n + 1, np.int32 if n < 1 << 31 else np.int64)
    place[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=place.dtype), 0))
    place[n] = -1
    known = 3
    while known < depth:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(tied):
            break
        who = order[tied]
        group = place[who]
        second = place[np.minimum(who + known, n)] + 1
        both = group.astype(np.uint64) * np.uint64(n + 2) + second.astype(np.uint64)
        sort = np.argsort(both)
        order[tied], both = who[sort], both[sort]
        fresh = np.empty(len(tied), bool)
        fresh[:1] = True
        np.not_equal(both[1:], both[:-1], out=fresh[1:])
        head[tied] = fresh
        at = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        place[order[tied]] = at
        known *= 2
    return order, sorted_key


def search(words: np.ndarray, marks: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All left-maximal matches of the tests' suffixes that are long enough: place in the shard, place in tests.words, length.

    words: hashes of the shard's words, 0 after each document (where marks is set).
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(words) or not len(tests.starts):
        return none
    alphabet, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int32)
    order, keys = suffix_array(rank, tests.longest)
    there = np.minimum(np.searchsorted(alphabet, tests.words), len(alphabet) - 1)
    wanted = np.where((alphabet[there] == tests.words) & (tests.words != 0), there, -2)
    base = np.uint64(int(rank.max()) + 2)
    # The first three words are one key; of tests of one or two words all keys that begin so.
    s = tests.starts
    words_of = lambda k: np.where(tests.need[s] > k, wanted[np.minimum(s + k, len(wanted) - 1)], -1)
    known = np.logical_and.reduce([(words_of(k) >= 0) | (tests.need[s] <= k) for k in range(3)])
    s = s[known]
    if not len(s):
        return none
    key, span = np.zeros(len(s), np.uint64), np.ones(len(s), np.uint64)
    for k in range(3):
        key = key * base + (words_of(k) + 1).astype(np.uint64)
        span[tests.need[s] <= k] *= base
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key + span, "left")
    depth = 3
    padded = np.append(rank, np.full(tests.longest + 1, -1))
    need = tests.need[s]
    while True:
        live = low < high
        s, low, high, need = s[live], low[live], high[live], need[live]
        on = np.flatnonzero(need > depth)
        if not len(on):
            break
        c = wanted[s[on] + depth]
        for side, value in ((low, c), (high, c + 1)):
            a, b = low[on].copy(), high[on].copy()
            if side is high:
                a = low_new.copy()  # noqa: F821
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                less = padded[order[np.minimum(mid, len(order) - 1)] + depth] < value
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            if side is low:
                low_new = a
            else:
                high_new = a
        low[on], high[on] = low_new, np.where(c >= 0, high_new, low_new)
        depth += 1
    if not len(s):
        return none
    n = high - low
    owner = np.repeat(np.arange(len(s)), n)
    place = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    q = s[owner]
    first = tests.first[tests.item[q]]
    maximal = (q == first) | (place == 0) | (padded[place - 1] != wanted[q - 1])
    place, q = place[maximal], q[maximal]
    length, left = tests.need[q].copy(), tests.left[q]
    going = np.flatnonzero(length < left)
    while len(going):
        d = length[going]
        same = padded[place[going] + d] == wanted[q[going] + d]
        going = going[same]
        length[going] += 1
        going = going[length[going] < left[going]]
    return place, q, length


class Shard:
    """Words of some documents, with the row and the place of each."""

    def __init__(self):
        self.words, self.rows, self.starts, self.ends, self.size = [], [], [], [], 0

    def add(self, row: int, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        nought = np.zeros(1, np.int32)
        self.words += [words, np.zeros(1, np.uint64)]
        self.rows.append(np.full(len(words) + 1, row, np.int32))
        self.starts += [starts.astype(np.int32), nought]
        self.ends += [ends.astype(np.int32), nought]
        self.size += len(words) + 1

    def matches(self, tests: Tests) -> list[tuple[int, int, int, int, int, int]]:
        """(row, test, words, start, end, test word) of the longest match of each row and test text (by its place in tests);
        the first one if several are."""
        if not self.size:
            return []
        joined = []
        for parts in (self.words, self.rows, self.starts, self.ends):
            joined.append(np.concatenate(parts))
            parts.clear()
        words, rows, starts, ends = joined
        place, q, length = search(words, rows, tests)
        item = tests.item[q]
        row, begin, word = rows[place], starts[place], q - tests.first[item]
        order = np.lexsort((word, begin, -length, item, row))
        first = order[np.append(True, (np.diff(row[order]) != 0) | (np.diff(item[order]) != 0))[: len(order)]]
        return list(zip(*(x[first].tolist() for x in (row, item, length, begin, ends[place + length - 1], word))))


def _searched(batches: Iterator[pa.RecordBatch], text_col: str, tests: Tests, shard_words: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Pieces of the batches with their matches; rows count within a piece."""
    for batch in batches:
        shard, found, done = Shard(), [], 0
        for a, b, texts in slabs(batch.column(batch.schema.get_field_index(text_col)), NARROW_CHARS):
            grid = Grid([t or "" for t in texts])
            starts, ends, counts = grid.words()
            words = grid.hashes(starts, ends, fold=True)
            words[words == 0] = 1
            upto = np.append(0, np.cumsum(counts))
            for row in range(b - a):
                lo, hi, origin = int(upto[row]), int(upto[row + 1]), grid.starts[row]
                step = shard_words
                for x in range(lo, hi, step):
                    y = min(hi, x + step + tests.longest)
                    shard.add(a + row, words[x:y], starts[x:y] - origin, ends[x:y] - origin)
                    if shard.size >= shard_words:
                        found += shard.matches(tests)
                        shard = Shard()
            if not shard.size:
                yield batch.slice(done, b - done), _local(found, done)
                found, done = [], b
        found += shard.matches(tests)
        if done < batch.num_rows:
            yield batch.slice(done), _local(found, done)


def _local(found: list[tuple], offset: int) -> list[tuple]:
    best: dict[tuple[int, int], tuple] = {}
    for r, i, n, a, b, w in found:
        if (r, i) not in best or (-n, a, w) < best[r, i][:3]:
            best[r, i] = (-n, a, w, b)
    return [(r - offset, i, -n, a, b, w) for (r, i), (n, a, w, b) in sorted(best.items(), key=lambda x: x[0][0])]


def _passes(benchmark: DataFrame, item_col: str, text_col: str, least: int) -> Iterator[list[tuple[int, str]]]:
    """The test texts, in groups of a bounded size."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    groups = size // PASS_BYTES + 1
    for g in range(groups):
        some = rows if groups == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g)
        yield sorted((r.i, r.t) for r in some.collect())


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The longest verbatim match of each document with each test text that reaches the limit:
    doc_id, item_id, words, text_start, text_end (code points of the document), item_start (word of the test text).

    Words are compared without case and whatever stands between them. Of equally long matches the first is given. Null and
    empty texts match nothing, test texts that are null, without a word or of a null id are not searched for, those under
    the limit are searched for as a whole, from one word on, item_id has the type of the benchmark's, repeated rows and repeated items each give their rows, a null doc_id is passed on, and no documents or no tests give no
    rows. Documents of any length are searched whole. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("item_id", benchmark.schema[item_col].dataType), *[T.StructField(n, T.IntegerType()) for n in ("words", "text_start", "text_end", "item_start")]])
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for items in _passes(benchmark, item_col, item_text, least):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            tests = Tests(sent.value, least)
            for piece, found in _searched(batches, "text", tests, shard_words):
                if found:
                    row, item, *rest = (list(x) for x in zip(*found))
                    ids = piece.column(piece.schema.get_field_index("doc_id")).take(pa.array(row))
                    item = [tests.ids[i] for i in item]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(item, item_type), *[pa.array(x, pa.int32()) for x in rest]], names=schema.names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The rows of docs, all columns, without those that have a match as matches() reports it.

    Null and empty texts stay; repeated rows stay or go alike; columns of any names pass, also those named like the
    benchmark's; an empty benchmark leaves everything, an empty table is empty. Texts of any length are searched whole.
    """
    for items in _passes(benchmark, item_col, item_text, least):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            tests = Tests(sent.value, least)
            for piece, found in _searched(batches, at, tests, shard_words):
                good = np.ones(piece.num_rows, bool)
                good[[f[0] for f in found]] = False
                yield piece.filter(pa.array(good)).rename_columns(names)

        names = docs.columns
        at = f"c{names.index(text_col)}"
        docs = docs.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, docs.schema)
    return docs
