"""Scores of a causal self-attention language model over subword ids, trained and applied in numpy.

Every id has an input vector of its own. One attention head, with a learned bias for each distance, sees at most two blocks
of ids before the next one: texts are cut into blocks of a stride, a window is a block with the one before it, so windows
overlap by half and each id is scored once, with a full block of context at least (but at a text's start). With one head
the products of query and key matrices, and of value and output matrices, are one matrix each (Q and V below), so inputs
stand for keys and values. The next id is the leaf of a tree of FAN branches a node, Huffman's over the ids' counts in the
corpus, and each node on the way chooses its branch by a softmax over the same state: chances of all ids of the vocabulary
add up to one, and none shares a vector with another.

Id counts and the training set follow the corpus: every id of every document is counted, and every window of every
document is trained on once in ROUNDS rounds. Tasks train on their own windows from common weights, and the averages of
their weights, each row of them by how often the task met it, start the next round, so no text leaves its task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lingoframe.llm import bpe
from lingoframe.llm.shared import map_texts, written
from lingoframe.llm.tokenstore import id_type

#: Ids of a block; numbers of a vector, which are those of a row of the exchange too; branches of a node of the tree.
STRIDE, WIDTH, FAN = 32, 16, 32
#: Rounds of training, each over its share of all windows, and the rate of its steps.
ROUNDS, RATE = 2, 0.2
#: Ids that a step of training takes and that one numpy pass scores. Longer texts are cut, with a block of context.
STEP_IDS, PASS_IDS = 1 << 12, 1 << 13
#: Ids that are laid out at once for training, in steps: texts that don't fill a step by themselves are followed by others.
TOGETHER = 4
#: Blocks of a task's first step; those that follow take more, so that small tables have enough steps too.
FIRST_ROWS = 8
#: Blocks whose attention is held in the cache at once.
PART = 64
#: States of one node that are multiplied at once. In larger products the rounding of a row depends on where it stands.
TILE = 8
#: What every id counts besides its occurrences, and the bias of a branch without an id.
SMOOTH, NEVER = 0.01, -1e4
BOS, PAD = 0, 1
ROW = ["at int", "n double", *[f"x{k} float" for k in range(WIDTH)]]


class Lexicon:
    """The way from the root to each id: node and branch by level. Nodes go by falling counts, the root is 0."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        weight = counts + SMOOTH
        order = np.argsort(weight, kind="stable")
        empty = (1 - n) % (FAN - 1) if n > 1 else FAN - 1
        queues = [[0.0] * empty + weight[order].tolist(), []]
        leaves, heads = len(queues[0]), [0, 0]
        self.nodes = (leaves - 1) // (FAN - 1)
        parent, branch, bias = np.zeros(leaves + self.nodes, np.int64), np.zeros(leaves + self.nodes, np.int64), np.full((self.nodes, FAN), NEVER, np.float32)
        for made in range(self.nodes):
            taken = []
            for b in range(FAN):
                first = 0 if heads[0] < leaves and (heads[1] == made or queues[0][heads[0]] <= queues[1][heads[1]]) else 1
                item = heads[first] + first * leaves
                taken.append(queues[first][heads[first]])
                heads[first] += 1
                parent[item], branch[item] = made, b
            queues[1].append(sum(taken))
            for b, mass in enumerate(taken):
                if mass:
                    bias[made, b] = np.log(mass / queues[1][made])
        self.bias = bias[::-1].copy()
        self.size, self.units = n, n + 2
        at = np.empty(n, np.int64)
        at[order] = np.arange(empty, leaves)
        steps = []
        while len(up := np.flatnonzero(at != leaves + self.nodes - 1)):
            node, by = np.full(n, -1, np.int32), np.zeros(n, np.int16)
            node[up], by[up] = self.nodes - 1 - parent[at[up]], branch[at[up]]
            at[up] = leaves + parent[at[up]]
            steps.append((node, by))
        self.depth = sum((node >= 0).astype(np.int16) for node, _ in steps)
        self.node, self.branch = np.full((len(steps), n), -1, np.int32), np.zeros((len(steps), n), np.int16)
        for k, (node, by) in enumerate(steps):
            there = np.flatnonzero(node >= 0)
            self.node[self.depth[there] - 1 - k, there], self.branch[self.depth[there] - 1 - k, there] = node[there], by[there]


def shapes(lexicon: Lexicon) -> dict[str, tuple[int, ...]]:
    """E: inputs, Q: queries by keys, V: values, D: bias by distance; W and c: states and bias by node, with a column a branch."""
    return {"E": (lexicon.units, WIDTH), "Q": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "D": (2 * STRIDE,), "W": (lexicon.nodes, WIDTH, FAN), "c": (lexicon.nodes, FAN)}


def first_weights(lexicon: Lexicon, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(s) * {"E": 0.3, "Q": 0.1, "V": 0.25}.get(k, 0)).astype(np.float32) for k, s in shapes(lexicon).items()}
    w["c"] = lexicon.bias.copy()
    return w


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    """All weights as rows of WIDTH numbers."""
    return np.concatenate([x.reshape(-1, WIDTH) for x in w.values()]).astype(np.float32)


def unflat(rows: np.ndarray, lexicon: Lexicon) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(lexicon).items():
        n = int(np.prod(shape)) // WIDTH
        out[name], at = np.array(rows[at : at + n], np.float32).reshape(shape), at + n
    return out


class Blocks:
    """Inputs and targets of some pieces of texts in rows of a stride. first: which rows begin a piece.

    before: the input at each piece's start; lead: whether its first block is context only."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, before: np.ndarray | int = BOS, lead: np.ndarray | bool = False):
        rows = -(-counts // STRIDE)
        at = np.cumsum(rows) - rows
        self.inputs = np.full(int(rows.sum()) * STRIDE, PAD - 2, np.int32)
        self.targets = np.full(len(self.inputs), -1, np.int32)
        # A piece takes a block at least, so going through them costs little.
        for a, b, n in zip((at * STRIDE).tolist(), (np.cumsum(counts) - counts).tolist(), counts.tolist()):
            if n:
                self.targets[a : a + n] = ids[b : b + n]
                self.inputs[a + 1 : a + n] = ids[b : b + n - 1]
        self.inputs += 2
        real = counts > 0
        self.inputs[at[real] * STRIDE] = np.broadcast_to(before, counts.shape)[real]
        self.inputs, self.targets = self.inputs.reshape(-1, STRIDE), self.targets.reshape(-1, STRIDE)
        self.first = np.zeros(len(self.inputs), bool)
        self.first[at[real]] = True
        self.targets[at[real & np.broadcast_to(lead, counts.shape)]] = -1
        self.owner = np.repeat(np.arange(len(counts)), rows)

    def part(self, a: int, b: int) -> Blocks:
        """Some rows alone, with the one before them as context."""
        out, at = object.__new__(Blocks), max(0, a - 1) if not self.first[a] else a
        out.inputs, out.targets, out.first, out.owner = self.inputs[at:b], self.targets[at:b].copy(), self.first[at:b].copy(), self.owner[at:b]
        out.targets[: a - at] = -1
        out.first[0] = True
        return out


def _distances() -> tuple[np.ndarray, np.ndarray]:
    """How far back each of the window's places lies from each of the block's, and which of them mustn't be seen."""
    far = STRIDE + np.arange(STRIDE)[:, None] - np.arange(2 * STRIDE)[None, :]
    return np.maximum(far, 0), far < 0


FAR, AHEAD = _distances()


def _bounded(z: np.ndarray) -> np.ndarray:
    """z, at most 60, so that no power overflows."""
    return np.minimum(z, 60, out=z) if z.size and z.max() > 60 else z


def _windows(x: np.ndarray) -> np.ndarray:
    """Each block with the one before it, without a copy and the ones; x has one block more, at its start."""
    s = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(x) - 1, 2 * STRIDE, WIDTH), (s[0], s[1], s[2]))


def _columns(x: np.ndarray) -> np.ndarray:
    """The same windows with places along rows, the ones as the row below: as the right side of a product these are read in
    order, which takes half the time of the transposed ones."""
    flat = np.ascontiguousarray(x.reshape(-1, WIDTH + 1).T)
    s = flat.strides
    return np.lib.stride_tricks.as_strided(flat, (len(x) - 1, WIDTH + 1, 2 * STRIDE), (STRIDE * s[1], s[0], s[1]))


def _inputs(rows: np.ndarray) -> np.ndarray:
    """The inputs (n, STRIDE, WIDTH) with a one after each, and one block more, of nothing, before them."""
    x = np.ones((len(rows) + 1, STRIDE, WIDTH + 1), rows.dtype)
    x[0, :, :WIDTH], x[1:, :, :WIDTH] = 0, rows
    return x


def _with_one(v: np.ndarray) -> np.ndarray:
    """V with a column of zeros, so that states keep the one that their inputs end in."""
    return np.concatenate([v, np.zeros((WIDTH, 1), v.dtype)], axis=1)


def _bias(w: dict[str, np.ndarray]) -> np.ndarray:
    bias = w["D"][FAR]
    bias[AHEAD] = NEVER
    return bias


def attended(w: dict[str, np.ndarray], x: np.ndarray, q: np.ndarray, window: np.ndarray, columns: np.ndarray, first: np.ndarray, bias: np.ndarray, a: np.ndarray, mixed: np.ndarray, h: np.ndarray) -> None:
    """Fills a with the weights of all places of the blocks x, by their windows and queries, mixed with the mixed inputs, and
    h with the states, each with a one after it."""
    np.matmul(q, columns[:, :WIDTH], out=a)
    a += bias
    np.exp(_bounded(a), out=a)
    for k in first.nonzero()[0].tolist():
        a[k, :, :STRIDE] = 0
    a *= 1 / (a @ np.ones((2 * STRIDE, 1), a.dtype))
    np.matmul(a, window, out=mixed)
    np.matmul(mixed, _with_one(w["V"]), out=h)
    h += x


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of the columns of a and b, both (n, STRIDE, any). Block by block, since OpenBLAS takes several times as
    long over one product of thousands of rows as over small ones."""
    return np.matmul(a.transpose(0, 2, 1), b).sum(axis=0)


def _nodes(w: dict[str, np.ndarray], nodes: np.ndarray) -> np.ndarray:
    """The weights of some nodes with their biases below, for states that end in a one."""
    own = np.empty((len(nodes), WIDTH + 1, FAN), w["W"].dtype)
    own[:, :WIDTH], own[:, WIDTH] = w["W"].take(nodes, axis=0), w["c"].take(nodes, axis=0)
    return own


def _grouped(w: dict[str, np.ndarray], node: np.ndarray, branch: np.ndarray, rows: np.ndarray, h: np.ndarray, share: float):
    """What choices() gives for items of any nodes but the root: losses, and with a share what comes back for their states, with
    the place of each item in that, and the gradients by nodes. Nodes of one tile are multiplied all at once, the others one by one: with a share, where
    rounding may depend on the place, without tiles."""
    order = np.argsort(node.astype(np.uint16) if len(w["W"]) < 1 << 16 else node, kind="stable")
    run = node.take(order)
    edge = np.append(0, np.flatnonzero(run[1:] != run[:-1]) + 1)
    items = np.append(edge[1:], len(run)) - edge
    nodes, tiles = run.take(edge), -(-items // TILE)
    own = _nodes(w, nodes)
    # Those of several tiles come first.
    large, small = np.flatnonzero(tiles > 1), np.flatnonzero(tiles == 1)
    height = items if share else tiles * TILE
    begin = np.append(0, np.cumsum(height[large]))
    start = np.empty_like(edge)
    start[large], start[small] = begin[:-1], begin[-1] + np.arange(len(small)) * TILE
    place = bpe.spread(start, items)
    whose = np.zeros(begin[-1] + len(small) * TILE, np.int64)
    whose[place] = rows.take(order)
    state = h.take(whose, axis=0)
    z = np.empty((len(state), FAN), h.dtype)
    parts = [(k, slice(a, b)) for k, a, b in zip(large.tolist(), begin[:-1].tolist(), begin[1:].tolist())]
    for k, part in parts:
        if share:
            np.matmul(state[part], own[k], out=z[part])
        else:
            np.matmul(state[part].reshape(-1, TILE, WIDTH + 1), own[k], out=z[part].reshape(-1, TILE, FAN))
    rest = slice(begin[-1], None)
    tiled, few = state[rest].reshape(-1, TILE, WIDTH + 1), own.take(small, axis=0)
    np.matmul(tiled, few, out=z[rest].reshape(-1, TILE, FAN))
    lost, e = _lost(z, place, branch.take(order), share)
    loss = np.empty_like(lost)
    loss[order] = lost
    if not share:
        return loss, None, None
    # The last row of what is sent is for states without an item.
    by, sent, back = np.empty_like(own), np.empty((len(state) + 1, WIDTH), h.dtype), np.ascontiguousarray(own[:, :WIDTH].transpose(0, 2, 1))
    sent[-1] = 0
    for k, part in parts:
        np.matmul(state[part].T, e[part], out=by[k])
        np.matmul(e[part], back[k], out=sent[part])
    by[small] = tiled.transpose(0, 2, 1) @ e[rest].reshape(-1, TILE, FAN)
    np.matmul(e[rest].reshape(-1, TILE, FAN), back.take(small, axis=0), out=sent[begin[-1] : -1].reshape(-1, TILE, WIDTH))
    found = np.empty_like(place)
    found[order] = place
    return loss, (sent, found), (nodes, items, by)


def _lost(z: np.ndarray, place: np.ndarray, branch: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Negative log-likelihood of the branches taken in some places of the logits z (n, FAN), which become, with a share,
    what has to go back: the chance of each branch, less one for the one taken; nothing in places without an item."""
    flat_z = _bounded(z).reshape(-1)
    taken = place * FAN
    taken += branch
    hit = flat_z.take(taken)
    np.exp(z, out=z)
    mass = z @ np.ones(FAN, z.dtype) if share else np.einsum("ij->i", z)
    had = mass.take(place)
    lost = np.log(had)
    lost -= hit
    if share:
        scale = np.zeros(len(mass), z.dtype)
        scale[place] = share / had
        z *= scale[:, None]
        flat_z[taken] -= share
    return lost, z


def _root(w: dict[str, np.ndarray], h: np.ndarray, at: np.ndarray, branch: np.ndarray, share: float):
    """Losses of items of the root, and with a share what comes back for each state, and the gradients by the node."""
    own, state = _nodes(w, np.zeros(1, np.int64))[0], h.reshape(-1, STRIDE, WIDTH + 1)
    loss, e = _lost((state @ own).reshape(-1, FAN), at, branch, share)
    if not share:
        return loss, None, None
    e = e.reshape(-1, STRIDE, FAN)
    back = np.matmul(e, np.ascontiguousarray(own[:WIDTH].T)).reshape(-1, WIDTH)
    return loss, back, (np.zeros(1, np.int64), np.array([len(at)]), _outer(state, e)[None])


def choices(w: dict[str, np.ndarray], lexicon: Lexicon, h: np.ndarray, at: np.ndarray, ids: np.ndarray, share: float = 0.0) -> tuple[np.ndarray, np.ndarray | None, list[tuple[np.ndarray, ...]]]:
    """Negative log-likelihood of each of the ids, by the states h[at] (h is (n, WIDTH), or one more, which is 1); with a
    share, that a single loss has of what is to be lowered, also the gradients by h, and by nodes (node, items, by W and c)."""
    if h.shape[1] == WIDTH:
        h = np.append(h, np.ones((len(h), 1), h.dtype), axis=1)
    loss, dh, by = _root(w, h, at, lexicon.branch[0].take(ids), share)
    found = [by]
    # All lower levels are taken together; below the second few items are left.
    depth, on, levels = lexicon.depth.take(ids), None, []
    while len(on := np.flatnonzero(depth > 1) if on is None else on[depth.take(on) > len(levels) + 1]):
        levels.append(on)
    if levels:
        on, starts = np.concatenate(levels), np.cumsum([0, *map(len, levels)]).tolist()
        flat = np.concatenate([ids.take(some) + k * lexicon.size for k, some in enumerate(levels, 1)])
        lost, back, by = _grouped(w, lexicon.node.ravel().take(flat), lexicon.branch.ravel().take(flat), at.take(on), h, share)
        for a, b, some in zip(starts, starts[1:], levels):
            loss[some] += lost[a:b]
        found.append(by)
        if share:
            sent, place = back
            for a, b, some in zip(starts, starts[1:], levels):
                rows = at.take(some)
                if a:
                    dh[rows] += sent.take(place[a:b], axis=0)
                else:  # most states have an item here, so rows in order of the states are quicker
                    whose = np.full(len(dh), len(sent) - 1)
                    whose[rows] = place[a:b]
                    dh += sent.take(whose, axis=0)
    return loss, dh, found


def tabled(w: dict[str, np.ndarray]) -> np.ndarray:
    """Each input with its query."""
    return np.concatenate([w["E"], w["E"] @ w["Q"]], axis=1)


def scores(w: dict[str, np.ndarray], blocks: Blocks, lexicon: Lexicon, n_texts: int, table: np.ndarray | None = None) -> np.ndarray:
    """Negative log-likelihood of each text, in nats."""
    n = len(blocks.inputs)
    if not n:
        return np.zeros(n_texts)
    table = tabled(w) if table is None else table
    both = table.take(blocks.inputs, axis=0)
    x, q = _inputs(both[:, :, :WIDTH]), both[:, :, WIDTH:]
    h, a = np.empty((n, STRIDE, WIDTH + 1), table.dtype), np.empty((min(n, PART), STRIDE, 2 * STRIDE), table.dtype)
    mixed = np.empty((len(a), STRIDE, WIDTH), table.dtype)
    windows, columns, bias = _windows(x), _columns(x), _bias(w)
    for c in range(0, n, PART):
        e = min(n, c + PART)
        attended(w, x[c + 1 : e + 1], q[c:e], windows[c:e], columns[c:e], blocks.first[c:e], bias, a[: e - c], mixed[: e - c], h[c:e])
    target = blocks.targets.ravel()
    at = np.flatnonzero(target >= 0)
    loss, _, _ = choices(w, lexicon, h.reshape(-1, WIDTH + 1), at, target[at])
    return np.bincount(blocks.owner[at // STRIDE], loss, n_texts)


def gradients(w: dict[str, np.ndarray], blocks: Blocks, lexicon: Lexicon) -> tuple[float, dict[str, tuple[np.ndarray | slice, np.ndarray, np.ndarray]]]:
    """Mean loss over the targets, and its gradients: for each weight the rows concerned, how often they were met, and the slopes."""
    n = len(blocks.inputs)
    target = blocks.targets.ravel()
    at = np.flatnonzero(target >= 0)
    if not len(at):
        return 0.0, {}
    kind = w["E"].dtype
    here = w["E"].take(blocks.inputs, axis=0)
    x, q = _inputs(here), np.matmul(here, w["Q"])
    h, mixed = np.empty((n, STRIDE, WIDTH + 1), kind), np.empty_like(q)
    # The weights of each part are an array of their own without gaps, and the slopes of all parts use one, which stays in the
    # cache: passes over them take half the time that they take where weights and slopes of a block lie together.
    parts = [(c, min(n, c + PART)) for c in range(0, n, PART)]
    weights = [np.empty((e - c, STRIDE, 2 * STRIDE), kind) for c, e in parts]
    windows, columns, bias = _windows(x), _columns(x), _bias(w)
    for (c, e), a in zip(parts, weights):
        attended(w, x[c + 1 : e + 1], q[c:e], windows[c:e], columns[c:e], blocks.first[c:e], bias, a, mixed[c:e], h[c:e])
    loss, dh, found = choices(w, lexicon, h.reshape(-1, WIDTH + 1), at, target[at], 1 / len(at))
    dh = dh.reshape(n, STRIDE, WIDTH)
    dv = _outer(mixed, dh)
    # By the softmax, a * (da - mean) is what goes on; the mean comes with the product, by the row of ones.
    dm = np.empty((n, STRIDE, WIDTH + 1), kind)
    np.matmul(dh, np.ascontiguousarray(w["V"].T), out=dm[:, :, :WIDTH])
    mixed *= dm[:, :, :WIDTH]
    np.matmul(mixed, np.full((WIDTH, 1), -1, kind), out=dm[:, :, WIDTH:])
    dq, dw, slope, slopes = np.empty_like(q), np.empty((n, 2 * STRIDE, WIDTH), kind), np.zeros((STRIDE, 2 * STRIDE), kind), np.empty_like(weights[0])
    # The last part first: it is still in the cache.
    for (c, e), a in zip(parts[::-1], weights[::-1]):
        da = slopes[: e - c]
        np.matmul(dm[c:e], columns[c:e], out=da)
        da *= a
        slope += da.sum(axis=0)
        np.matmul(da, windows[c:e], out=dq[c:e])
        np.matmul(a.transpose(0, 2, 1), dm[c:e, :, :WIDTH], out=dw[c:e])
        dw[c:e] += np.matmul(da.transpose(0, 2, 1), q[c:e])
    dx = np.matmul(dq, np.ascontiguousarray(w["Q"].T))
    dx += dh
    dx += dw[:, STRIDE:]
    dx[:-1] += dw[1:, :STRIDE]
    dx = dx.reshape(-1, WIDTH)
    every, often = slice(None), np.array(float(len(at)))
    g = {"Q": (every, often, _outer(here, dq)), "V": (every, often, dv), "D": (every, often, np.bincount(FAR.ravel(), slope.ravel(), 2 * STRIDE).astype(kind))}
    unit = blocks.inputs.ravel()
    order = np.argsort(unit.astype(np.uint16) if len(w["E"]) <= 1 << 16 else unit, kind="stable")
    run = unit.take(order)
    edge = np.append(0, np.flatnonzero(run[1:] != run[:-1]) + 1)
    # Numbers are added in pairs, as complex ones, since the time goes by columns.
    pairs = np.add.reduceat(dx.take(order, axis=0).view(np.result_type(kind, np.complex64)), edge, axis=0)
    g["E"] = run.take(edge), np.append(edge[1:], len(run)) - edge, pairs.view(kind)
    nodes, items, by = (np.concatenate(part) for part in zip(*found))
    g["W"], g["c"] = (nodes, items, by[:, :WIDTH]), (nodes, items, by[:, WIDTH])
    return float(loss.sum(dtype=np.float64)) / len(at), g


class Trainer:
    """Steps that get shorter the more a weight was moved before; weights that a batch doesn't meet stay as they are."""

    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate = w, rate
        self.moved = {k: np.zeros_like(x) for k, x in w.items()}
        self.met = {k: np.zeros(len(x) if k in "EWc" else ()) for k, x in w.items()}

    def step(self, g: dict[str, tuple[np.ndarray | slice, np.ndarray, np.ndarray]], ids: int = STEP_IDS) -> None:
        """A step by the mean over so many ids; the fewer, the shorter."""
        rate = self.rate * min(1.0, ids / STEP_IDS) ** 0.5
        for k, (rows, often, slope) in g.items():
            every = isinstance(rows, slice)
            moved, by = self.moved[k] if every else self.moved[k].take(rows, axis=0), slope * slope
            moved += by
            if not every:
                self.moved[k][rows] = moved
            np.sqrt(moved, out=by)
            by += 1e-10
            np.divide(slope, by, out=by)
            by *= rate
            if every:
                self.w[k] -= by
            else:
                self.w[k][rows] = np.subtract(self.w[k].take(rows, axis=0), by, out=by)
            if k in "EWc":
                self.met[k][rows] += often
            else:
                self.met[k] += often

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of the weights that were met: place, how often, and numbers."""
        often = np.concatenate([np.repeat(np.broadcast_to(self.met[k], len(x) if k in "EWc" else 1), x.size // WIDTH // (len(x) if k in "EWc" else 1)) for k, x in self.w.items()])
        at = np.flatnonzero(often)
        return at, often[at], flat(self.w)[at]


def id_bytes(ids: np.ndarray, counts: np.ndarray, null: np.ndarray, kind: str) -> pa.Array:
    """A binary Arrow column of the ids of each text; null where null is set."""
    offsets = np.append(0, np.cumsum(counts * np.dtype(kind).itemsize)).astype(np.int32)
    valid = pa.array(~null).buffers()[1] if len(null) else None
    return pa.Array.from_buffers(pa.binary(), len(counts), [valid, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))])


def encoded(df: DataFrame, id_col: str, text_col: str, vocabulary_path: str) -> DataFrame:
    """The texts as ids in binary, column ids, which are cheaper to move than arrays. In slabs, so that no column outgrows its offsets."""
    lines = df.sparkSession.sparkContext.broadcast(bpe.vocabulary_lines(vocabulary_path))

    def make():
        coder = bpe.coder(lines.value)
        kind = id_type(len(coder.vocab.tokens))

        def apply(texts: list[str | None]) -> list:
            ids, counts = coder.encode([t or "" for t in texts])
            return [id_bytes(ids, counts, np.array([t is None for t in texts], bool), kind)]

        return apply

    return map_texts(df, text_col, [("ids", T.BinaryType(), pa.binary())], make, [id_col])


def _unpacked(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch and where each row's begin, with the end."""
    column = batch.column(batch.schema.get_field_index("ids"))
    if column.null_count:
        column = pc.fill_null(column, b"")
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    size = np.dtype(kind).itemsize
    offsets = np.frombuffer(offsets, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64) if offsets else np.zeros(len(column) + 1, np.int64)
    ids = np.frombuffer(data, kind, int(offsets[-1] - offsets[0]) // size, int(offsets[0])) if data and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return ids, (offsets - offsets[0]) // size


def pieces(ids: np.ndarray, starts: np.ndarray, size: int, turn: int = 0, every: int = 1, together: int = 1) -> Iterator[tuple[np.ndarray, Blocks]]:
    """Blocks of about `together` times `size` ids, with the rows of their owners. A text longer than size is cut into stretches
    of it, each with the block before it. Of `every` turns each text or stretch is in one, by a checksum: whatever it lies beside."""
    rows, parts, begin, lead, held = [], [], [], [], 0

    def made() -> tuple[np.ndarray, Blocks]:
        counts = np.array([len(p) for p in parts], np.int64)
        return np.array(rows), Blocks(np.concatenate(parts), counts, np.array(begin), np.array(lead))

    for row, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        mark = zlib.crc32(ids[a:b].tobytes()) if every > 1 else 0
        for k, s in enumerate(range(a, b, size)):
            if (mark + k + turn) % every:
                continue
            e, ahead = min(b, s + size), STRIDE if k else 0
            if held + e - s > size * together and rows:
                yield made()
                rows, parts, begin, lead, held = [], [], [], [], 0
            rows.append(row)
            parts.append(ids[s - ahead : e])
            begin.append(int(ids[s - ahead - 1]) + 2 if s - ahead > a else BOS)
            lead.append(bool(k))
            held += e - s
    if rows:
        yield made()


def id_counts(ids: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in the whole table; the driver gets as many rows as the vocabulary has ids at most."""
    kind = id_type(size)

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch, kind)[0], minlength=size)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["id", "n"])

    found = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def train_on(batches: Iterator[pa.RecordBatch], w: dict[str, np.ndarray], lexicon: Lexicon, turn: int, every: int, rate: float) -> Trainer:
    """Train on the windows whose turn it is of `every` turns; together these take all."""
    trainer, kind, rows = Trainer(w, rate), id_type(lexicon.size), FIRST_ROWS
    for batch in batches:
        for _, blocks in pieces(*_unpacked(batch, kind), STEP_IDS, turn, every, TOGETHER):
            at = 0
            while at < len(blocks.inputs):
                end = len(blocks.inputs) if at + rows * 3 // 2 >= len(blocks.inputs) else at + rows
                some = blocks.part(at, end) if at or end < len(blocks.inputs) else blocks
                trainer.step(gradients(w, some, lexicon)[1], some.inputs.size)
                at, rows = end, min(STEP_IDS // STRIDE, rows * 5 // 4)
    return trainer


def trained(ids: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, every: int = ROUNDS, rate: float = RATE) -> dict[str, np.ndarray]:
    """Weights after some rounds of training in all tasks and averaging, for which Spark sums each row of weights; the driver
    gets the rows, of which there are as many as the vocabulary has ids, twice."""
    w = flat(first_weights(lexicon))
    session = ids.sparkSession
    for turn in range(rounds):
        sent = session.sparkContext.broadcast((w, lexicon))

        def run(batches, sent=sent, turn=turn):
            numbers, words = sent.value
            at, often, rows = train_on(batches, unflat(numbers, words), words, turn, every, rate).rows()
            for a in range(0, len(at), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 4096], pa.int32()), pa.array(often[a : a + 4096], pa.float64()), *[pa.array(rows[a : a + 4096, k]) for k in range(WIDTH)]], names=[c.split()[0] for c in ROW])

        met = ids.select("ids").mapInArrow(run, ", ".join(ROW)).groupBy("at")
        mean = met.agg(*[(F.sum(F.col(f"x{k}") * F.col("n")) / F.sum("n")).alias(f"x{k}") for k in range(WIDTH)]).toArrow()
        at = mean.column("at").to_numpy()
        for k in range(WIDTH):
            w[at, k] = mean.column(f"x{k}").to_numpy()
        sent.unpersist()
    return unflat(w, lexicon)


def score_ids(ids: DataFrame, w: dict[str, np.ndarray], lexicon: Lexicon, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, nll, mean_nll, perplexity) of a table of ids in binary."""
    schema = T.StructType([ids.schema[id_col], T.StructField("n_tokens", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("nll", "mean_nll", "perplexity")]])
    sent = ids.sparkSession.sparkContext.broadcast((flat(w), lexicon))

    def run(batches):
        numbers, words = sent.value
        mine, kind = unflat(numbers, words), id_type(words.size)
        table = tabled(mine)
        for batch in batches:
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            some, starts = _unpacked(batch, kind)
            nll, counts = np.zeros(batch.num_rows), np.diff(starts)
            for rows, blocks in pieces(some, starts, PASS_IDS):
                np.add.at(nll, rows, scores(mine, blocks, words, len(rows), table))
            mean, no = nll / np.maximum(counts, 1), counts == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int32), mask=null), pa.array(nll, mask=null), pa.array(mean, mask=no), pa.array(np.exp(np.minimum(mean, 700)), mask=no)], names=schema.names)

    return ids.select(F.col(f"`{id_col}`"), "ids").mapInArrow(run, schema)


def language_model_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = bpe.VOCABULARY, rounds: int = ROUNDS, every: int = ROUNDS) -> DataFrame:
    """Train on the texts of df and score each of them: id, n_tokens, nll (nats), mean_nll and perplexity.

    A null text has nulls; an empty one no tokens, nll 0 and null means. Every row is scored as it stands: repeated rows
    count, train and are scored again. Texts of any length are scored whole. An empty table gives no rows; without any
    token the model stays as it began. Other columns are ignored. Scores depend on how the table lies in partitions, since
    each task trains weights of its own before they are averaged; equal texts of one call have equal scores.
    """
    ids = written(encoded(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col, vocabulary_path), "ids")
    size = len(bpe.vocabulary(bpe.vocabulary_lines(vocabulary_path)).tokens)
    lexicon = Lexicon(id_counts(ids, size))
    return score_ids(ids, trained(ids, lexicon, rounds, every), lexicon, id_col)
