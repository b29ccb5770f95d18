"""Boosted trees and forests of all fit sets at once, grown level by level on binned rows.

One pass per level sums a histogram over (fit set, tree, node, input, code) and the driver picks
each node's split from the sums; sums are bounded by the number of nodes times codes, never by the
rows. A forest grows some trees of all sets at a time: nodes of many rows split by such passes, the
rows of smaller ones are dealt to tasks that grow what is below. Its nodes are a stored table, of
which the driver reads one set's trees when they score. Rows are drawn by a hash of their key, so
trees depend neither on the partitioning nor on the batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenura.operators.encoded import (
    Block, Blocks, Encoded, FillSet, _lists, block_record, code_type, dense, drawn, filled_codes,
    in_blocks, keys_of, mixed, opened, read, stored_blocks, summed_blocks,
)
from tenura.operators.forest_model import Compressed, narrow
from tenura.sources.scratch import drop, materialize, release

# Rounds after which the margins of all rows are stored anew.
ROUNDS_KEPT = 10
# Sums of one pass over a forest's nodes, at most; passes that run side by side.
CELLS = 1 << 18
PASSES = 4
# Drawn rows of a node that one task takes to grow the tree below it, at most.
IN_TASK = 1 << 18
# Trees of each fit set that grow together, and nodes split by passes that the driver holds for them.
TREES_AT_ONCE = 25
NODES_AT_ONCE = 1 << 17
# Bytes of packed rows in a batch of shipped nodes.
SHIPPED = 1 << 22
# Gains that differ by less than this share are equal.
TIE = 1e-9
# A row counts as its draws times this, plus one: sums below 2^53 are exact and hold both.
DRAW = 1 << 26


@dataclass
class Tree:
    """Nodes in the order they were made; the right child follows the left one.

    ``col`` is the input a node splits on, or -1; codes above ``cut`` go right, for a category the
    code equal to it. ``stats`` holds what a node's rows add up to.
    """

    inputs: int  # numeric ones; inputs from there on are categories
    col: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    place: list[int] = field(default_factory=list)  # 1 for the root, then 2i and 2i + 1
    stats: list[tuple] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, place: int, stats: Sequence[float], value: float) -> int:
        self.col.append(-1)
        self.cut.append(0)
        self.left.append(0)
        self.gain.append(0.0)
        self.place.append(place)
        self.stats.append(tuple(float(s) for s in stats))
        self.value.append(float(value))
        return len(self.col) - 1

    def split(self, node: int, col: int, cut: int, gain: float, left, right, values) -> list[int]:
        self.col[node], self.cut[node], self.gain[node] = int(col), int(cut), float(gain)
        self.left[node] = len(self.col)
        return [self.add(2 * self.place[node], left, values[0]),
                self.add(2 * self.place[node] + 1, right, values[1])]


def arrays(tree: Tree) -> tuple[np.ndarray, ...]:
    return (np.array(tree.col), np.array(tree.cut), np.array(tree.left), np.array(tree.value))


def leaves(codes: np.ndarray, tree: tuple[np.ndarray, ...], inputs: int,
           depth: int) -> np.ndarray:
    """The node that each row ends in."""
    node = np.zeros(len(codes), int)
    if len(tree[0]) == 1:
        return node
    for _ in range(depth):
        node = _stepped(codes, node, tree, inputs)
    return node


def _stepped(codes: np.ndarray, node: np.ndarray, tree: tuple[np.ndarray, ...],
             inputs: int) -> np.ndarray:
    """The child that each row goes to, or the leaf it is in."""
    col, cut, left, _ = tree
    c = col[node]
    code = codes[np.arange(len(codes)), np.maximum(c, 0)]
    right = np.where(c >= inputs, code == cut[node], code > cut[node])
    return np.where(c < 0, node, left[node] + right)


# ------------------------------------------------------------------------------ boosted trees


@dataclass(frozen=True)
class Boosting:
    """Second-order boosting of the logistic loss."""

    rounds: int = 250
    depth: int = 3
    rate: float = 0.04
    row_share: float = 0.85
    column_share: float = 0.85
    penalty: float = 1.0
    least_curve: float = 1.0
    seed: int = 42


def _allowed(s: FillSet, sizes: np.ndarray, share: float, seeds: Sequence[int]) -> np.ndarray:
    """Which codes may be split on: a share of the set's features, by hash.

    A numeric input is one feature with all its codes, a known category is one.
    """
    inputs = len(s.medians)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    features = [(i, slice(offsets[i], offsets[i + 1])) for i in s.numeric]
    for j, known in enumerate(s.known):
        start = offsets[inputs + j]
        features += [(inputs + j, slice(start + c, start + c + 1)) for c in np.flatnonzero(known >= 0)]
    keep = max(1, round(share * len(features))) if features else 0
    order = np.argsort(drawn(np.arange(len(features), dtype=np.uint64), *seeds), kind="stable")
    allowed = np.zeros(offsets[-1], bool)
    for f in order[:keep]:
        allowed[features[f][1]] = True
    return allowed


def _best_by_gain(cells: np.ndarray, allowed: np.ndarray, sizes: np.ndarray, inputs: int,
                  b: Boosting) -> tuple | None:
    """(input, cut, gain, left sums, right sums) of one node's (codes, 2) sums of slope and curve."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    total = cells[offsets[0]:offsets[1]].sum(0)
    left = np.empty_like(cells)
    for i in range(len(sizes)):
        own = slice(offsets[i], offsets[i + 1])
        left[own] = np.cumsum(cells[own], 0) if i < inputs else total - cells[own]
    right = total - left

    def worth(x: np.ndarray) -> np.ndarray:
        return np.square(x[..., 0]) / (x[..., 1] + b.penalty)

    gain = worth(left) + worth(right) - worth(total)
    fits = allowed & (left[:, 1] >= b.least_curve) & (right[:, 1] >= b.least_curve)
    if not fits.any():
        return None
    gain = np.where(fits, gain, -np.inf)
    # The first of gains that only rounding tells apart.
    at = int(np.argmax(gain >= gain.max() * (1 - TIE)))
    if gain[at] <= 1e-9:
        return None
    col = int(np.searchsorted(offsets, at, side="right") - 1)
    return col, at - offsets[col], gain[at], left[at], right[at]


def _gaps(codes: np.ndarray) -> np.ndarray:
    """Which inputs have missing values."""
    return codes.min(axis=1, initial=0) < 0


def _walked(codes: np.ndarray, gaps: np.ndarray, tree: tuple[np.ndarray, ...], inputs: int,
            fills: np.ndarray) -> np.ndarray:
    """The node of a small tree that each row ends in, from codes by input with missing ones."""
    col, cut, left, _ = tree
    kind = np.int8 if len(col) < 128 else np.int32
    node = np.zeros(codes.shape[1], kind)
    # Parents stand before their children.
    for i in np.flatnonzero(col >= 0):
        c, at = col[i], cut[i]
        right = codes[c] == at if c >= inputs else codes[c] > at
        if gaps[c]:
            right = np.where(codes[c] < 0, fills[c] == at if c >= inputs else fills[c] > at, right)
        # Rows of node i go to its left child or the one behind that.
        node += (node == i).astype(kind) * (right.astype(kind) + kind(left[i] - i))
    return node


def _add_histograms(total: np.ndarray, codes: np.ndarray, at: np.ndarray,
                    values: Sequence[np.ndarray], sizes: np.ndarray, bins: int,
                    fills: np.ndarray) -> None:
    """Add every input's sums of ``values`` by node and code to ``total`` (nodes, codes, values).

    Missing codes count as the fill, and not at all where there is none.
    """
    base, start = at.astype(np.intp) * bins + 1, 0
    for c, size in enumerate(sizes):
        cells = base + codes[c]
        for v, value in enumerate(values):
            found = np.bincount(cells, value, len(total) * bins).reshape(len(total), bins)
            total[:, start:start + size, v] += found[:, 1:size + 1]
            if fills[c] >= 0:
                total[:, start + fills[c], v] += found[:, 0]
        start += size


def boost(rows: Encoded, weights: dict[str, tuple[float, float]], b: Boosting = Boosting()
          ) -> tuple[dict[str, list[Tree]], DataFrame]:
    """(trees per fit set, key, label, part and margins of all rows).

    Margins stand beside the rows: one per fit set, for rows inside and outside the set alike.
    Every pass adds the trees made since they were stored, and sums slopes and curvatures of the
    growing trees of all sets.
    """
    sizes, inputs, names = rows.sizes(), len(rows.numeric), rows.names
    codes_in_all, sets = int(sizes.sum()), [rows.sets[s] for s in rows.names]
    offsets = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    pairs = [weights[s] for s in names]
    made: list[list[Tree]] = [[] for _ in names]
    kind, bins = code_type(rows), int(sizes.max()) + 1
    fills = [np.concatenate((s.median_bins, s.modes)) for s in sets]
    state = in_blocks(rows, len(names), keys=True)

    def margins_of(block: Block, recent) -> np.ndarray:
        margins, gaps = block.margins.copy(), _gaps(block.codes)
        for k, trees in enumerate(recent):
            for tree in trees:
                margins[k] += tree[3].take(_walked(block.codes, gaps, tree, inputs, fills[k]))
        return margins

    def stored(state: Blocks, recent) -> Blocks:
        def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in opened(batches, kind):
                yield block_record(replace(block, margins=margins_of(block, recent)))

        return stored_blocks(state.table.mapInArrow(renew, state.table.schema), "margins")

    def by_row(state: Blocks) -> DataFrame:
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in opened(batches, kind):
                yield pa.RecordBatch.from_arrays(
                    [keys_of(block), pa.array(block.label), pa.array(block.part),
                     _lists(np.ascontiguousarray(block.margins.T), pa.float64())],
                    names=["key", "label", "part", "margins"])

        own = rows.rows.schema
        schema = T.StructType([own["key"], own["label"], own["part"],
                               T.StructField("margins", T.ArrayType(T.DoubleType()))])
        return materialize(state.table.mapInArrow(unpack, schema), "margins")

    recent: list[list[tuple]] = [[] for _ in names]
    for round_ in range(b.rounds):
        growing = [Tree(inputs) for _ in names]
        active = [[t.add(1, (0.0, 0.0), 0.0)] for t in growing]
        allowed = [_allowed(s, sizes, b.column_share, (b.seed, round_, k))
                   for k, s in enumerate(sets)]
        for _ in range(b.depth):
            nodes = [(k, node) for k, found in enumerate(active) for node in found]
            if not nodes:
                break
            slot = [np.full(len(t.col), -1) for t in growing]
            for i, (k, node) in enumerate(nodes):
                slot[k][node] = i
            partly, before = [arrays(t) for t in growing], [list(r) for r in recent]

            def partial(blocks, partly=partly, before=before, slot=slot, n=len(nodes),
                        round_=round_):
                total = np.zeros((n * codes_in_all, 2))
                for block in blocks:
                    gaps, margins = _gaps(block.codes), margins_of(block, before)
                    wide = block.codes.astype(np.intp)
                    taken = drawn(block.key_hash, b.seed, round_) < b.row_share
                    for k, s in enumerate(sets):
                        if not (slot[k] >= 0).any():
                            continue
                        at = slot[k].take(_walked(block.codes, gaps, partly[k], inputs, fills[k]))
                        mine = taken & s.member[block.part] & (at >= 0)
                        if not mine.any():
                            continue
                        p = 1 / (1 + np.exp(-margins[k]))
                        w = np.where(block.label == 1, pairs[k][1], pairs[k][0])
                        values = [np.where(mine, v, 0.0) for v in (
                            w * (p - block.label), w * p * (1 - p))]
                        _add_histograms(total.reshape(n, codes_in_all, 2), wide,
                                        np.where(mine, at, 0), values, sizes, bins, fills[k])
                return total

            sums = dense(*summed_blocks(state, kind, partial, 2, len(nodes) * codes_in_all), 0,
                         len(nodes) * codes_in_all)
            sums = sums.reshape(len(nodes), codes_in_all, 2)
            active = [[] for _ in names]
            for (k, node), cells in zip(nodes, sums):
                tree = growing[k]
                if node == 0:
                    root = cells[:sizes[0]].sum(0)
                    tree.stats[0] = tuple(root)
                    tree.value[0] = -b.rate * root[0] / (root[1] + b.penalty)
                best = _best_by_gain(cells, allowed[k], sizes, inputs, b)
                if best:
                    col, cut, gain, left, right = best
                    values = [-b.rate * x[0] / (x[1] + b.penalty) for x in (left, right)]
                    active[k] += tree.split(node, col, cut, gain, left, right, values)
        for k, tree in enumerate(growing):
            made[k].append(tree)
            recent[k].append(arrays(tree))
        if (round_ + 1) % ROUNDS_KEPT == 0 or round_ + 1 == b.rounds:
            before, state = state, stored(state, recent)
            drop(before.table)
            recent = [[] for _ in names]
            release(rows.rows.sparkSession)
    return dict(zip(names, made)), by_row(state)


# ------------------------------------------------------------------------------------ forests


@dataclass(frozen=True)
class Forest:
    """Trees on Poisson draws of the rows, split by weighted Gini impurity."""

    trees: int = 350
    depth: int = 12
    min_leaf: int = 5
    seed: int = 42


def _poisson(u: np.ndarray) -> np.ndarray:
    """Poisson(1) draws from uniform ones."""
    steps = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 12.0)))))
    return np.searchsorted(steps, u, side="right")


def _slots(sets: Sequence[FillSet], k: np.ndarray, t: np.ndarray, place: np.ndarray,
           seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, categories) that each node may split on: the square root of the features, by hash.

    Nodes are named by fit set, tree and place in the tree. Where a set has fewer features than
    another, its first one fills the slots left.
    """
    takes = [_taken(s) for s in sets]
    cols = np.zeros((len(k), max(takes)), int)
    cats = np.zeros_like(cols)
    with np.errstate(over="ignore"):
        salt = mixed(place.astype(np.uint64) + (t.astype(np.uint64) << np.uint64(24))
                     + (k.astype(np.uint64) << np.uint64(48))
                     + mixed(np.array([seed + 1], np.uint64)))
        for i in np.unique(k):
            s, mine = sets[i], np.flatnonzero(k == i)
            features = [(c, 0) for c in s.numeric]
            for j, known in enumerate(s.known):
                features += [(len(s.medians) + j, c) for c in np.flatnonzero(known >= 0)]
            table = np.array(features, int).reshape(-1, 2)
            keys = mixed(salt[mine, None] + np.arange(1, len(table) + 1, dtype=np.uint64)
                         * np.uint64(0x9E3779B97F4A7C15))
            chosen = np.argsort(keys, axis=1, kind="stable")[:, :takes[i]]
            chosen = np.sort(np.pad(chosen, ((0, 0), (0, cols.shape[1] - takes[i])), "edge"), axis=1)
            cols[mine], cats[mine] = table[chosen, 0], table[chosen, 1]
    return cols, cats


def _taken(s: FillSet) -> int:
    return max(1, int(np.sqrt(len(s.preprocessing.feature_names))))


@dataclass(frozen=True)
class Layout:
    """Inputs as one row of features: the codes of numeric inputs, then 0 or 1 for each category."""

    inputs: int
    starts: np.ndarray  # by categorical input: the feature of its code 0
    width: int
    kind: type

    def feature(self, col: np.ndarray, code: np.ndarray) -> np.ndarray:
        starts = np.append(self.starts, 0)
        return np.where(col < self.inputs, col, starts[np.maximum(col - self.inputs, 0)] + code)

    def spread(self, codes: np.ndarray, sets: Sequence[FillSet]) -> list[np.ndarray]:
        """For every set the features of all rows, one after another, from codes by input.

        Missing codes are filled by set; a block without any is spread once.
        """
        out = np.zeros((codes.shape[1], self.width), self.kind)
        for i, code in enumerate(codes):
            self._put(out, i, slice(None) if i < self.inputs else np.flatnonzero(code >= 0), code)
        gaps = [np.flatnonzero(code < 0) for code in codes]
        found = []
        for s in sets:
            own = out.copy() if any(map(len, gaps)) else out
            for i, (fill, at) in enumerate(zip(np.concatenate((s.median_bins, s.modes)), gaps)):
                if len(at) and fill >= 0:
                    self._put(own, i, at, np.full(codes.shape[1], fill, self.kind))
            found.append(own.ravel())
        return found

    def _put(self, out: np.ndarray, i: int, at: np.ndarray | slice, code: np.ndarray) -> None:
        if i < self.inputs:
            out[at, i] = code[at]
        else:
            out[at, self.starts[i - self.inputs] + code[at]] = 1

    def steps(self, tree: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """(feature, number, left) of every node: more than ``number`` goes right; leaves go to themselves."""
        col, cut, left, _ = tree
        leaf = col < 0
        number = np.where(leaf, np.iinfo(self.kind).max, np.where(col < self.inputs, cut, 0))
        return (np.where(leaf, 0, self.feature(col, cut)), number.astype(self.kind),
                np.where(leaf, np.arange(len(col)), left))


def _layout(rows: Encoded) -> Layout:
    inputs, sizes = len(rows.numeric), rows.sizes()
    ends = inputs + np.cumsum(sizes[inputs:])
    return Layout(inputs, (ends - sizes[inputs:]).astype(int),
                  int(ends[-1]) if len(ends) else inputs, code_type(rows))


def _routed(flat: np.ndarray, base: np.ndarray, steps: tuple[np.ndarray, ...], depth: int,
            node: np.ndarray | None = None) -> np.ndarray:
    """The node that each row is in after ``depth`` steps; ``base`` is where its features begin."""
    feature, number, left = steps
    if node is None:
        node = np.zeros(len(base), np.intp)
        if len(left) == 1:
            return node
    for _ in range(depth):
        right = flat.take(base + feature.take(node)) > number.take(node)
        node = left.take(node) + right
    return node


def _forest_sums(flat: np.ndarray, base: np.ndarray, one: np.ndarray, weight: np.ndarray,
                 pair: tuple[float, float], at: np.ndarray, features: np.ndarray,
                 bins: int) -> np.ndarray:
    """(nodes, slots, bins, 3): weight of both classes and drawn rows of every bin.

    ``one`` is 1 for rows of class 1, else 0, and ``weight`` the draws as multiples of DRAW, plus 1.
    """
    nodes, slots = features.shape
    out, first = np.empty((nodes, slots, bins, 3)), at * (2 * bins) + one
    # Slot by slot: what a step makes stays in the processor's cache.
    for i in range(slots):
        cells = flat.take(features[:, i].take(at) + base).astype(np.intp)
        cells *= 2
        cells += first
        held = np.bincount(cells, weight, 2 * nodes * bins).reshape(nodes, bins, 2)
        draws = np.floor(held / DRAW)
        out[:, i, :, :2] = draws * pair
        out[:, i, :, 2] = (held - DRAW * draws).sum(2)
    return out


def _choose(sums: np.ndarray, f: Forest) -> tuple[np.ndarray, ...]:
    """For every node: all sums, whether it splits, slot, bin, gain, sums left and right."""
    total = sums[:, 0].sum(1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = total[:, None, None] - left

    def purity(x: np.ndarray) -> np.ndarray:
        w = x[..., 0] + x[..., 1]
        return (np.square(x[..., 0]) + np.square(x[..., 1])) / np.where(w > 0, w, 1)

    gain = purity(left) + purity(right) - purity(total)[:, None, None]
    # Rows that were drawn count once, however often they were.
    fits = (np.rint(left[..., 2]) >= f.min_leaf) & (np.rint(right[..., 2]) >= f.min_leaf)
    flat = np.where(fits, gain, -np.inf).reshape(len(sums), -1)
    # The first of gains that only rounding tells apart.
    best = (flat >= flat.max(1)[:, None] * (1 - TIE)).argmax(1)
    at = np.arange(len(sums))
    slot, cut = np.divmod(best, gain.shape[2])
    splits = flat[at, best] > 1e-9 * np.maximum(total[:, 0] + total[:, 1], 1e-300)
    return total, splits, slot, cut, flat[at, best], left[at, slot, cut], right[at, slot, cut]


def _grow_level(tree: Tree, nodes: Sequence[int], chosen: list[np.ndarray], f: Forest) -> list[int]:
    """Split the nodes where it pays; returns the children that may split again."""
    total, splits, col, cut, gain, left, right = chosen
    if len(tree.col) == 1:
        tree.stats[0], tree.value[0] = tuple(total[0]), _rate(total[0])
    again = []
    for i in np.flatnonzero(splits):
        children = (left[i], right[i])
        made = tree.split(nodes[i], col[i], cut[i], gain[i], *children, [_rate(c) for c in children])
        again += [m for m, c in zip(made, children)
                  if np.rint(c[2]) >= 2 * f.min_leaf and min(c[0], c[1]) > 0]
    return again


def _rate(stats: Sequence[float]) -> float:
    w = stats[0] + stats[1]
    return stats[1] / w if w > 0 else 0.0


def _passes(jobs: list[tuple], rows: Encoded, slots: dict[int, int], bins: int,
            cells: int) -> list[list[tuple]]:
    """Growing nodes, by tree, in runs of about ``cells`` sums at most.

    A tree's level has no more sums than its nodes have bins, nor than its rows have slots. A tree
    with more nodes than a run holds goes through in several.
    """
    drawn_rows = {k: int(0.64 * s.preprocessing.rows) + 1 for k, s in
                  enumerate(rows.sets.values())}
    runs, room = [[]], cells
    for (k, t), nodes in jobs:
        most = max(1, cells // (slots[k] * bins))
        for start in range(0, len(nodes), most):
            part = nodes[start:start + most]
            need = min(len(part) * slots[k] * bins, drawn_rows[k] * slots[k])
            if need > room and runs[-1]:
                runs.append([])
                room = cells
            runs[-1].append(((k, t), part))
            room -= need
    return [r for r in runs if r]


def _node_fields() -> list[T.StructField]:
    return [T.StructField("k", T.IntegerType()), T.StructField("t", T.IntegerType()),
            T.StructField("place", T.IntegerType()), T.StructField("col", T.IntegerType()),
            T.StructField("cut", T.IntegerType()), T.StructField("gain", T.DoubleType()),
            *[T.StructField(f"s{i}", T.DoubleType()) for i in range(3)],
            T.StructField("value", T.DoubleType())]


_NODES = T.StructType(_node_fields())
_DOUBLES = [x.name for x in _NODES if x.dataType == T.DoubleType()]


def _node_rows(k: int, t: int, tree: Tree, kept: Sequence[int]) -> pa.Table:
    """Some nodes of a tree as rows of the stored table."""
    at = np.asarray(kept, int)
    stats = np.array(tree.stats, float).reshape(-1, 3)[at]
    columns = [np.full(len(at), k, np.int32), np.full(len(at), t, np.int32),
               *[np.array(c, np.int32)[at] for c in (tree.place, tree.col, tree.cut)],
               np.array(tree.gain, float)[at], *stats.T, np.array(tree.value, float)[at]]
    return pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], names=_NODES.names)


def _grow_below(codes: np.ndarray, one: np.ndarray, draws: np.ndarray, pair: tuple[float, float],
                k: int, t: int, place: int, sets: Sequence[FillSet], layout: Layout, bins: int,
                f: Forest, cells: int) -> Tree:
    """The tree below one node from the node's drawn rows."""
    tree = Tree(layout.inputs)
    flat, one = layout.spread(codes, [sets[k]])[0], one.astype(np.intp)
    base, weight = np.arange(len(one)) * layout.width, draws * float(DRAW) + 1
    # Rows of nodes that may still split, and where they are.
    active, node = [tree.add(place, (0.0, 0.0, 0.0), 0.0)], np.zeros(len(one), np.intp)
    for _ in range(f.depth - (place.bit_length() - 1)):
        if not active:
            break
        ids = [np.full(len(active), i, np.int64) for i in (k, t)]
        cols, cats = _slots(sets, *ids, np.array([tree.place[a] for a in active], np.int64), f.seed)
        features = layout.feature(cols, cats)
        step, chosen = max(1, cells // (cols.shape[1] * bins)), []
        slot = np.full(len(tree.col), -1)
        slot[active] = np.arange(len(active))
        at = slot.take(node)
        for i in range(0, len(active), step):
            own = slice(None) if step >= len(active) else np.flatnonzero((at >= i) & (at < i + step))
            chosen.append(_choose(_forest_sums(flat, base[own], one[own], weight[own], pair,
                                               at[own] - i, features[i:i + step], bins), f))
        total, splits, slot, cut, gain, left, right = (np.concatenate(c) for c in zip(*chosen))
        col = cols[np.arange(len(active)), slot]
        cut = np.where(col >= layout.inputs, cats[np.arange(len(active)), slot], cut)
        active = _grow_level(tree, active, [total, splits, col, cut, gain, left, right], f)
        again = np.zeros(len(tree.col), bool)
        again[active] = True
        node = _routed(flat, base, layout.steps(arrays(tree)), 1, node)
        kept = np.flatnonzero(again.take(node))
        base, one, weight, node = base[kept], one[kept], weight[kept], node[kept]
    return tree


def _pass_sums(rows: Encoded, blocks: Blocks, run: list[tuple], out: dict[tuple[int, int], Tree], level: int,
               pairs: Sequence[tuple[float, float]], bins: int, f: Forest, cells: int) -> list[tuple]:
    """One pass over all rows that splits the nodes of ``run``; the children that may split again."""
    inputs, sets = len(rows.numeric), list(rows.sets.values())
    sizes = np.array([len(nodes) for _, nodes in run])
    ends = np.cumsum(sizes)
    k, t = (np.repeat([job[i] for job, _ in run], sizes) for i in (0, 1))
    place = np.array([out[job].place[a] for job, nodes in run for a in nodes], np.int64)
    cols, cats = _slots(sets, k, t, place, f.seed)
    per_node, layout = cols.shape[1] * bins, _layout(rows)
    features, plans = layout.feature(cols, cats), []
    for (job, nodes), end in zip(run, ends):
        slot = np.full(len(out[job].col), -1)
        slot[nodes] = np.arange(len(nodes))
        plans.append((*job, slot, layout.steps(arrays(out[job]))))
    spans = [slice(e - n, e) for e, n in zip(ends, sizes)]

    def partial(found: Iterator[Block]) -> np.ndarray:
        total = np.zeros((len(features), per_node, 3))
        for block in found:
            flats, one = layout.spread(block.codes, sets), (block.label == 1).astype(np.intp)
            inside = [s.member[block.part] for s in sets]
            draws_of = {x: _poisson(drawn(block.key_hash, f.seed, x)) for x in {p[1] for p in plans}}
            weights = {x: draws * float(DRAW) + 1 for x, draws in draws_of.items()}
            for (k, t, slot, steps), span in zip(plans, spans):
                mine = np.flatnonzero(inside[k] & (draws_of[t] > 0))
                at = slot.take(_routed(flats[k], mine * layout.width, steps, level))
                there = at >= 0
                if not there.all():
                    mine, at = mine[there], at[there]
                if len(mine):
                    total[span] += _forest_sums(
                        flats[k], mine * layout.width, one[mine], weights[t][mine], pairs[k], at,
                        features[span], bins).reshape(-1, per_node, 3)
        return total.reshape(-1, 3)

    places, sums = summed_blocks(blocks, code_type(rows), partial, 3, len(k) * per_node)
    again = []
    # Some thousand nodes at a time.
    step = max(1, cells // per_node)
    chosen = [_choose(dense(places, sums, i * per_node, min(step, len(k) - i) * per_node)
                      .reshape(-1, cols.shape[1], bins, 3), f) for i in range(0, len(k), step)]
    total, splits, slot, cut, gain, left, right = (np.concatenate(c) for c in zip(*chosen))
    col = cols[np.arange(len(k)), slot]
    cut = np.where(col >= inputs, cats[np.arange(len(k)), slot], cut)
    for (job, nodes), span in zip(run, spans):
        own = [c[span] for c in (total, splits, col, cut, gain, left, right)]
        again.append((job, _grow_level(out[job], nodes, own, f)))
    return again


def _ship(rows: Encoded, blocks: Blocks, open_nodes: dict[tuple[int, int], list[int]],
          out: dict[tuple[int, int], Tree], f: Forest) -> DataFrame:
    """k, t, place, n, packed: the drawn rows of open nodes, one record per node and block."""
    layout, sets, kind = _layout(rows), list(rows.sets.values()), code_type(rows)
    plans = []
    for (k, t), nodes in open_nodes.items():
        tree = out[k, t]
        slot = np.full(len(tree.col), -1)
        slot[nodes] = np.arange(len(nodes))
        plans.append((k, t, slot, layout.steps(arrays(tree)), [tree.place[n] for n in nodes],
                      max(tree.place).bit_length() - 1))
    schema = T.StructType([*_node_fields()[:3], T.StructField("n", T.IntegerType()),
                           T.StructField("packed", T.BinaryType())])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for block in opened(batches, kind):
            flats, inside = layout.spread(block.codes, sets), [s.member[block.part] for s in sets]
            draws_of = {x: _poisson(drawn(block.key_hash, f.seed, x)) for x in {p[1] for p in plans}}
            codes, one = np.ascontiguousarray(block.codes.T), block.label == 1
            for k, t, slot, steps, places, depth in plans:
                mine = np.flatnonzero(inside[k] & (draws_of[t] > 0))
                at = slot.take(_routed(flats[k], mine * layout.width, steps, depth))
                order = np.argsort(at, kind="stable")
                ends = np.searchsorted(at[order], np.arange(len(places) + 1))
                for place, low, high in zip(places, ends, ends[1:]):
                    if low == high:
                        continue
                    own = mine[order[low:high]]
                    packed = _packed(codes[own], one[own], draws_of[t][own])
                    found.append((k, t, place, high - low, packed))
                    held += len(packed)
                if held > SHIPPED:
                    yield _records(found, schema)
                    found, held = [], 0
        if found:
            yield _records(found, schema)

    return blocks.table.mapInArrow(ship, schema)


def _records(found: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = [*[pa.int32()] * 4, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), kinds)],
                                      names=schema.names)


def _packed(codes: np.ndarray, one: np.ndarray, draws: np.ndarray) -> bytes:
    """Rows column by column, compressed."""
    raw = (np.ascontiguousarray(codes.T).tobytes() + one.astype(np.int8).tobytes()
           + draws.astype(np.int8).tobytes())
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int, width: int, kind: type) -> tuple[np.ndarray, ...]:
    size = np.dtype(kind).itemsize * width * n
    raw = pa.decompress(packed, decompressed_size=size + 2 * n, codec="zstd", asbytes=True)
    codes = np.frombuffer(raw, kind, width * n).reshape(width, n)
    one, draws = np.frombuffer(raw, np.int8, 2 * n, size).reshape(2, n)
    return codes, one, draws


def _grow_in_tasks(rows: Encoded, shipped: DataFrame, pairs: Sequence[tuple[float, float]],
                   bins: int, f: Forest, cells: int, tasks: int) -> DataFrame:
    """The nodes below every shipped node, itself included."""
    layout, sets = _layout(rows), list(rows.sets.values())
    width, kind = len(rows.sizes()), code_type(rows)

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        k, t, place = (v.as_py() for v in key)
        parts = [_unpacked(p.as_py(), n.as_py(), width, kind)
                 for p, n in zip(table.column("packed"), table.column("n"))]
        codes, one, draws = (np.concatenate(x, axis=-1) for x in zip(*parts))
        tree = _grow_below(codes, one, draws, pairs[k], k, t, place, sets, layout, bins, f, cells)
        return _node_rows(k, t, tree, range(len(tree.col)))

    by = ["k", "t", "place"]
    return shipped.repartition(tasks, *by).groupBy(*by).applyInArrow(grow, _NODES)


@dataclass(frozen=True)
class CodedNodes(Compressed):
    """What ``leaves`` needs of some trees; tree i has the nodes ``ends[i]`` to ``ends[i + 1]``.

    Inner nodes have no value.
    """

    ends: np.ndarray
    col: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def trees(self) -> Iterator[tuple[np.ndarray, ...]]:
        for low, high in zip(self.ends, self.ends[1:]):
            yield tuple(v[low:high] for v in (self.col, self.cut, self.left, self.value))


class Forests(Mapping):
    """The forests of all fit sets as stored tables; a set's trees are read when they are asked for.

    ``tables`` holds the nodes of ``at_once`` trees of every set each.
    """

    def __init__(self, names: Sequence[str], tables: Sequence[DataFrame], at_once: int, trees: int,
                 inputs: int):
        self.names, self.tables, self.at_once = list(names), list(tables), at_once
        self.trees, self.inputs = trees, inputs

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def __getitem__(self, name: str) -> list[Tree]:
        return [self._tree(own) for own in self.each(name, _NODES.names[2:])]

    def each(self, name: str, columns: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
        """Columns of a set's trees, one after another, by place; ``place`` and ``col`` are among them."""
        if not self.tables:
            yield from (_bare(columns) for _ in range(self.trees))
        k = self.names.index(name)
        for i, stored in enumerate(self.tables):
            trees = range(i * self.at_once, min((i + 1) * self.at_once, self.trees))
            table = stored.where(F.col("k") == k).select("t", *columns).toArrow()
            found = {c: table.column(c).to_numpy() for c in table.column_names}
            order = np.lexsort((found["place"], found["t"]))
            found = {c: v[order] for c, v in found.items()}
            ends = np.searchsorted(found["t"], np.arange(trees[0], trees[-1] + 2))
            for low, high in zip(ends, ends[1:]):
                # No node is stored of a tree without rows.
                yield ({c: found[c][low:high].copy() for c in columns} if low < high
                       else _bare(columns))

    def packed(self, name: str) -> CodedNodes:
        """A set's trees in few bytes a node."""
        ends, parts = [0], []
        for own in self.each(name, ["place", "col", "cut", "value"]):
            parts.append((own["col"].astype(np.int16), own["cut"].astype(np.int16),
                          narrow(left_children(own)), np.where(own["col"] < 0, own["value"], 0.0)))
            ends.append(ends[-1] + len(own["col"]))
        columns = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0, np.int16)] * 4
        return CodedNodes(np.array(ends), *columns)

    def _tree(self, own: dict[str, np.ndarray]) -> Tree:
        stats = list(zip(*(own[f"s{i}"].tolist() for i in range(3))))
        return Tree(self.inputs, own["col"].tolist(), own["cut"].tolist(),
                    left_children(own).tolist(), own["gain"].tolist(), own["place"].tolist(),
                    stats, own["value"].tolist())


def _bare(columns: Sequence[str]) -> dict[str, np.ndarray]:
    """A tree of one leaf that no row has reached."""
    return {c: np.array([{"place": 1, "col": -1}.get(c, 0)], float if c in _DOUBLES else np.int32)
            for c in columns}


def left_children(own: dict[str, np.ndarray]) -> np.ndarray:
    """The index of every node's left child among nodes by place; 0 for a leaf."""
    place, col = own["place"].astype(np.int64), own["col"]
    return np.where(col < 0, 0, np.searchsorted(place, 2 * place)).astype(np.int32)


def grow_forest(rows: Encoded, weights: dict[str, tuple[float, float]], f: Forest = Forest(),
                cells: int = CELLS, in_task: int = IN_TASK) -> Forests:
    """The forests of all fit sets, some trees of each at a time.

    Nodes of more than ``in_task`` drawn rows are split level by level, in passes of at most
    ``cells`` sums each. The rows of the others go to a task each, which grows the tree below.
    """
    inputs, sets = len(rows.numeric), list(rows.sets.values())
    if not inputs + len(rows.categorical):
        return Forests(rows.names, [], 1, f.trees, inputs)
    spark = rows.rows.sparkSession
    bins = int(max([2, *rows.sizes()[:inputs]]))
    pairs = [weights[s] for s in rows.names]
    slots = {k: _taken(s) for k, s in enumerate(sets)}
    counts = [s.preprocessing.rows for s in sets]
    split_by_passes = sum(min(2 << f.depth, 4 * n // max(in_task, 1) + 1) for n in counts)
    at_once = max(1, min(TREES_AT_ONCE, NODES_AT_ONCE // max(split_by_passes, 1)))
    tables, blocks = [], in_blocks(rows)
    with ThreadPool(PASSES) as pool:
        for first in range(0, f.trees, at_once):
            trees = range(first, min(first + at_once, f.trees))
            out = {(k, t): Tree(inputs) for t in trees for k in range(len(sets))}
            active = {job: [tree.add(1, (0.0, 0.0, 0.0), 0.0)] for job, tree in out.items()}
            shipped: dict[tuple[int, int], list[int]] = {}
            # About 0.63 of the rows are drawn for a tree; the roots' own counts aren't known yet.
            for job in [job for job in active if 0.7 * counts[job[0]] <= in_task]:
                shipped[job] = active.pop(job)
            for level in range(f.depth):
                jobs = [(job, nodes) for job, nodes in active.items() if nodes]
                if not jobs:
                    break
                active = {}
                runs = _passes(jobs, rows, slots, bins, cells)
                # Runs of one tree follow each other, so that its nodes are made in order.
                grow_all = inheritable_thread_target(spark)(lambda group, level=level, out=out: [
                    x for run in group
                    for x in _pass_sums(rows, blocks, run, out, level, pairs, bins, f, cells)])
                for found in pool.imap(grow_all, _by_tree(runs)):
                    for job, nodes in found:
                        stats = out[job].stats
                        for n in nodes:
                            # The deepest nodes are leaves and need no rows.
                            small = level + 1 < f.depth and stats[n][2] <= in_task
                            (shipped if small else active).setdefault(job, []).append(n)
            done = []
            for (k, t), tree in out.items():
                kept = np.setdiff1d(np.arange(len(tree.col)), shipped.get((k, t), []))
                if len(kept):
                    done.append(_node_rows(k, t, tree, kept))
            made = []
            if done:
                made.append(spark.createDataFrame(pa.concat_tables(done), _NODES))
            if shipped:
                drawn_rows = sum(0.64 * counts[k] for k, _ in shipped)
                tasks = max(spark.sparkContext.defaultParallelism, int(drawn_rows) >> 21)
                made.append(_grow_in_tasks(rows, _ship(rows, blocks, shipped, out, f), pairs,
                                           bins, f, cells, tasks))
            tables.append(materialize(reduce(DataFrame.unionByName, made), "forest"))
            release(spark)
    drop(blocks.table)
    return Forests(rows.names, tables, at_once, f.trees, inputs)


def _by_tree(runs: list[list[tuple]]) -> list[list[list[tuple]]]:
    """Runs grouped so that no tree is in two groups."""
    groups: list[list[list[tuple]]] = []
    for run in runs:
        if groups and groups[-1][-1][-1][0] == run[0][0]:
            groups[-1].append(run)
        else:
            groups.append([run])
    return groups


def forest_scores(rows: Encoded, set_name: str, grown: Forests, parts: Sequence[int],
                  depth: int) -> DataFrame:
    """key, label, p of the rows of some parts: the mean rate of the leaves they end in.

    Stored, so that only one set's trees are on the way at a time.
    """
    inputs, s = len(rows.numeric), rows.sets[set_name]
    packed = grown.packed(set_name)
    schema = T.StructType([rows.rows.schema["key"], rows.rows.schema["label"],
                           T.StructField("p", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in batches:
            if not raw.num_rows:
                continue
            batch = read(raw)
            codes, total = filled_codes(batch.codes, s), np.zeros(raw.num_rows)
            for tree in packed.trees():
                total += tree[3][leaves(codes, tree, inputs, depth)]
            yield pa.RecordBatch.from_arrays(
                [batch.key, pa.array(batch.label), pa.array(total / max(len(packed.ends) - 1, 1))],
                names=["key", "label", "p"])

    scored = rows.rows.where(F.col("part").isin(*parts)).mapInArrow(score, schema)
    return materialize(scored, "forest-scores")
