"""Gradient-boosted regression trees on binned features: histograms of gradients, leaf-limited or depth-limited growth, L1 and L2 penalties.

The features are binned once, by a mergeable weighted quantile summary per feature. A round asks for the histograms of gradient and
hessian of all leaves that growth may need next, in one pass over the rows; a split's larger child is its parent less its smaller
child. Growth is best first: leaves are split in the order of their gain until the limit is reached. Which leaves that are is
played through on what is known, and one pass answers for all leaves it wants to open, so a tree takes about as many passes as it is deep.

Rows lie in blocks of ``block_rows``. A pass sums each task's histograms over its blocks, then the tasks' by leaf and feature; the sum has
one number per leaf and bin, whatever the rows, and the splits are chosen from it. Predictions so far are stored with the blocks every ``KEPT`` rounds
and carried on from there. A table of one block has nothing to merge: its rounds run in the task that holds the block.

Gradients are rounded to a grid on which sums of doubles are exact. With row and column samples drawn by hashes of the rows and
numbers, the trees do not depend on how the rows are partitioned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.operators.tree_model import TREES, TreeEnsemble, draw, table, tree_batch
from pastward.schema import TARGET
from pastward.session import staged

BLOCK_ROWS = 1 << 17
KEPT = 16  # rounds between two writings of the predictions so far
SKETCH = 4096  # entries of a quantile summary
FAN_IN = 64  # summaries that are merged at once
FLAT = 1 << 17  # cells of a histogram pass that are counted in one go
EPS = 1e-9


# quantile summaries


def merged(parts: list[tuple[np.ndarray, np.ndarray]], size: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights, in order, from several such lists; beyond ``size`` entries neighbours share one.

    An entry stands for all values after the entry before it, up to its own. Sharing moves a rank by a ``size``-th of the weight at most.
    """
    values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    weights = np.bincount(at, np.concatenate([w for _, w in parts]), len(values))
    if len(values) > size:
        upto = np.cumsum(weights)
        ends = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, size + 1) / size).clip(max=len(values) - 1))
        values, weights = values[ends], np.diff(upto[ends], prepend=0.0)
    return values, weights


def cuts_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Upper ends of all bins but the last: every value its own bin where there are few, else bins of about equal weight."""
    if len(values) <= bins:
        return values[:-1]
    upto = np.cumsum(weights)
    ends = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins))
    return values[ends[ends < len(values) - 1]]


# rows in memory


@dataclass
class Layout:
    """Bins of all features on one axis."""

    cuts: list[np.ndarray]

    def __post_init__(self) -> None:
        sizes = np.array([len(c) + 1 for c in self.cuts])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.bins = int(self.first[-1])
        self.feature = np.repeat(np.arange(len(sizes)), sizes)
        self.inner = np.ones(self.bins, bool)
        self.inner[self.first[1:] - 1] = False

    def coded(self, x: np.ndarray) -> np.ndarray:
        """Places on the axis, one row per feature; missing values fall into the last bin."""
        codes = np.empty((len(self.cuts), len(x)), np.int32)
        for f, cuts in enumerate(self.cuts):
            codes[f] = np.searchsorted(cuts, x[:, f], side="left") + self.first[f]
        return codes


@dataclass
class Tree:
    """A tree while it grows. Nodes below a final leaf may be known already; ``value`` counts for final leaves alone."""

    layout: Layout
    feature: list[int]
    place: list[int]
    left: list[int]
    right: list[int]
    depth: list[int]
    path: list[str]
    sums: list[tuple[float, float]]
    split: list[tuple[float, int, float, float] | None]  # gain, place, and the left child's sums

    @classmethod
    def root(cls, layout: Layout) -> Tree:
        tree = cls(layout, [], [], [], [], [], [], [], [])
        tree.add(0, "", (0.0, 0.0))
        return tree

    def add(self, depth: int, path: str, sums: tuple[float, float]) -> int:
        for values, value in zip((self.feature, self.place, self.left, self.right, self.depth, self.path, self.sums, self.split), (-1, -1, -1, -1, depth, path, sums, None)):
            values.append(value)
        return len(self.feature) - 1

    def open(self, node: int) -> tuple[int, int]:
        _, place, g, h = self.split[node]
        whole, depth = self.sums[node], self.depth[node] + 1
        self.place[node], self.feature[node] = place, int(self.layout.feature[place])
        self.left[node] = self.add(depth, self.path[node] + "0", (g, h))
        self.right[node] = self.add(depth, self.path[node] + "1", (whole[0] - g, whole[1] - h))
        return self.left[node], self.right[node]

    def routing(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v, np.int32) for v in (self.feature, self.place, self.left, self.right))

    def final(self, splits: set[int], value: Callable[[float, float], float]) -> tuple[dict, np.ndarray]:
        """The tree as a table, with nodes numbered anew from the root, and the value of every node's final leaf."""
        names, order, todo = {}, [], [0]
        values = np.zeros(len(self.feature))
        while todo:
            node = todo.pop(0)
            names[node] = len(order)
            order.append(node)
            if node in splits:
                todo += [self.left[node], self.right[node]]
            else:
                below, own = [node], value(*self.sums[node])
                while below:
                    k = below.pop()
                    values[k] = own
                    below += [self.left[k], self.right[k]] if self.left[k] >= 0 else []
        inner = [n in splits for n in order]

        def cut(n: int) -> float:
            f = self.feature[n]
            return float(self.layout.cuts[f][self.place[n] - self.layout.first[f]])

        out = {
            "feature": np.array([self.feature[n] if s else -1 for n, s in zip(order, inner)], np.int32),
            "cut": np.array([cut(n) if s else 0.0 for n, s in zip(order, inner)]),
            "left": np.array([names[self.left[n]] if s else -1 for n, s in zip(order, inner)], np.int32),
            "right": np.array([names[self.right[n]] if s else -1 for n, s in zip(order, inner)], np.int32),
            "value": np.array([0.0 if s else values[n] for n, s in zip(order, inner)]),
            "gain": np.array([self.split[n][0] if s else 0.0 for n, s in zip(order, inner)]),
        }
        return out, values


@dataclass
class Block:
    """Rows in memory: codes by feature, targets, marks and predictions so far."""

    codes: np.ndarray
    y: np.ndarray
    mark: np.ndarray
    margin: np.ndarray

    def begin(self, p: BoostedTrees, round_: int, grid: float) -> None:
        self.at = np.zeros(len(self.y), np.int32)
        self.g = np.rint((self.margin - self.y) * grid)
        self.used = draw(self.mark, round_, p.seed) < p.rows if p.rows < 1 else np.ones(len(self.y), bool)

    def descend(self, feature, place, left, right) -> None:
        while True:
            f = feature[self.at]
            rows = np.flatnonzero(f >= 0)
            if not len(rows):
                return
            at = self.at[rows]
            goes = self.codes[f[rows], rows] <= place[at]
            self.at[rows] = np.where(goes, left[at], right[at])

    def histograms(self, nodes: list[int], known: int, bins: int) -> np.ndarray:
        """Sums of gradients and of hessians (rows, for the squared error) of each node by place on the axis."""
        slots = np.full(known, -1, np.int64)
        slots[nodes] = np.arange(len(nodes))
        slot = np.where(self.used, slots[self.at], -1)
        rows = np.flatnonzero(slot >= 0)
        out = np.zeros((2, len(nodes) * bins))
        codes, base, g = self.codes[:, rows], slot[rows] * bins, self.g[rows]
        step = max(1, FLAT // max(1, len(rows)))
        for f in range(0, len(codes), step):
            part = codes[f : f + step]
            index = (part + base).ravel()
            out[0] += np.bincount(index, np.broadcast_to(g, part.shape).ravel(), out.shape[1])
            out[1] += np.bincount(index, minlength=out.shape[1])
        return out.reshape(2, len(nodes), bins)

    def finish(self, values: np.ndarray) -> None:
        self.margin = self.margin + values[self.at]


Ask = Callable[[Tree, list[int]], np.ndarray]


@dataclass(frozen=True)
class BoostedTrees:
    """Boosting of the squared error.

    ``leaves`` and ``depth`` limit a tree (None: no limit), ``child`` is the least hessian sum of a leaf (its rows, for this error), ``l1`` and
    ``l2`` are the penalties on leaf values, ``rows`` and ``columns`` the shares drawn for each tree, ``bins`` the most bins of a feature.
    """

    rounds: int
    rate: float
    leaves: int | None = None
    depth: int | None = None
    l1: float = 0.0
    l2: float = 1.0
    child: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 256
    seed: int = 42
    block_rows: int = BLOCK_ROWS

    def shrunk(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.l1, 0.0) if self.l1 else g

    def leaf(self, g: float, h: float) -> float:
        return float(-self.rate * self.shrunk(g) / (h + self.l2)) if h > 0 else 0.0

    def chosen_columns(self, inputs: int, round_: int) -> np.ndarray:
        """Flags of the features a tree may use."""
        keep = max(1, int(self.columns * inputs))
        chosen = np.zeros(inputs, bool)
        chosen[np.argsort(draw(np.arange(inputs), round_, self.seed + 1), kind="stable")[:keep]] = True
        return chosen

    def splits(self, sums: np.ndarray, layout: Layout, columns: np.ndarray, grid: float) -> list[tuple[float, int, float, float] | None]:
        """The best split of each histogram, the first of equal ones. Only places that have rows are looked at."""
        count = sums.shape[1]
        at = np.flatnonzero(sums[1])
        node, place = np.divmod(at, layout.bins)
        segment = node * len(layout.cuts) + layout.feature[place]
        begins = np.flatnonzero(np.diff(segment, prepend=-1))
        lengths = np.diff(begins, append=len(at))

        def upto(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Sums inside each feature of a node up to each place, exact in whole numbers, and their totals."""
            run = np.cumsum(values.ravel()[at].astype(np.int64))
            before = np.concatenate([[0], run[begins[1:] - 1]])
            total = np.append(run[begins[1:] - 1], run[-1:]) - before
            return run - np.repeat(before, lengths), np.repeat(total, lengths)

        (g, whole_g), (h, whole_h) = upto(sums[0]), upto(sums[1])
        rest_h, g, whole_g = whole_h - h, g / grid, whole_g / grid
        least = max(self.child, EPS)
        fits = np.flatnonzero((h >= least) & (rest_h >= least) & columns[layout.feature[place]])
        node, place, g, h, whole_g, whole_h, rest_h = (v[fits] for v in (node, place, g, h, whole_g, whole_h, rest_h))
        own = self.shrunk(whole_g) ** 2 / (whole_h + self.l2)
        gain = self.shrunk(g) ** 2 / (h + self.l2) + self.shrunk(whole_g - g) ** 2 / (rest_h + self.l2) - own
        out: list[tuple[float, int, float, float] | None] = [None] * count
        first = np.flatnonzero(np.diff(node, prepend=-1))
        if len(first):
            most = np.repeat(np.maximum.reduceat(gain, first), np.diff(first, append=len(node)))
            best = np.flatnonzero(gain == most)
            best = best[np.flatnonzero(np.diff(node[best], prepend=-1))]
            for k in best[gain[best] > EPS * np.maximum(1.0, own[best])].tolist():
                out[int(node[k])] = (float(gain[k]), int(place[k]), float(g[k]), float(h[k]))
        return out

    def _wanted(self, tree: Tree) -> tuple[set[int], list[int]]:
        """Nodes split when growth is played through on what is known, and those among them that have to be opened first."""
        splits, unknown, leaves = set(), [], 1
        heap: list[tuple[float, str, int]] = []

        def push(node: int) -> None:
            if tree.split[node]:
                heapq.heappush(heap, (-tree.split[node][0], tree.path[node], node))

        push(0)
        while heap and (self.leaves is None or leaves < self.leaves):
            _, _, node = heapq.heappop(heap)
            splits.add(node)
            leaves += 1
            if tree.left[node] < 0:
                unknown.append(node)
            else:
                push(tree.left[node])
                push(tree.right[node])
        return splits, unknown

    def grow(self, layout: Layout, round_: int, grid: float, ask: Ask) -> tuple[Tree, dict, np.ndarray]:
        """One tree from answers about its nodes' histograms."""
        tree, columns = Tree.root(layout), self.chosen_columns(len(layout.cuts), round_)
        held: dict[int, np.ndarray] = {0: ask(tree, [0])}
        one = slice(layout.first[0], layout.first[1])  # the bins of one feature hold all rows
        tree.sums[0] = (float(held[0][0, 0, one].sum()) / grid, float(held[0][1, 0, one].sum()))
        tree.split[0] = self.splits(held[0], layout, columns, grid)[0] if self.may_split(tree, 0) else None
        while True:
            splits, unknown = self._wanted(tree)
            if not unknown:
                return tree, *tree.final(splits, self.leaf)
            pairs = [(node, *tree.open(node)) for node in unknown]
            pairs = [(node, a, b) for node, a, b in pairs if self.may_split(tree, a) or self.may_split(tree, b)]
            if not pairs:
                continue
            small = [a if tree.sums[a][1] <= tree.sums[b][1] else b for _, a, b in pairs]
            found = ask(tree, small)
            for k, (node, a, b) in enumerate(pairs):
                mine = found[:, k : k + 1]
                other = held.pop(node) - mine
                held[a], held[b] = (mine, other) if small[k] == a else (other, mine)
            children = [c for _, a, b in pairs for c in (a, b) if self.may_split(tree, c)]
            best = self.splits(np.concatenate([held[c] for c in children], axis=1), layout, columns, grid)
            for c, split in zip(children, best):
                tree.split[c] = split

    def may_split(self, tree: Tree, node: int) -> bool:
        return (self.depth is None or tree.depth[node] < self.depth) and tree.sums[node][1] >= 2 * max(self.child, EPS)

    def grid(self, n: int, width: float) -> float:
        """The power of two by which gradients are taken before they are rounded: sums of ``n`` of them stay exact."""
        return 2.0 ** math.floor(52 - math.log2(max(2.0, 4.0 * n * max(width, 1e-300))))

    # fitting

    def fit(self, prepared: DataFrame, target: str = TARGET, features: str = "features", mark: Column | None = None) -> TreeEnsemble:
        """Fit on rows with a target and an input vector; rows without a target do not count.

        ``mark`` is a whole number that tells rows apart for row samples; by default it is a hash of the row's values, so equal rows are drawn
        together. No rows give an ensemble that predicts 0.
        """
        x = vector_to_array(features)
        mark = F.xxhash64(target, x) if mark is None else mark
        rows = prepared.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), x.alias("x"), mark.cast("long").alias("mark"))
        y = F.col("y")
        facts = rows.agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.min(y).alias("low"), F.max(y).alias("high"), F.max(F.size("x")).alias("inputs")).first()
        n, width = facts["n"], (facts["high"] or 0.0) - (facts["low"] or 0.0)
        if not n:
            return TreeEnsemble([], 0, features=features)
        # the mean on a coarse grid, so that the order of its sum does not show
        unit = 2.0 ** (math.frexp(max(abs(facts["low"]), abs(facts["high"]), 1e-300))[1] - 40)
        start = (round(facts["mean"] / unit) * unit, self.grid(n, width))
        if n <= self.block_rows:
            found = rows.coalesce(1).mapInArrow(_fit_here(self, *start), TREES).collect()  # the model
            return TreeEnsemble(table(found), facts["inputs"], start[0], features=features)
        return TreeEnsemble(_fit_blocks(self, rows, facts["inputs"], *start), facts["inputs"], start[0], features=features)


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    x = rows.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, targets and marks of up to ``most`` rows at a time."""
    held: list[tuple] = []
    count = 0
    for rows in batches:
        for low in range(0, len(rows), most):
            part = rows.slice(low, most)
            if count + len(part) > most:
                yield tuple(map(np.concatenate, zip(*held)))
                held, count = [], 0
            held.append((_matrix(part), part.column("y").to_numpy(), part.column("mark").to_numpy()))
            count += len(part)
    if count:
        yield tuple(map(np.concatenate, zip(*held)))


def _fit_here(p: BoostedTrees, base: float, grid: float):
    """All rounds on the rows of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, mark in gathered(batches, p.block_rows):
            trees = boosted(p, x, y, mark, base, grid)
            yield tree_batch(trees)

    return run


def boosted(p: BoostedTrees, x: np.ndarray, y: np.ndarray, mark: np.ndarray, base: float, grid: float) -> list[dict]:
    layout = Layout([cuts_of(*merged([(x[:, f], np.ones(len(x)))]), p.bins) for f in range(x.shape[1])])
    block = Block(layout.coded(x), y, mark, np.full(len(y), base))

    def ask(tree: Tree, nodes: list[int]) -> np.ndarray:
        block.descend(*tree.routing())
        return block.histograms(nodes, len(tree.feature), layout.bins)

    trees = []
    for k in range(p.rounds):
        block.begin(p, k, grid)
        tree, found, values = p.grow(layout, k, grid, ask)
        block.descend(*tree.routing())
        block.finish(values)
        trees.append(found)
    return trees


# fitting on many blocks

BLOCKS = "codes binary, y binary, mark binary, margin binary"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for x, _, _ in gathered(batches, BLOCK_ROWS):
        new = [merged([(x[:, f], np.ones(len(x)))]) for f in range(x.shape[1])]
        held = [merged([a, b]) for a, b in zip(held, new)] if held else new
    if held:
        yield pa.RecordBatch.from_pydict({"feature": pa.array(range(len(held)), pa.int32()), "values": [v.tobytes() for v, _ in held], "weights": [w.tobytes() for _, w in held]})


def _merge_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    parts = [(np.frombuffer(v), np.frombuffer(w)) for v, w in zip(rows["values"], rows["weights"])]
    values, weights = merged(parts)
    return pd.DataFrame({"feature": [rows["feature"].iloc[0]], "part": [key[1]], "values": [values.tobytes()], "weights": [weights.tobytes()]})


def summarised(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """A quantile summary of each input: one per task, merged ``FAN_IN`` at a time."""
    shape = "feature int, part long, values binary, weights binary"
    found = rows.mapInArrow(_summaries, "feature int, values binary, weights binary")
    held = staged(found.withColumn("part", F.spark_partition_id().cast("long")).select("feature", "part", "values", "weights"))
    while held.agg(F.max("part")).first()[0]:
        grouped = held.groupBy("feature", F.expr(f"part div {FAN_IN}").alias("_group"))
        held = staged(grouped.applyInPandas(_merge_group, shape))
    return [(np.frombuffer(r["values"]), np.frombuffer(r["weights"])) for r in held.orderBy("feature").collect()]  # one row per input


def _packed_blocks(p: BoostedTrees, layout: Layout, base: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, mark in gathered(batches, p.block_rows):
            margin = np.full(len(y), base)
            yield pa.RecordBatch.from_pydict({"codes": [layout.coded(x).tobytes()], "y": [y.tobytes()], "mark": [mark.tobytes()], "margin": [margin.tobytes()]})

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], inputs: int) -> Iterator[Block]:
    for rows in batches:
        for row in rows.to_pylist():
            y = np.frombuffer(row["y"])
            yield Block(np.frombuffer(row["codes"], np.int32).reshape(inputs, len(y)), y, np.frombuffer(row["mark"], np.int64), np.frombuffer(row["margin"]).copy())


Grown = tuple[int, tuple[np.ndarray, ...], np.ndarray]  # round, routing, value of each node


def _carried(p: BoostedTrees, block: Block, since: list[Grown]) -> None:
    """Predictions after the trees grown since they were written."""
    for _, routing, values in since:
        block.at = np.zeros(len(block.y), np.int32)
        block.descend(*routing)
        block.finish(values)


def _partial(p: BoostedTrees, layout: Layout, since: list[Grown], round_: int, grid: float, routing: tuple, nodes: list[int]):
    """A task's histograms, one row per node and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _unpacked(batches, len(layout.cuts)):
            _carried(p, block, since)
            block.begin(p, round_, grid)
            block.descend(*routing)
            found = block.histograms(nodes, len(routing[0]), layout.bins)
            total = found if total is None else total + found
        if total is not None:
            keys = [(k, f) for k in range(len(nodes)) for f in range(len(layout.cuts))]
            sums = [np.ascontiguousarray(total[:, k, layout.first[f] : layout.first[f + 1]]).tobytes() for k, f in keys]
            yield pa.RecordBatch.from_pydict({"slot": pa.array([k for k, _ in keys], pa.int32()), "feature": pa.array([f for _, f in keys], pa.int32()), "sums": sums})

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(s) for s in rows["sums"])
    return pd.DataFrame({"slot": [rows["slot"].iloc[0]], "feature": [rows["feature"].iloc[0]], "sums": [total.tobytes()]})


def _rewritten(p: BoostedTrees, inputs: int, since: list[Grown]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _unpacked(batches, inputs):
            _carried(p, block, since)
            yield pa.RecordBatch.from_pydict({"codes": [block.codes.tobytes()], "y": [block.y.tobytes()], "mark": [block.mark.tobytes()], "margin": [block.margin.tobytes()]})

    return run


def _fit_blocks(p: BoostedTrees, rows: DataFrame, inputs: int, base: float, grid: float) -> list[dict]:
    layout = Layout([cuts_of(*s, p.bins) for s in summarised(rows)])
    blocks = staged(rows.mapInArrow(_packed_blocks(p, layout, base), BLOCKS))
    trees: list[dict] = []
    since: list[Grown] = []
    shape = "slot int, feature int, sums binary"
    for k in range(p.rounds):

        def ask(tree: Tree, nodes: list[int], k: int = k) -> np.ndarray:
            parts = blocks.mapInArrow(_partial(p, layout, since, k, grid, tree.routing(), nodes), shape)
            out = np.zeros((2, len(nodes), layout.bins))
            for r in parts.groupBy("slot", "feature").applyInPandas(_summed, shape).collect():  # bins of the leaves asked for
                low, high = layout.first[r["feature"]], layout.first[r["feature"] + 1]
                out[:, r["slot"], low:high] = np.frombuffer(r["sums"]).reshape(2, high - low)
            return out

        tree, found, values = p.grow(layout, k, grid, ask)
        trees.append(found)
        since.append((k, tree.routing(), values))
        if len(since) == KEPT and k + 1 < p.rounds:
            blocks, since = staged(blocks.mapInArrow(_rewritten(p, inputs, since), BLOCKS)), []
    return trees


def resized(model: BoostedTrees, **changes) -> BoostedTrees:
    return replace(model, **changes)
