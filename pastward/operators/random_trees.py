"""Bagged extremely random regression trees: one threshold drawn for each feature of a node, between the node's least and largest value.

Every tree draws its own rows (with replacement, as counts) and its own features. A level takes two passes over the rows for all nodes of
all trees: least and largest values by node and feature, then, with the thresholds drawn from them, counts and sums to the left. A node
of at most ``finish`` rows is not worth a pass: its rows are shipped together and its whole subtree grows in one task, by the same steps. A table of
that size is such a node from the start, so its trees grow in parallel, one task each.

Draws are hashes of the row's mark, the tree, the node's place and the feature; targets are rounded to a grid on which sums are exact. So trees
depend neither on partitions nor on where a node is finished.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.operators.boosting import BLOCK_ROWS, gathered
from pastward.operators.tree_model import TreeEnsemble, draw
from pastward.schema import TARGET
from pastward.session import staged

COPIES = 16  # no row is drawn more often into one tree
PURE = 1e-12


@dataclass(frozen=True)
class Nodes:
    """Some nodes of one tree: places (1 is the root, 2k and 2k + 1 the children of k), and by feature their least and largest values."""

    tree: int
    place: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass(frozen=True)
class RandomTrees:
    """``trees`` trees of at most ``depth`` levels whose leaves hold ``leaf`` rows or more; ``rows`` times the rows and the share ``columns`` of the features are
    drawn for each."""

    trees: int = 70
    depth: int = 20
    leaf: int = 2
    rows: float = 0.85
    columns: float = 0.9
    seed: int = 42
    finish: int = BLOCK_ROWS

    def counts(self, mark: np.ndarray, tree: int) -> np.ndarray:
        """How often each row is drawn into a tree: Poisson counts, which is what drawing with replacement tends to."""
        u, out = draw(mark, tree, self.seed), np.zeros(len(mark))
        term = upto = math.exp(-self.rows)
        for k in range(1, COPIES):
            out += u >= upto
            term *= self.rows / k
            upto += term
        return out

    def chosen(self, inputs: int, tree: int) -> np.ndarray:
        keep = max(1, int(self.columns * inputs))
        flags = np.zeros(inputs, bool)
        flags[np.argsort(draw(np.arange(inputs), tree, self.seed + 1), kind="stable")[:keep]] = True
        return flags

    def thresholds(self, nodes: Nodes) -> np.ndarray:
        """A value from the least to below the largest for each node and feature; missing where there is nothing to part."""
        u = draw(nodes.place[:, None], np.arange(nodes.low.shape[1])[None, :], nodes.tree, self.seed + 2)
        found = nodes.low + u * (nodes.high - nodes.low)
        found = np.where(found < nodes.high, found, nodes.low)
        return np.where((nodes.low < nodes.high) & self.chosen(nodes.low.shape[1], nodes.tree), found, np.nan)

    def best(self, left: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The feature with the largest gain, and that gain, from rows, weights and sums (nodes x features) left of the thresholds and of the whole nodes."""
        (n, w, s), (all_n, all_w, all_s) = left, (v[:, None] for v in whole)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s * s / w + (all_s - s) ** 2 / (all_w - w) - all_s**2 / all_w
        gain = np.where((n >= self.leaf) & (all_n - n >= self.leaf), gain, -np.inf)
        feature = np.argmax(gain, axis=1)
        return feature, gain[np.arange(len(gain)), feature]

    def fit(self, prepared: DataFrame, target: str = TARGET, features: str = "features", mark: Column | None = None) -> TreeEnsemble:
        """Fit on rows with a target and an input vector; rows without a target do not count.

        ``mark`` is a whole number that tells rows apart for the draws; by default a hash of the row's values. Missing inputs go right. No rows give
        an ensemble that predicts 0.
        """
        x = vector_to_array(features)
        mark = F.xxhash64(target, x) if mark is None else mark
        rows = prepared.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), x.alias("x"), mark.cast("long").alias("mark"))
        facts = rows.agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.max(F.abs("y")).alias("most"), F.max(F.size("x")).alias("inputs")).first()
        if not facts["n"]:
            return TreeEnsemble([], 0, features=features)
        grid = 2.0 ** math.floor(52 - math.log2(max(2.0, 2.0 * COPIES * facts["n"] * max(facts["most"], 1e-300))))
        forest = _Forest(self, facts["inputs"], grid)
        if facts["n"] <= self.finish:
            rows = rows.coalesce(1)
        else:
            rows = staged(rows.mapInArrow(_blocks(self.finish), "x binary, y binary, mark binary"))
            while forest.split_level(rows):
                pass
        trees = forest.finished(rows)
        return TreeEnsemble(trees or [_alone(facts["mean"])], facts["inputs"], mean=True, features=features)


def _alone(value: float) -> dict[str, np.ndarray]:
    none = np.array([-1], np.int32)
    return {"feature": none, "cut": np.zeros(1), "left": none, "right": none, "value": np.array([value]), "gain": np.zeros(1)}


def _descend(x: np.ndarray, tree: dict) -> np.ndarray:
    """The place of each row: of a leaf, or of a node that is not split yet."""
    feature, cut, place = tree["feature"], tree["cut"], np.ones(len(x), np.int64)
    moving = np.arange(len(x))
    while len(moving):
        inner = np.array([p in feature for p in place[moving].tolist()], bool)
        moving = moving[inner]
        at = place[moving].tolist()
        goes = x[moving, [feature[p] for p in at]] <= np.array([cut[p] for p in at]) if at else np.zeros(0, bool)
        place[moving] = 2 * place[moving] + ~goes
    return place


def _grouped(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their places, the places, and where each begins."""
    order = np.argsort(place, kind="stable")
    first = np.flatnonzero(np.diff(place[order], prepend=-1))
    return order, place[order][first], first


def _extent(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest values of each group of rows; missing ones do not count."""
    low = np.fmin.reduceat(x, first, axis=0)
    return low, np.fmax.reduceat(x, first, axis=0)


def _left(x: np.ndarray, w: np.ndarray, s: np.ndarray, first: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Rows, weights and sums left of the thresholds, by group and feature."""
    sizes = np.diff(first, append=len(x))
    goes = x <= np.repeat(thresholds, sizes, axis=0)
    return np.stack([np.add.reduceat(np.where(goes, v, 0.0), first, axis=0) for v in (1.0, w[:, None], s[:, None])])


def _whole(w: np.ndarray, s: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.diff(first, append=n).astype(float), np.add.reduceat(w, first), np.add.reduceat(s, first)])


def subtree(p: RandomTrees, tree: int, root: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, grid: float) -> list[tuple]:
    """Nodes below ``root`` from its rows: place, feature (-1 in leaves), cut, value and gain."""
    out: list[tuple] = []
    s, place = np.rint(y * grid) * w, np.full(len(x), root, np.int64)
    while len(x):
        order, places, first = _grouped(place)
        x, w, s = x[order], w[order], s[order]
        whole = _whole(w, s, first, len(x))
        cuts = p.thresholds(Nodes(tree, places, *_extent(x, first)))
        feature, gain = p.best(_left(x, w, s, first, cuts), whole)
        deep = np.array([int(k).bit_length() - 1 >= p.depth for k in places.tolist()])
        split = (gain > PURE * np.maximum(1.0, whole[2] ** 2 / whole[1])) & ~deep
        values, scale = whole[2] / whole[1] / grid, grid * grid
        for k in range(len(places)):
            f = int(feature[k]) if split[k] else -1
            out.append((int(places[k]), f, float(cuts[k, f]) if f >= 0 else 0.0, 0.0 if f >= 0 else float(values[k]), float(gain[k]) / scale if f >= 0 else 0.0))
        group = np.repeat(np.arange(len(places)), np.diff(first, append=len(x)))
        stay = split[group]
        x, w, s, group = x[stay], w[stay], s[stay], group[stay]
        goes = x[np.arange(len(x)), feature[group]] <= cuts[group, feature[group]]
        place = 2 * places[group] + ~goes
    return out


def _blocks(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, mark in gathered(batches, rows):
            yield pa.RecordBatch.from_pydict({"x": [np.ascontiguousarray(x).tobytes()], "y": [y.tobytes()], "mark": [mark.tobytes()]})

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], inputs: int, finish: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows, from packed blocks or from rows."""
    for rows in batches:
        if pa.types.is_binary(rows.schema.field("y").type):
            for row in rows.to_pylist():
                yield np.frombuffer(row["x"]).reshape(-1, inputs), np.frombuffer(row["y"]), np.frombuffer(row["mark"], np.int64)
        else:
            yield from gathered(iter([rows]), finish)


class _Forest:
    """Trees while they grow: split nodes by place, and the rows of the nodes that are open."""

    def __init__(self, p: RandomTrees, inputs: int, grid: float) -> None:
        self.p, self.inputs, self.grid = p, inputs, grid
        self.trees = [{"feature": {}, "cut": {}, "gain": {}} for _ in range(p.trees)]
        self.leaves: list[dict[int, float]] = [{} for _ in range(p.trees)]
        self.large = {(t, 1) for t in range(p.trees)}  # nodes to be split over all rows
        self.small: set[tuple[int, int]] = set()  # nodes to be finished in one task

    def _by_tree(self, nodes: set[tuple[int, int]]) -> dict[int, np.ndarray]:
        found: dict[int, list[int]] = {}
        for t, k in nodes:
            found.setdefault(t, []).append(k)
        return {t: np.array(sorted(v)) for t, v in sorted(found.items())}

    def _sorted(self, block, trees: dict[int, np.ndarray]) -> Iterator[tuple]:
        """For each tree of interest: its drawn rows in the wanted nodes, grouped by node."""
        x, y, mark = block
        for t, wanted in trees.items():
            w = self.p.counts(mark, t)
            place = _descend(x, self.trees[t])
            rows = np.flatnonzero((w > 0) & np.isin(place, wanted))
            if len(rows):
                order, places, first = _grouped(place[rows])
                rows = rows[order]
                yield t, places, first, x[rows], y[rows], w[rows]

    def split_level(self, blocks: DataFrame) -> bool:
        """Split the nodes that are too large for one task; whether there are more of them after that."""
        if not self.large:
            return False
        trees = self._by_tree(self.large)
        shape = "tree int, place long, low binary, high binary, sums binary"
        extents = blocks.mapInArrow(self._extents(trees), shape).groupBy("tree", "place").applyInPandas(_joined_extents, shape).collect()  # one row per open node
        found: dict[int, list] = {}
        for r in sorted(extents, key=lambda r: (r["tree"], r["place"])):
            found.setdefault(r["tree"], []).append(r)
        cuts = {t: (np.array([r["place"] for r in v]), self.p.thresholds(Nodes(t, np.array([r["place"] for r in v]), *(np.stack([np.frombuffer(r[c]) for r in v]) for c in ("low", "high"))))) for t, v in found.items()}
        shape = "tree int, place long, sums binary"
        lefts = blocks.mapInArrow(self._lefts(cuts), shape).groupBy("tree", "place").applyInPandas(_joined_lefts, shape).collect()  # the same nodes
        self.large = set()
        whole = {(r["tree"], r["place"]): np.frombuffer(r["sums"]) for r in extents}
        for r in lefts:
            t, k = r["tree"], r["place"]
            sums, all_ = np.frombuffer(r["sums"]).reshape(3, 1, -1), whole[t, k].reshape(3, 1)
            feature, gain = self.p.best(sums, all_)
            f, deep = int(feature[0]), k.bit_length() - 1 >= self.p.depth
            if deep or not gain[0] > PURE * max(1.0, all_[2, 0] ** 2 / all_[1, 0]):
                self.leaves[t][k] = float(all_[2, 0] / all_[1, 0] / self.grid)
                continue
            places, thresholds = cuts[t]
            self.trees[t]["feature"][k], self.trees[t]["cut"][k] = f, float(thresholds[np.searchsorted(places, k), f])
            self.trees[t]["gain"][k] = float(gain[0]) / self.grid**2
            for child, rows in ((2 * k, sums[0, 0, f]), (2 * k + 1, all_[0, 0] - sums[0, 0, f])):
                (self.small if rows <= self.p.finish else self.large).add((t, child))
        return bool(self.large)

    def _extents(self, trees):
        def run(batches):
            held: dict[tuple, tuple] = {}
            for block in _unpacked(batches, self.inputs, self.p.finish):
                for t, places, first, x, y, w in self._sorted(block, trees):
                    whole = _whole(w, np.rint(y * self.grid) * w, first, len(x))
                    for k, (place, low, high) in enumerate(zip(places.tolist(), *_extent(x, first))):
                        old = held.get((t, place))
                        held[t, place] = (low, high, whole[:, k]) if old is None else (np.fmin(low, old[0]), np.fmax(high, old[1]), whole[:, k] + old[2])
            if held:
                columns = [[np.ascontiguousarray(v[c]).tobytes() for v in held.values()] for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int64()), *map(pa.array, columns)], ["tree", "place", "low", "high", "sums"])

        return run

    def _lefts(self, cuts):
        trees = {t: places for t, (places, _) in cuts.items()}

        def run(batches):
            held: dict[tuple, np.ndarray] = {}
            for block in _unpacked(batches, self.inputs, self.p.finish):
                for t, places, first, x, y, w in self._sorted(block, trees):
                    thresholds = cuts[t][1][np.searchsorted(cuts[t][0], places)]
                    left = _left(x, w, np.rint(y * self.grid) * w, first, thresholds)
                    for k, place in enumerate(places.tolist()):
                        held[t, place] = held.get((t, place), 0.0) + left[:, k]
            if held:
                sums = [np.ascontiguousarray(v).tobytes() for v in held.values()]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int64()), pa.array(sums)], ["tree", "place", "sums"])

        return run

    def finished(self, rows: DataFrame) -> list[dict]:
        """Finish the open nodes, each in one task, and give all trees as tables."""
        roots = self._by_tree(self.small or self.large)
        p, inputs, grid = self.p, self.inputs, self.grid

        def shipped(batches):
            for block in _unpacked(batches, inputs, p.finish):
                for t, places, first, x, y, w in self._sorted(block, roots):
                    for place, low, high in zip(places.tolist(), first.tolist(), [*first[1:].tolist(), len(x)]):
                        part = [np.ascontiguousarray(v[low:high]).tobytes() for v in (x, y, w)]
                        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([place], pa.int64()), *(pa.array([v]) for v in part)], ["tree", "place", "x", "y", "w"])

        def grown(group: pd.DataFrame) -> pd.DataFrame:
            x, y, w = (np.concatenate([np.frombuffer(v) for v in group[c]]) for c in ("x", "y", "w"))
            tree, root = int(group["tree"].iloc[0]), int(group["place"].iloc[0])
            nodes = subtree(p, tree, root, x.reshape(-1, inputs), y, w, grid)
            return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "place", "feature", "cut", "value", "gain"])

        if roots:
            packed = rows.mapInArrow(shipped, "tree int, place long, x binary, y binary, w binary")
            parted = packed.repartition(min(256, len(self.small or self.large)), "tree", "place")
            nodes = parted.groupBy("tree", "place").applyInPandas(grown, "tree int, place long, feature int, cut double, value double, gain double")
            for r in nodes.collect():  # the model
                if r["feature"] < 0:
                    self.leaves[r["tree"]][r["place"]] = r["value"]
                else:
                    for name in ("feature", "cut", "gain"):
                        self.trees[r["tree"]][name][r["place"]] = r[name]
        return [self._table(t) for t in range(p.trees) if self.leaves[t]]  # trees that drew no row do not vote

    def _table(self, t: int) -> dict[str, np.ndarray]:
        split, leaves = self.trees[t], self.leaves[t]
        places = sorted([*split["feature"], *leaves])
        names = {k: n for n, k in enumerate(places)}
        inner = [k in split["feature"] for k in places]
        return {
            "feature": np.array([split["feature"].get(k, -1) for k in places], np.int32),
            "cut": np.array([split["cut"].get(k, 0.0) for k in places]),
            "left": np.array([names[2 * k] if s else -1 for k, s in zip(places, inner)], np.int32),
            "right": np.array([names[2 * k + 1] if s else -1 for k, s in zip(places, inner)], np.int32),
            "value": np.array([0.0 if s else leaves.get(k, 0.0) for k, s in zip(places, inner)]),
            "gain": np.array([split["gain"].get(k, 0.0) for k in places]),
        }


def _joined_extents(rows: pd.DataFrame) -> pd.DataFrame:
    low, high, sums = (np.stack([np.frombuffer(v) for v in rows[c]]) for c in ("low", "high", "sums"))
    return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "place": [rows["place"].iloc[0]], "low": [np.fmin.reduce(low).tobytes()], "high": [np.fmax.reduce(high).tobytes()], "sums": [sums.sum(0).tobytes()]})


def _joined_lefts(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(v) for v in rows["sums"])
    return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "place": [rows["place"].iloc[0]], "sums": [total.tobytes()]})
