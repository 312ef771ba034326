"""Regression trees as tables, their predictions, and the seeded draws that growing them needs."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

TREES = "tree int, node int, feature int, cut double, left int, right int, value double, gain double"
CELLS = 1 << 21  # trees times rows that are predicted at once
LOW32 = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 32-bit numbers (a public finishing step; the same numbers can be had in SQL)."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x85EBCA6B)) & LOW32
    x = x ^ (x >> np.uint64(13))
    x = (x * np.uint64(0xC2B2AE35)) & LOW32
    return x ^ (x >> np.uint64(16))


def draw(*parts) -> np.ndarray:
    """Numbers from 0 to below 1 that depend on the parts alone, whole numbers or arrays of them that fit each other."""
    h = np.zeros(1, np.uint64)
    for part in parts:
        p = np.atleast_1d(np.asarray(part)).astype(np.int64).view(np.uint64)
        p = (p ^ (p >> np.uint64(32))) & LOW32
        h = mix(((h ^ p) + np.uint64(0x9E3779B9)) & LOW32)
    return h / 2.0**32


def table(rows: list[Row]) -> list[dict[str, np.ndarray]]:
    """Rows of the ``TREES`` table as arrays, one set for each tree in order."""
    trees: dict[int, list[Row]] = {}
    for row in rows:
        trees.setdefault(row["tree"], []).append(row)
    out = []
    for k in sorted(trees):
        nodes = sorted(trees[k], key=lambda r: r["node"])
        out.append({c: np.array([r[c] for r in nodes]) for c in ("feature", "cut", "left", "right", "value", "gain")})
    return out


def tree_batch(trees: list[dict], first: int = 0) -> pa.RecordBatch:
    """Trees as rows of the ``TREES`` table."""
    sizes = [len(t["feature"]) for t in trees]
    columns = {"tree": np.repeat(np.arange(first, first + len(trees)), sizes), "node": np.concatenate([np.arange(n) for n in sizes])}
    columns |= {c: np.concatenate([t[c] for t in trees]) for c in ("feature", "cut", "left", "right", "value", "gain")}
    kinds = [(f.split()[0], pa.int32() if f.endswith("int") else pa.float64()) for f in TREES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kind) for n, kind in kinds], [n for n, _ in kinds])


@dataclass
class TreeEnsemble:
    """Fitted trees; ``transform`` adds their summed (or averaged) values to a base as one column and keeps all others.

    Its size follows the number of trees and their leaves, never the rows.
    """

    trees: list[dict[str, np.ndarray]] = field(repr=False)
    inputs: int
    base: float = 0.0
    mean: bool = False
    features: str = "features"
    staged_losses: list[float] = field(default_factory=list, repr=False)

    def packed(self, trees: int | None = None) -> tuple:
        used = self.trees[:trees]
        width = max((len(t["feature"]) for t in used), default=1)
        shape = (len(used), width)
        out = [np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape)]
        for k, tree in enumerate(used):
            for whole, name in zip(out, ("feature", "cut", "left", "right", "value")):
                whole[k, : len(tree[name])] = tree[name]
        return tuple(out)

    def first(self, trees: int) -> TreeEnsemble:
        """The ensemble of the first trees alone: what a shorter boosting run would have been."""
        return TreeEnsemble(self.trees[:trees], self.inputs, self.base, self.mean, self.features)

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.column())

    def column(self):
        packed, base, mean = self.packed(), self.base, self.mean

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(predict(packed, _matrix(x), base, mean))

        return predicted(vector_to_array(self.features))

    def staged_column(self, counts: list[int]):
        """Predictions of the first so many trees, for each of ``counts`` in turn, as an array."""
        packed, base = self.packed(max(counts, default=0)), self.base

        @F.arrow_udf("array<double>")
        def predicted(x: pa.Array) -> pa.Array:
            found = staged_predictions(packed, _matrix(x), base, counts)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(counts), pa.int32()), pa.array(found.ravel(), pa.float64()))

        return predicted(vector_to_array(self.features))

    @property
    def featureImportances(self) -> np.ndarray:
        """Each input's share of the gains of all splits."""
        gains = np.zeros(self.inputs)
        for tree in self.trees:
            inner = tree["feature"] >= 0
            np.add.at(gains, tree["feature"][inner], tree["gain"][inner])
        return gains / (gains.sum() or 1.0)


def _matrix(x: pa.Array) -> np.ndarray:
    values = x.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(x), -1) if len(x) else np.zeros((0, 1))


def _contributions(packed: tuple, x: np.ndarray):
    """Values of all trees (trees x rows), for some rows at a time."""
    feature, cut, left, right, value = packed
    count = len(feature)
    tree = np.arange(count)[:, None]
    step = max(1, CELLS // count)
    for low in range(0, len(x), step):
        part = x[low : low + step]
        rows = np.arange(len(part))[None, :]
        at = np.zeros((count, len(part)), np.int32)
        while True:
            f = feature[tree, at]
            moving = f >= 0
            if not moving.any():
                break
            goes = part[rows, np.maximum(f, 0)] <= cut[tree, at]
            at = np.where(moving, np.where(goes, left[tree, at], right[tree, at]), at)
        yield low, value[tree, at]


def predict(packed: tuple, x: np.ndarray, base: float, mean: bool) -> np.ndarray:
    count = len(packed[0])
    out = np.full(len(x), base)
    if count:
        for low, values in _contributions(packed, x):
            sums = values.sum(0)
            out[low : low + len(sums)] += sums / count if mean else sums
    return out


def staged_predictions(packed: tuple, x: np.ndarray, base: float, counts: list[int]) -> np.ndarray:
    """Rows x counts: the sums of the first trees."""
    out = np.full((len(x), len(counts)), base)
    if len(packed[0]):
        for low, values in _contributions(packed, x):
            upto = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
            out[low : low + values.shape[1]] += upto[np.minimum(counts, len(values))].T
    return out
