"""Boosted trees against a plain version that tries every split of every node on every row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pastward.operators import boosting as B
from pastward.operators.tree_model import draw, predict

WIDE = dict(rounds=6, rate=0.3)
SETTINGS = (
    B.BoostedTrees(**WIDE, leaves=8, l2=0.5, child=20),
    B.BoostedTrees(**WIDE, depth=4, l1=3.0, l2=1.0, child=3, rows=0.8, columns=0.6),
    B.BoostedTrees(**WIDE, leaves=2, depth=1),
    B.BoostedTrees(**WIDE, leaves=12, depth=3, bins=16),
)


def numbers(n: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:, 2] = np.rint(x[:, 2] * 2)
    x[:, 3] = 7.0
    x[:, 4] = x[:, 2] > 0
    y = np.rint(100 * np.sin(x[:, 0]) + 20 * x[:, 2] + rng.normal(0, 5, n))
    return x, y, rng.integers(-(1 << 62), 1 << 62, n)


def plain(p: B.BoostedTrees, x, y, mark, start):
    """Trees as nested tuples (feature, cut, left, right) or leaf values; gradients and hessians are summed row by row."""
    cuts = [B.cuts_of(*np.unique(x[:, f], return_counts=True), p.bins) for f in range(x.shape[1])]
    margin, trees = np.full(len(y), start), []
    for k in range(p.rounds):
        used = draw(mark, k, p.seed) < p.rows if p.rows < 1 else np.ones(len(y), bool)
        columns = p.chosen_columns(x.shape[1], k)
        g = margin - y

        def score(rows):
            total = g[rows].sum()
            return np.sign(total) * max(abs(total) - p.l1, 0), rows.sum() + p.l2

        def best(rows, depth):
            ways = []
            for f in np.flatnonzero(columns):
                for c in cuts[f]:
                    a, b = rows & (x[:, f] <= c), rows & (x[:, f] > c)
                    if min((a & used).sum(), (b & used).sum()) >= p.child and (p.depth is None or depth < p.depth):
                        (ga, ha), (gb, hb), (gw, hw) = score(a & used), score(b & used), score(rows & used)
                        ways.append((round(ga * ga / ha + gb * gb / hb - gw * gw / hw, 6), -f, -c))
            return max(ways, default=(0, 0, 0))

        leaves = {"": (np.ones(len(y), bool), best(np.ones(len(y), bool), 0))}
        splits = {}
        while p.leaves is None or len(leaves) < p.leaves:
            path = min(leaves, key=lambda q: (-leaves[q][1][0], q))
            rows, (gain, f, c) = leaves[path]
            if gain <= 1e-6:
                break
            del leaves[path]
            splits[path] = (-f, -c)
            for side, part in (("0", x[:, -f] <= -c), ("1", x[:, -f] > -c)):
                leaves[path + side] = (rows & part, best(rows & part, len(path) + 1))
        values = {q: -p.rate * score(rows & used)[0] / score(rows & used)[1] for q, (rows, _) in leaves.items()}
        for q, (rows, _) in leaves.items():
            margin[rows] += values[q]

        def nested(q):
            return (*splits[q], nested(q + "0"), nested(q + "1")) if q in splits else values[q]

        trees.append(nested(""))
    return trees, margin


def nested(tree, node=0):
    f = tree["feature"][node]
    return float(tree["value"][node]) if f < 0 else (f, tree["cut"][node], nested(tree, tree["left"][node]), nested(tree, tree["right"][node]))


def same(a, b) -> bool:
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3]) if isinstance(a, tuple) else abs(a - b) < 1e-6


@pytest.fixture(scope="module")
def table(spark):
    def make(x, y, mark, partitions):
        rows = [(float(t), [float(v) for v in r], int(m)) for r, t, m in zip(x, y, mark)]
        df = spark.createDataFrame(rows, "Consumption double, x array<double>, mark long").repartition(partitions)
        return df.withColumn("features", array_to_vector("x"))

    return make


@pytest.mark.parametrize("p", SETTINGS)
def test_trees_equal_plain_version(table, p):
    x, y, mark = numbers(400)
    fitted = p.fit(table(x, y, mark, 3), mark=F.col("mark"))
    expected, margin = plain(p, x, y, mark, fitted.base)
    assert abs(fitted.base - y.mean()) < 1e-6
    assert all(same(nested(t), e) for t, e in zip(fitted.trees, expected, strict=True))
    got = sorted((r["y"], r["prediction"]) for r in fitted.transform(table(x, y, mark, 2)).select(F.col("Consumption").alias("y"), "prediction").collect())
    assert np.allclose(np.array(got), np.array(sorted(zip(y, margin))), atol=1e-6)


def test_2000_rows_node_by_node(table):
    x, y, mark = numbers(2000, 4)
    p = B.BoostedTrees(rounds=2, rate=0.5, leaves=31, l2=0.5, child=20, bins=32)
    fitted = p.fit(table(x, y, mark, 4), mark=F.col("mark"))
    assert all(same(nested(t), e) for t, e in zip(fitted.trees, plain(p, x, y, mark, fitted.base)[0], strict=True))


@pytest.mark.parametrize("p", SETTINGS[:2])
def test_blocks_and_partitions_do_not_show(table, p, monkeypatch):
    monkeypatch.setattr(B, "KEPT", 2)
    x, y, mark = numbers(500, 1)
    one = p.fit(table(x, y, mark, 1), mark=F.col("mark"))
    for block_rows, partitions in ((120, 1), (60, 3)):
        many = B.resized(p, block_rows=block_rows).fit(table(x, y, mark, partitions), mark=F.col("mark"))
        assert all((a[c] == b[c]).all() for a, b in zip(one.trees, many.trees, strict=True) for c in a)


def test_summaries_merge():
    rng = np.random.default_rng(2)
    values = np.rint(rng.normal(size=20_000) * 1000)
    parts = [B.merged([(part, np.ones(len(part)))], 200) for part in np.array_split(values, 13)]
    found, weights = B.merged([B.merged(parts[:6], 200), B.merged(parts[6:], 200)], 200)
    assert weights.sum() == len(values) and len(found) <= 200
    ranks = np.searchsorted(np.sort(values), found, side="right")
    assert np.abs(ranks - np.cumsum(weights)).max() <= 4 * len(values) / 200
    # weights count like copies
    w = rng.integers(1, 5, 300)
    v = rng.normal(size=300)
    a, b = B.merged([(v, w.astype(float))]), B.merged([(np.repeat(v, w), np.ones(w.sum()))])
    assert (B.cuts_of(*a, 16) == B.cuts_of(*b, 16)).all()


def test_losses_fall_and_shorter_runs_are_prefixes(table):
    x, y, mark = numbers(300, 3)
    p = B.BoostedTrees(rounds=25, rate=0.2, depth=3, l1=0.5, l2=1.0, child=2)
    fitted = p.fit(table(x, y, mark, 2), mark=F.col("mark"))
    losses = [np.mean((y - predict(fitted.first(k).packed(), x, fitted.base, False)) ** 2) for k in range(26)]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    short = B.resized(p, rounds=10).fit(table(x, y, mark, 2), mark=F.col("mark"))
    assert all((a[c] == b[c]).all() for a, b in zip(fitted.trees, short.trees) for c in a)
    assert abs(fitted.featureImportances.sum() - 1) < 1e-9 and fitted.featureImportances[3] == 0


def test_edge_tables(table, spark):
    x, y, mark = numbers(50)
    p = SETTINGS[2]
    assert p.fit(table(x[:0], y[:0], mark[:0], 1)).trees == []
    flat = p.fit(table(x, np.full(50, 3.0), mark, 2))
    assert {r["prediction"] for r in flat.transform(table(x, y, mark, 1)).collect()} == {3.0}
    x[:5, 0] = np.nan
    rows = table(x, y, mark, 2).withColumn("Consumption", F.when(F.col("mark") % 3 != 0, F.col("Consumption")))
    fitted = p.fit(rows)
    assert fitted.transform(rows).where("prediction IS NULL OR isnan(prediction)").count() == 0
    assert p.fit(table(x[:1], y[:1], mark[:1], 1)).base == pytest.approx(y[0])
