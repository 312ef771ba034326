"""Extremely random trees against a plain recursive version with the same draws."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pastward.operators import random_trees as R
from pastward.operators.tree_model import draw, predict
from tests.test_boosting import nested, numbers, same

P = R.RandomTrees(trees=5, depth=8, leaf=2, rows=0.85, columns=0.8, seed=3)


def table(spark, x, y, mark, partitions):
    rows = [(float(t), [float(v) for v in r], int(m)) for r, t, m in zip(x, y, mark)]
    return spark.createDataFrame(rows, "Consumption double, x array<double>, mark long").repartition(partitions).withColumn("features", array_to_vector("x"))


def plain(p, x, y, mark, tree):
    """One tree by recursion over rows drawn so many times."""
    w = p.counts(mark, tree)
    chosen = p.chosen(x.shape[1], tree)

    def grow(rows, place, depth):
        weight, total = w[rows].sum(), (w[rows] * y[rows]).sum()
        ways = []
        for f in np.flatnonzero(chosen):
            low, high = x[rows, f].min(), x[rows, f].max()
            if low < high:
                cut = low + draw(place, f, tree, p.seed + 2)[0] * (high - low)
                cut = cut if cut < high else low
                a = rows[x[rows, f] <= cut]
                b = rows[x[rows, f] > cut]
                if min(len(a), len(b)) >= p.leaf:
                    gain = (w[a] * y[a]).sum() ** 2 / w[a].sum() + (w[b] * y[b]).sum() ** 2 / w[b].sum() - total**2 / weight
                    ways.append((round(gain, 5), -f, cut, a, b))
        best = max(ways, key=lambda way: way[:2], default=None)
        if depth >= p.depth or best is None or best[0] <= 1e-9:
            return total / weight
        _, f, cut, a, b = best
        return -f, cut, grow(a, 2 * place, depth + 1), grow(b, 2 * place + 1, depth + 1)

    return grow(np.flatnonzero(w > 0), 1, 0)


def test_trees_equal_plain_version(spark):
    x, y, mark = numbers(250, 5)
    fitted = P.fit(table(spark, x, y, mark, 3), mark=F.col("mark"))
    for t, tree in enumerate(fitted.trees):
        assert same(nested(tree), plain(P, x, y, mark, t))
    got = fitted.transform(table(spark, x, y, mark, 2)).select("Consumption", "prediction").collect()
    assert sorted(r["prediction"] for r in got) == pytest.approx(sorted(predict(fitted.packed(), x, 0.0, True)))


@pytest.mark.parametrize("finish, partitions", [(100, 1), (40, 4), (3, 2)])
def test_levels_and_partitions_do_not_show(spark, finish, partitions):
    x, y, mark = numbers(220, 6)
    p = replace(P, trees=3)
    one = p.fit(table(spark, x, y, mark, 1), mark=F.col("mark"))
    many = replace(p, finish=finish).fit(table(spark, x, y, mark, partitions), mark=F.col("mark"))
    assert all((a[c] == b[c]).all() if c != "gain" else np.allclose(a[c], b[c]) for a, b in zip(one.trees, many.trees, strict=True) for c in a)


def test_draws():
    mark = np.arange(200_000)
    counts = P.counts(mark, 0)
    assert abs(counts.mean() - 0.85) < 0.01 and abs(counts.var() - 0.85) < 0.02
    assert abs(np.corrcoef(counts, P.counts(mark, 1))[0, 1]) < 0.02
    u = draw(mark, 7)
    assert abs(u.mean() - 0.5) < 0.005 and abs(np.quantile(u, 0.1) - 0.1) < 0.005
    assert P.chosen(10, 0).sum() == 8


def test_edge_tables(spark):
    x, y, mark = numbers(40)
    assert P.fit(table(spark, x[:0], y[:0], mark[:0], 1)).trees == []
    flat = P.fit(table(spark, x, np.full(40, 3.0), mark, 2))
    assert {r["prediction"] for r in flat.transform(table(spark, x, y, mark, 1)).collect()} == {3.0}
    x[::3, 0] = np.nan
    df = table(spark, x, y, mark, 2)
    fitted = P.fit(df)
    assert fitted.transform(df).where("prediction IS NULL OR isnan(prediction)").count() == 0
    same_rows = table(spark, np.repeat(x[1:2], 30, 0), np.repeat(y[1:2], 30), np.arange(30), 2)
    assert {r["prediction"] for r in P.fit(same_rows).transform(same_rows).collect()} == {float(y[1])}
