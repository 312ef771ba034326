"""Linear models from co-moments, against numpy on the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastward.operators import gram as G
from pastward.operators.crossval import nested_positions

NAMES = [f"c{k}" for k in range(6)]


def numbers(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * [1, 100, 0.01, 1, 1, 1] + [0, 1e6, 0, 5, 0, 0]
    x[:, 4] = x[:, 0] * 0.9 + x[:, 4] * 0.1
    x[:, 5] = 3.0
    return x, 4 * x[:, 0] - 0.02 * x[:, 1] + rng.normal(size=n)


def frame(spark, x, y, parts=None, partitions=5):
    rows = [(int(p), *map(float, r), float(t)) for p, r, t in zip(parts if parts is not None else np.zeros(len(y)), x, y)]
    return spark.createDataFrame(rows, "part long, " + ", ".join(f"{c} double" for c in NAMES) + ", Consumption double").repartition(partitions)


def direct_ridge(x, y, alpha):
    mean, scale = x.mean(0), x.std(0)
    used = scale > 1e-9
    z = (x[:, used] - mean[used]) / scale[used]
    w = np.zeros(x.shape[1])
    w[used] = np.linalg.solve(z.T @ z + alpha * np.eye(used.sum()), z.T @ (y - y.mean())) / scale[used]
    return w, y.mean() - w @ mean


@pytest.mark.parametrize("partitions, fan_in", [(1, 64), (9, 2)])
def test_merged_moments(spark, monkeypatch, partitions, fan_in):
    monkeypatch.setattr(G, "FAN_IN", fan_in)
    x, y = numbers(500)
    parts = np.arange(500) % 3
    found = G.grams(frame(spark, x, y, parts, partitions), F.col("part"), NAMES)
    assert sorted(found) == [0, 1, 2]
    whole = G.merged(found, lambda k: k != 1, 6)
    z = np.column_stack([x, y])[parts != 1]
    assert whole.n == len(z) and np.allclose(whole.mean, z.mean(0)) and np.allclose(whole.moment, np.cov(z.T, bias=True) * len(z), rtol=1e-9, atol=1e-6)


def test_ridge_and_errors_without_rows():
    x, y = numbers(300, 1)
    train, test = G.Gram.of(np.column_stack([x, y])[:200]), G.Gram.of(np.column_stack([x, y])[200:])
    for alpha in (0.5, 50.0):
        line = train.ridge(alpha)
        w, b = direct_ridge(x[:200], y[:200], alpha)
        assert np.allclose(line.weights, w, rtol=1e-6, atol=1e-9) and line.intercept == pytest.approx(b, rel=1e-6)
        e = y[200:] - x[200:] @ w - b
        rmse, r2 = test.scores(line)
        assert rmse == pytest.approx(np.sqrt((e**2).mean()), rel=1e-6) and r2 == pytest.approx(1 - (e**2).mean() / y[200:].var(), rel=1e-6)


def test_lasso_path_is_optimal():
    """At each penalty the gradient of every input is the penalty times the weight's sign, or smaller where the weight is 0."""
    x, y = numbers(400, 2)
    gram = G.Gram.of(np.column_stack([x, y]))
    used, _, _ = gram.correlations()
    z = (x - x.mean(0))[:, used] / x.std(0)[used]
    steps = G.penalties(gram.largest_penalty(), 15)
    counts = []
    for penalty, line in zip(steps, gram.lasso_path(steps)):
        w = line.weights[used] * x.std(0)[used]
        slope = z.T @ (y - x @ line.weights - line.intercept) / len(y)
        assert np.all(np.abs(slope) <= penalty * (1 + 1e-6) + 1e-9)
        assert np.allclose(slope[w != 0], penalty * np.sign(w[w != 0]), rtol=1e-6, atol=1e-9)
        counts.append(int((w != 0).sum()))
    assert counts[0] == 0 and counts[-1] == len(used) and line.weights[5] == 0


def test_nested_sets_from_one_scan(hourly):
    from pastward.operators.splits import expanding_folds

    rng = np.random.default_rng(3)
    series = {"a": rng.normal(50, 9, 61).tolist(), "b": rng.normal(20, 5, 37).tolist()}
    df = hourly(series, x=lambda p: rng.normal(size=len(p)), z=lambda p: np.arange(len(p)) % 7 * 1.0)
    pdf = df.toPandas().sort_values(["series_id", "timestamp"])
    pdf["at"] = pdf.groupby("series_id").cumcount()
    pdf["n"] = pdf.groupby("series_id")["at"].transform("size")
    alphas = (0.5, 80.0)

    def fitted(train, test, alpha):
        w, b = direct_ridge(train[["x", "z"]].to_numpy(), train["Consumption"].to_numpy(), alpha)
        e = test["Consumption"] - test[["x", "z"]].to_numpy() @ w - b
        return float(np.sqrt((e**2).mean()))

    got = G.nested_ridge(df, ["x", "z"], alphas, outer_folds=3, inner_folds=2).orderBy("outer_fold").collect()
    for i, row in enumerate(got, 1):
        prefix = pdf["n"] - (4 - i) * (pdf["n"] // 4)
        inner = {}
        for a in alphas:
            cuts = [prefix - (3 - j) * (prefix // 3) for j in (1, 2)] + [prefix]
            inner[a] = np.mean([fitted(pdf[pdf["at"] < cuts[j]], pdf[(pdf["at"] >= cuts[j]) & (pdf["at"] < cuts[j + 1])], a) for j in (0, 1)])
        best = min(alphas, key=inner.get)
        test = pdf[(pdf["at"] >= prefix) & (pdf["at"] < prefix + pdf["n"] // 4)]
        assert row["alpha"] == best and row["inner_rmse"] == pytest.approx(inner[best])
        assert row["rmse"] == pytest.approx(fitted(pdf[pdf["at"] < prefix], test, best)) and row["train_rows"] == (pdf["at"] < prefix).sum()
    folds = {r["fold"]: r for r in G.ridge_folds(df, ["x", "z"], 2.0, folds=3).collect()}
    placed = expanding_folds(df, folds=3).toPandas()
    for k, row in folds.items():
        assert row["rmse"] == pytest.approx(fitted(placed[placed["fold"] < k], placed[placed["fold"] == k], 2.0))
    assert len(nested_positions(3, 2)(F.lit(10))) == 9


def test_edge_tables(spark):
    x, y = numbers(30, 4)
    none = G.lasso_path(frame(spark, x[:0], y[:0]), NAMES, (0.5,))
    assert {r["weight"] for r in none.collect()} == {0.0}
    x[3, 0], y[5] = np.nan, np.nan
    found = G.grams(frame(spark, x, y), F.col("part"), NAMES)
    assert found[0].n == 28
    one = G.Gram.of(np.column_stack([x, y])[:1])
    assert one.ridge(1.0).intercept == y[0] and one.scores(one.ridge(1.0)) == (0.0, None)
    with pytest.raises(ValueError, match="bits"):
        G.nested_ridge(frame(spark, x, y), NAMES, (1.0,), outer_folds=9, inner_folds=9)
