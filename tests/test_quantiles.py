from __future__ import annotations

import numpy as np
import pytest

from pastward.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def values_of(kind: str, n: int) -> np.ndarray:
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(0, 1, n),
        "ties": rng.integers(0, 3, n).astype(float),
        "hot": np.where(rng.random(n) < 0.4, 0.0, rng.normal(5, 2, n)),
        "heavy": np.exp(rng.normal(0, 8, n)),
        "constant": np.full(n, 2.5),
    }[kind]


@pytest.mark.parametrize("kind", ["normal", "ties", "hot", "heavy", "constant"])
@pytest.mark.parametrize("n, slices", [(1, 3), (2, None), (99, 1), (5000, 13)])
def test_equals_numpy(spark, kind, n, slices):
    values = values_of(kind, n)
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "a double, b double").repartition(5)
    found = {(row["column"], row["p"]): row["value"] for row in exact_quantiles(df, ["a", "b"], PROBS, slices=slices).collect()}
    for p in PROBS:
        assert found["a", p] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
        assert found["b", p] == pytest.approx(np.quantile(-values, p), rel=1e-12, abs=1e-12)


def test_groups_and_missing_values(spark):
    rows = [("x", 1.0), ("x", 3.0), ("x", None), ("x", float("nan")), ("y", 10.0), ("z", None), (None, 7.0)]
    found = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["v"], [0.5], ["k"]).collect()
    assert {row["k"]: row["value"] for row in found} == {"x": 2.0, "y": 10.0, None: 7.0}
    assert exact_quantiles(spark.createDataFrame(rows, "k string, v double").limit(0), ["v"], [0.5]).collect() == []
