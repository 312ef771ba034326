from __future__ import annotations

import numpy as np
import pytest

from pastward.operators.audits import fold_defects
from pastward.operators.splits import (
    chronological_split,
    development,
    expanding_folds,
    fold_bounds,
    holdout,
    split_summary,
)
from pastward.spec import SeriesSpec

SMALL = SeriesSpec(block_rows=32)


@pytest.mark.parametrize("n", [1, 2, 7, 10, 20, 100, 552])
def test_split_sizes(hourly, n):
    summary = split_summary(chronological_split(hourly({"a": range(n)}), SMALL), SMALL).first()
    first, second = int(n * 0.70), int(n * 0.85)
    assert (summary["train_rows"], summary["validation_rows"], summary["test_rows"]) == (first, second - first, n - second)
    assert summary["rows"] == n


def test_split_is_per_series_and_in_order(hourly):
    split = chronological_split(hourly({"a": range(200), "b": range(10)}), SMALL).toPandas()
    for _, part in split.sort_values("timestamp").groupby("series_id"):
        order = part["split"].map({"train": 0, "validation": 1, "test": 2}).to_numpy()
        assert (np.diff(order) >= 0).all()
    assert split.groupby(["series_id", "split"]).size()["b"].to_dict() == {"train": 7, "validation": 1, "test": 2}


@pytest.mark.parametrize("share, expected", [(0.8, 3040), (0.9, 3420)])
def test_holdout(hourly, share, expected):
    assert holdout(hourly({"a": range(3800)}), SMALL, share).where("split = 'train'").count() == expected


def test_folds_have_the_published_sizes(hourly):
    folded = expanding_folds(hourly({"a": range(3800)}), SMALL, 5)
    bounds = fold_bounds(folded, SMALL).orderBy("fold").collect()
    assert [row["train_rows"] for row in bounds] == [635, 1268, 1901, 2534, 3167]
    assert [row["test_rows"] for row in bounds] == [633] * 5
    defects = fold_defects(fold_bounds(folded, SMALL), SMALL).collect()
    assert all(row["chronological"] and row["expanding"] and row["adjacent"] for row in defects)


def test_three_folds_of_a_training_prefix(hourly):
    bounds = fold_bounds(expanding_folds(hourly({"a": range(2660)}), SMALL, 3), SMALL).orderBy("fold").collect()
    assert [(row["train_rows"], row["test_rows"]) for row in bounds] == [(665, 665), (1330, 665), (1995, 665)]


def test_development_leaves_the_test_out(hourly):
    split = chronological_split(hourly({"a": range(100)}), SMALL)
    assert development(split).count() == 85
