"""The whole run on CSV files, its guards, and the isolation of the test rows."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pastward import schema as S
from pastward.operators import models as M
from pastward.operators.crossval import model_folds, nested_models, persistence_folds
from pastward.operators.features import feature_table
from pastward.operators.splits import chronological_split, development, expanding_folds
from pastward.operators.tuning import SearchSpace, halving_search, search
from pastward.plans import experiment as E
from pastward.session import staged
from pastward.sources.fingerprint import file_hashes, require_files, table_fingerprint
from pastward.sources.sinks import guard_results, write_csv

TINY = M.Sizes(forest_trees=3, forest_depth=3, bagging_trees=3, bagging_depth=3, histogram_rounds=2, histogram_leaves=4, boosting_rounds=2, boosting_depth=2, boosting_rate=0.3)


def lines(n: int, seed: int = 0) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    times = pd.date_range("2020-01-01", periods=n, freq="h")
    return pd.DataFrame(
        {
            "Date": times.strftime("%Y-%m-%d"),
            "Time": [f"{h}:00 - {h + 1}:00" for h in times.hour],
            "Consumption": (500 + 100 * np.sin(2 * np.pi * times.hour / 24) + rng.normal(0, 10, n)).round(2),
            "Temperature": rng.normal(10, 3, n).round(1),
            "Rain": np.where(rng.random(n) < 0.02, np.nan, np.maximum(rng.normal(0, 1, n), 0).round(1)),
            "Sun": rng.integers(0, 60, n).astype(float),
        }
    )


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("input")
    canonical = lines(700)
    doubled = pd.concat([canonical.iloc[:5].assign(Consumption=-1.0), canonical])  # outdated lines come first
    doubled.to_csv(folder / "canonical.csv", index=False)
    canonical.assign(Consumption=canonical["Consumption"].where(canonical.index % 50 > 0)).to_csv(folder / "raw.csv", index=False)
    return folder


def test_whole_run(spark, files, tmp_path, monkeypatch):
    plan = E.Plan(sizes=TINY, space=SearchSpace(rounds=(2, 3, 1), depth=(2, 2)), folds=2, trials=2, search_folds=2, cv_models=(M.BAGGING,), tail=690)
    monkeypatch.setattr(E, "SMOKE_PLAN", plan)
    out = str(tmp_path / "out")
    final = E.run_files(spark, str(files), "canonical.csv", "raw.csv", out, smoke=True)
    rows = final.collect()
    assert [row["role"] for row in rows].count("baseline") == 3 and rows[-1]["role"] == "selected_final_model"
    board = spark.read.csv(f"{out}/candidates", header=True, inferSchema=True).orderBy("mae").collect()
    assert board[0]["model"] == rows[-1]["model"] and len(board) == 10
    quality = spark.read.json(f"{out}/audit").first()
    assert (quality["raw_rows"], quality["canonical_rows"], quality["timestamp_duplicates"]) == (700, 690, 0)
    split = spark.read.json(f"{out}/split").first()
    assert split["rows"] == 690 - 168 and split["train_rows"] == int(522 * 0.7)
    summary = spark.read.json(f"{out}/summary").first()
    assert json.loads(summary["locked_test"])[0]["model"].startswith("naive_lag_")
    assert json.loads(summary["audit"])[0]["canonical_rows"] == 690 and len(json.loads(summary["features"])) == 42
    assert json.loads(summary["split"])[0] | {"series": 1, "rows": 522} == json.loads(summary["split"])[0]
    assert spark.read.json(f"{out}/features").count() == len(S.FEATURES) == 42
    times = spark.read.csv(f"{out}/ensembles/scores", header=True, inferSchema=True)
    assert times.where("fit_seconds > 0").count() == 3
    # results are not replaced, not by a smoke run even when told to
    for smoke, overwrite in ((False, False), (True, True)):
        with pytest.raises(FileExistsError):
            E.run_files(spark, str(files), "canonical.csv", "raw.csv", out, smoke=smoke, overwrite=overwrite)


def test_last_line_of_a_doubled_hour_wins(spark, files):
    from pastward.operators.ordering import keep_last
    from pastward.spec import HOURLY

    series = keep_last(E.read_series(spark, f"{files}/canonical.csv"), HOURLY, "file_order")
    assert series.count() == 700 and series.where("Consumption < 0").count() == 0


def test_required_files(spark, files):
    assert require_files(spark, str(files), ["canonical.csv", "raw.csv"]).count() == 2
    with pytest.raises(FileNotFoundError, match="other.csv"):
        require_files(spark, str(files), ["canonical.csv", "other.csv"])


def test_file_hash(spark, files):
    import hashlib

    got = {row["name"]: row["sha256"] for row in file_hashes(spark, f"{files}/*.csv").collect()}
    assert got["raw.csv"] == hashlib.sha256((files / "raw.csv").read_bytes()).hexdigest()


def test_fingerprint_ignores_order_and_sees_copies(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 0.5)
    one = table_fingerprint(df).first()
    assert table_fingerprint(df.orderBy(F.desc("id")).repartition(7)).first() == one
    assert table_fingerprint(df.unionByName(df.limit(1)).unionByName(df.limit(1))).first() != one
    assert table_fingerprint(df.withColumn("x", F.when(F.col("id") == 5, 0.0).otherwise(F.col("x")))).first() != one


def test_guard(spark, tmp_path):
    path = str(tmp_path / "table")
    guard_results(spark, path, overwrite=False)
    write_csv(spark.range(3), path)
    with pytest.raises(FileExistsError):
        guard_results(spark, path, overwrite=False)
    guard_results(spark, path, overwrite=True)
    with pytest.raises(FileExistsError):
        guard_results(spark, path, overwrite=True, smoke=True)
    with pytest.raises(RuntimeError, match="missing outputs"):
        E.require_outputs(spark, str(tmp_path))


def test_search_is_seeded_and_blind_to_the_test_rows(spark, files):
    series = E.read_series(spark, f"{files}/raw.csv").drop("file_order").fillna({"Consumption": 500.0})
    split = staged(chronological_split(staged(feature_table(series))))
    space = SearchSpace(rounds=(2, 3, 1), depth=(2, 3))
    tested = F.col("split") == "test"
    changed = split.withColumn(S.TARGET, F.when(tested, -1e6).otherwise(F.col(S.TARGET)))
    tables = [
        search(development(frame).drop("split"), space=space, trials=2, folds=2).orderBy("number").collect()
        for frame in (split, changed)
    ]
    assert tables[0] == tables[1] and all(2 <= row["rounds"] <= 3 and row["state"] == "COMPLETE" for row in tables[0])


def test_halving_is_the_full_grid_where_nothing_is_dropped(spark, files):
    series = E.read_series(spark, f"{files}/raw.csv").drop("file_order").fillna({"Consumption": 500.0})
    dev = development(staged(chronological_split(staged(feature_table(series))))).drop("split")
    grid = [{"rounds": n, "depth": 2, "rate": rate, "l2": 2.0} for rate in (0.1, 0.4) for n in (1, 3, 5)]
    whole = {r["number"]: r for r in halving_search(dev, grid, folds=2, keep=1.0).collect()}
    # each trial as a search of its own
    alone = [halving_search(dev, [trial], folds=2).first() for trial in grid]
    assert [whole[k]["value"] for k in range(6)] == pytest.approx([r["value"] for r in alone])
    assert {r["state"] for r in whole.values()} == {"COMPLETE"}
    halved = {r["number"]: r for r in halving_search(dev, grid, folds=2).collect()}
    assert sorted(r["folds"] for r in halved.values()) == [1, 1, 1, 2, 2, 2]
    kept = [k for k, r in halved.items() if r["state"] == "COMPLETE"]
    assert all(halved[k]["value"] == pytest.approx(whole[k]["value"]) for k in kept)
    assert max(halved[k]["value"] for k in kept) < 1e9 and all(r["value"] > 0 for r in halved.values())


def test_choice_inside_outer_training_rows(spark, files):
    series = E.read_series(spark, f"{files}/raw.csv").drop("file_order").fillna({"Consumption": 500.0})
    dev = staged(development(staged(chronological_split(staged(feature_table(series))))).drop("split"))
    specs = [M.model_spec(M.HISTOGRAM, TINY)]
    got = nested_models(dev, specs, outer_folds=2, inner_folds=2).orderBy("outer_fold").collect()
    folded = staged(expanding_folds(dev, folds=2))
    for row in got:
        before = folded.where(F.col("fold") < row["outer_fold"]).drop("fold")
        inner = model_folds(before, specs, folds=2).unionByName(persistence_folds(before, folds=2))
        means = {r["model"]: r["mae"] for r in inner.groupBy("model").agg(F.avg("mae").alias("mae")).collect()}
        assert row["model"] == min(means, key=lambda m: (means[m], m)) and row["inner_mae"] == pytest.approx(means[row["model"]])
        assert (row["train_rows"], row["test_rows"]) == (before.count(), folded.where(F.col("fold") == row["outer_fold"]).count())
        if row["model"].startswith("naive"):
            alone = {r["fold"]: r["mae"] for r in persistence_folds(dev, folds=2).where(F.col("model") == row["model"]).collect()}
            assert row["mae"] == pytest.approx(alone[row["outer_fold"]])
