"""Forecast models: persistence, ridge and tree ensembles of Spark ML, and their weighted vote.

Spark has no extremely random trees, no histogram boosting with a leaf limit and no boosting with penalties; these are
``random_trees`` and ``boosting``, which fit like estimators.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import VarianceThresholdSelector
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.operators.boosting import BoostedTrees
from pastward.operators.preprocess import FeaturePreprocessor, FeaturePreprocessorModel
from pastward.operators.random_trees import RandomTrees
from pastward.operators.scoring import PERSISTENCE, persistence_names, with_persistence
from pastward.operators.tree_model import TreeEnsemble
from pastward.schema import TARGET
from pastward.session import staged

SEED = 42
RIDGE_ALPHA = 2.0

# Own names; fixed values are the weights of the vote.
RIDGE = "ridge_yj_robust"
FOREST = "random_forest_baseline"
BAGGING = "bagged_forest"
HISTOGRAM = "short_boosted_trees"
BOOSTING = "boosted_trees"
VOTING = "voting_regressor"
TUNED = "tuned_boosted_trees"
VOTES = ((BAGGING, 1.0), (HISTOGRAM, 1.0), (BOOSTING, 2.0))


@dataclass(frozen=True)
class Sizes:
    """How much work the tree models do."""

    # The full sizes.
    forest_trees: int = 100
    forest_depth: int = 18
    bagging_trees: int = 70
    bagging_depth: int = 20
    histogram_rounds: int = 180
    histogram_leaves: int = 31
    boosting_rounds: int = 350
    boosting_depth: int = 8
    boosting_rate: float = 0.05
    boosting_child: int = 3
    boosting_rows: float = 0.85
    boosting_columns: float = 0.85
    boosting_l1: float = 0.0
    boosting_l2: float = 1.0


FULL = Sizes()
# fixed values: the sizes of a quick run
SMOKE = Sizes(bagging_trees=40, histogram_rounds=80, boosting_rounds=80)


def _trees(cls, **params):
    return cls(labelCol=TARGET, featuresCol="features", seed=SEED, **params)


def forest(sizes: Sizes = FULL, **params) -> RandomForestRegressor:
    values = dict(
        numTrees=sizes.forest_trees, maxDepth=sizes.forest_depth, minInstancesPerNode=2, featureSubsetStrategy="0.8"
    )
    return _trees(RandomForestRegressor, **(values | params))


def bagging(sizes: Sizes = FULL) -> RandomTrees:
    return RandomTrees(sizes.bagging_trees, sizes.bagging_depth, leaf=2, rows=0.85, columns=0.9, seed=SEED)


def histogram_boosting(sizes: Sizes = FULL) -> BoostedTrees:
    return BoostedTrees(sizes.histogram_rounds, 0.07, leaves=sizes.histogram_leaves, l2=0.5, child=20, seed=SEED)


def boosting(sizes: Sizes = FULL) -> BoostedTrees:
    return BoostedTrees(
        sizes.boosting_rounds,
        sizes.boosting_rate,
        depth=sizes.boosting_depth,
        l1=sizes.boosting_l1,
        l2=sizes.boosting_l2,
        child=sizes.boosting_child,
        rows=sizes.boosting_rows,
        columns=sizes.boosting_columns,
        seed=SEED,
    )


def ridge(train: DataFrame, alpha: float = RIDGE_ALPHA) -> Pipeline:
    """Least squares plus ``alpha`` times the squared weights, as one normal equation.

    Spark divides the loss by the number of rows and penalises on the scaled target, hence the factor. Constant inputs
    weigh nothing but would make the equation singular, so they are left out.
    """
    facts = train.agg(F.count("*").alias("n"), F.stddev_pop(TARGET).alias("std")).first()
    varying = VarianceThresholdSelector(featuresCol="features", outputCol="_varying", varianceThreshold=0.0)
    regression = LinearRegression(
        labelCol=TARGET,
        featuresCol="_varying",
        solver="normal",
        elasticNetParam=0.0,
        standardization=False,
        regParam=alpha * (facts["std"] or 0.0) / facts["n"],
    )
    return Pipeline(stages=[varying, regression])


def linear(**params) -> LinearRegression:
    """Plain least squares; ``regParam`` with ``elasticNetParam=1`` makes it a lasso."""
    return LinearRegression(labelCol=TARGET, featuresCol="features", **params)


def decision_tree(depth: int = 5) -> DecisionTreeRegressor:
    return _trees(DecisionTreeRegressor, maxDepth=depth)


@dataclass
class FittedModel:
    """A named model with its preprocessing; adds one prediction column and keeps all others."""

    name: str
    preprocessing: FeaturePreprocessorModel
    model: Model | TreeEnsemble
    fit_seconds: float = 0.0

    def predict(self, df: DataFrame) -> DataFrame:
        return self.add_prediction(self.preprocessing.transform(df)).drop("features")

    def add_prediction(self, prepared: DataFrame) -> DataFrame:
        return self.model.transform(prepared).drop("_varying").withColumnRenamed("prediction", self.name)


@dataclass
class ModelSpec:
    """What to fit: the preprocessing branch and how the estimator is made from prepared training rows."""

    name: str
    scale: bool
    make: Callable[[DataFrame], Estimator | BoostedTrees | RandomTrees] = field(repr=False)


def model_spec(name: str, sizes: Sizes = FULL) -> ModelSpec:
    makers = {
        RIDGE: ModelSpec(RIDGE, True, ridge),
        FOREST: ModelSpec(FOREST, False, lambda _: forest(sizes)),
        BAGGING: ModelSpec(BAGGING, False, lambda _: bagging(sizes)),
        HISTOGRAM: ModelSpec(HISTOGRAM, False, lambda _: histogram_boosting(sizes)),
        BOOSTING: ModelSpec(BOOSTING, False, lambda _: boosting(sizes)),
        TUNED: ModelSpec(TUNED, False, lambda _: boosting(sizes)),
    }
    if name not in makers:
        raise ValueError(f"unknown model: {name}")
    return makers[name]


def fit_prepared(spec: ModelSpec, preprocessing: FeaturePreprocessorModel, prepared: DataFrame) -> FittedModel:
    """Fit on rows that already carry the input vector; the time covers the fit alone."""
    start = time.monotonic()
    model = spec.make(prepared).fit(prepared)
    return FittedModel(spec.name, preprocessing, model, time.monotonic() - start)


TASK_ROWS = 20_000  # prepared rows of one task; a tree's many small jobs cost more than their rows


def packed(prepared: DataFrame) -> DataFrame:
    """Staged rows in as many partitions as their number asks for."""
    held = staged(prepared)
    return held.coalesce(max(1, -(-held.count() // TASK_ROWS)))


def fit_many(specs: Sequence[ModelSpec], train: DataFrame) -> list[FittedModel]:
    """Fit several models; those of one branch share the preprocessing and the prepared rows."""
    fitted: dict[str, FittedModel] = {}
    for scale in sorted({spec.scale for spec in specs}):
        preprocessing = FeaturePreprocessor(scale=scale).fit(train)
        prepared = packed(preprocessing.transform(train).select(TARGET, "features"))
        for spec in specs:
            if spec.scale == scale:
                fitted[spec.name] = fit_prepared(spec, preprocessing, prepared)
    return [fitted[spec.name] for spec in specs]


def predict_many(models: Sequence[FittedModel], df: DataFrame) -> DataFrame:
    """All predictions as columns of the same rows: no joins. Models of one branch share the input vector."""
    out = df
    remaining = list(models)
    while remaining:
        preprocessing = remaining[0].preprocessing
        same = [m for m in remaining if m.preprocessing is preprocessing]
        out = reduce(lambda frame, m: m.add_prediction(frame), same, preprocessing.transform(out)).drop("features")
        remaining = [m for m in remaining if m.preprocessing is not preprocessing]
    return out


def vote(members: Sequence[tuple[str, float]] = VOTES) -> Column:
    """The weighted mean of prediction columns."""
    total = reduce(lambda a, b: a + b, (F.col(name) * F.lit(weight) for name, weight in members))
    return total / F.lit(sum(weight for _, weight in members))


def fit_selected(name: str, train: DataFrame, sizes: Sizes = FULL, tuned: Sizes | None = None) -> list[FittedModel]:
    """The models a selected name needs: none for persistence, three for the vote."""
    if name.startswith(PERSISTENCE):
        return []
    if name == VOTING:
        return fit_many([model_spec(member, sizes) for member, _ in VOTES], train)
    return fit_many([model_spec(name, tuned if name == TUNED and tuned else sizes)], train)


def predict_selected(name: str, models: Sequence[FittedModel], df: DataFrame) -> DataFrame:
    """Add the selected model's column next to the persistence baselines."""
    wide = with_persistence(df)
    if name in persistence_names():
        return wide
    wide = predict_many(models, wide)
    return wide.withColumn(VOTING, vote()) if name == VOTING else wide


def resized(sizes: Sizes, **changes) -> Sizes:
    return replace(sizes, **changes)
