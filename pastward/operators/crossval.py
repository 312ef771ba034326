"""Cross-validation over expanding folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.operators.models import ModelSpec, fit_many, predict_many
from pastward.operators.ordering import with_cutoffs
from pastward.operators.scoring import best_per_group, long_predictions, persistence_names, score, with_persistence
from pastward.operators.splits import expanding_folds
from pastward.schema import METRICS, TARGET
from pastward.session import staged
from pastward.spec import HOURLY, SeriesSpec


def persistence_folds(rows: DataFrame, spec: SeriesSpec = HOURLY, folds: int = 5) -> DataFrame:
    """Fold metrics of the persistence models: nothing is fitted, so all folds are scored in one aggregate."""
    scored = with_persistence(expanding_folds(rows, spec, folds)).where("fold > 0")
    return score(long_predictions(scored, ["fold"], persistence_names()), "fold").select("model", "fold", *METRICS)


def model_folds(rows: DataFrame, models: Sequence[ModelSpec], spec: SeriesSpec = HOURLY, folds: int = 5) -> DataFrame:
    """Fold metrics of fitted models. Each fold fits preprocessing and models on its own earlier rows."""
    folded = staged(expanding_folds(rows, spec, folds))
    names = [model.name for model in models]

    def scored(fold: int) -> DataFrame:
        fitted = fit_many(models, folded.where(F.col("fold") < fold))
        predicted = predict_many(fitted, folded.where(F.col("fold") == fold))
        return score(long_predictions(predicted, ["fold"], names), "fold")

    with ThreadPool(folds) as pool:
        tables = pool.map(inheritable_thread_target(rows.sparkSession)(scored), range(1, folds + 1), chunksize=1)
    return reduce(DataFrame.unionByName, tables).select("model", "fold", *METRICS)


def nested_positions(outer_folds: int, inner_folds: int) -> Callable[[Column], dict[str, Column]]:
    """Where outer folds and, inside their training rows, inner folds begin in a series of ``n`` rows."""

    def outer_start(n: Column, i: int) -> Column:
        return n - (outer_folds - i + 1) * F.floor(n / (outer_folds + 1))

    def positions(n: Column) -> dict[str, Column]:
        marks = {f"_outer_{i}": outer_start(n, i) for i in range(1, outer_folds + 1)}
        for i in range(1, outer_folds + 1):
            prefix = outer_start(n, i)
            size = F.floor(prefix / (inner_folds + 1))
            marks |= {f"_inner_{i}_{j}": prefix - (inner_folds - j + 1) * size for j in range(1, inner_folds + 1)}
        return marks

    return positions


def nested_persistence(rows: DataFrame, spec: SeriesSpec = HOURLY, outer_folds: int = 5, inner_folds: int = 5) -> DataFrame:
    """Per outer fold, the model with the lowest mean MAE over inner folds of its training rows, and its outer score.

    ``rows`` has one line per time with the target and its lags. A row takes part once in every outer fold it belongs to.
    """

    marked = with_persistence(with_cutoffs(rows, spec, nested_positions(outer_folds, inner_folds)))
    ts = F.col(spec.time)

    def reached(mark: str) -> Column:
        return F.coalesce(ts >= F.col(mark), F.lit(False))

    parts = []
    for i in range(1, outer_folds + 1):
        inner = sum((reached(f"_inner_{i}_{j}").cast("int") for j in range(1, inner_folds + 1)), F.lit(0))
        tested = reached(f"_outer_{i}")
        after = reached(f"_outer_{i + 1}") if i < outer_folds else F.lit(False)
        # part 0 is the outer test, 1… are the inner folds
        part = F.when(after, -1).when(tested, 0).when(inner > 0, inner).otherwise(-1)
        parts.append(F.struct(F.lit(i).alias("outer_fold"), part.alias("part")))
    placed = (
        marked.select("*", F.explode(F.array(*parts)).alias("place"))
        .select(TARGET, *persistence_names(), "place.*")
        .where("part >= 0")
    )
    scores = score(long_predictions(placed, ["outer_fold", "part"], persistence_names()), "outer_fold", "part")
    # one row per outer fold, part and model from here on
    scores = staged(scores)
    inner_means = scores.where("part > 0").groupBy("outer_fold", "model").agg(F.avg("mae").alias("inner_mae"))
    winners = best_per_group(inner_means, "outer_fold", by="inner_mae")
    return winners.join(scores.where("part = 0"), ["outer_fold", "model"]).select(
        "outer_fold", "model", "inner_mae", *METRICS
    )


def nested_models(
    rows: DataFrame, models: Sequence[ModelSpec], spec: SeriesSpec = HOURLY, outer_folds: int = 5, inner_folds: int = 3
) -> DataFrame:
    """Choice among models inside every outer training set: ``outer_fold, model, inner_mae, train_rows, test_rows`` and the metrics on the outer fold.

    Each outer training set is cut into expanding inner folds; fitted models and the persistence models are scored there, the one with the lowest mean MAE
    is fitted on the whole outer training set and scored on the outer fold, which no choice has seen. Equal errors go by name.
    """
    folded = staged(expanding_folds(rows, spec, outer_folds))
    by_name = {model.name: model for model in models}

    def chosen(outer: int) -> DataFrame:
        before, after = folded.where(F.col("fold") < outer).drop("fold"), folded.where(F.col("fold") == outer).drop("fold")
        inner = model_folds(before, models, spec, inner_folds).unionByName(persistence_folds(before, spec, inner_folds))
        means = staged(inner.groupBy("model").agg(F.avg("mae").alias("inner_mae")))
        best = means.orderBy("inner_mae", "model").first()
        fitted = fit_many([by_name[best["model"]]], before) if best["model"] in by_name else []
        predicted = predict_many(fitted, with_persistence(after)).withColumn("outer_fold", F.lit(outer))
        scores = score(long_predictions(predicted, ["outer_fold"], [best["model"]]), "outer_fold")
        facts = [F.lit(best["inner_mae"]).alias("inner_mae"), F.lit(before.count()).alias("train_rows"), F.lit(after.count()).alias("test_rows")]
        return scores.select("outer_fold", "model", *facts, *METRICS)

    with ThreadPool(outer_folds) as pool:
        tables = pool.map(inheritable_thread_target(rows.sparkSession)(chosen), range(1, outer_folds + 1), chunksize=1)
    return reduce(DataFrame.unionByName, tables)
