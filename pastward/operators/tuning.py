"""Seeded random search over boosted trees, scored by mean MAE over expanding folds."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.operators.models import FULL, SEED, TUNED, Sizes, fit_prepared, model_spec, packed, resized
from pastward.operators.preprocess import FeaturePreprocessor
from pastward.operators.splits import expanding_folds
from pastward.operators.tree_model import TreeEnsemble
from pastward.schema import TARGET
from pastward.session import staged
from pastward.spec import HOURLY, SeriesSpec

TRIALS = "number int, value double, state string, rounds int, depth int, rate double, child int, rows double, columns double, l1 double, l2 double"


@dataclass(frozen=True)
class SearchSpace:
    """Ranges of the search, ends included; rate and penalties are drawn by their logarithms."""

    # The searched ranges.
    rounds: tuple[int, int, int] = (180, 500, 80)
    depth: tuple[int, int] = (4, 10)
    rate: tuple[float, float] = (0.02, 0.12)
    child: tuple[int, int] = (1, 8)
    rows: tuple[float, float] = (0.7, 1.0)
    columns: tuple[float, float] = (0.7, 1.0)
    l1: tuple[float, float] = (1e-8, 1.0)
    l2: tuple[float, float] = (0.1, 10.0)

    def draw(self, rng: random.Random) -> dict[str, float]:
        low, high, step = self.rounds

        def by_logarithm(ends: tuple[float, float]) -> float:
            return math.exp(rng.uniform(*map(math.log, ends)))

        return {
            "rounds": rng.randrange(low, high + 1, step),
            "depth": rng.randint(*self.depth),
            "rate": by_logarithm(self.rate),
            "child": rng.randint(*self.child),
            "rows": rng.uniform(*self.rows),
            "columns": rng.uniform(*self.columns),
            "l1": by_logarithm(self.l1),
            "l2": by_logarithm(self.l2),
        }


def trial_sizes(params: dict[str, float], sizes: Sizes = FULL) -> Sizes:
    return resized(sizes, **{f"boosting_{name}": value for name, value in params.items()})


def search(
    rows: DataFrame,
    spec: SeriesSpec = HOURLY,
    space: SearchSpace = SearchSpace(),
    trials: int = 8,
    folds: int = 3,
    seed: int = SEED,
    parallel: int = 8,
) -> DataFrame:
    """One row per trial with its parameters and its mean fold MAE.

    No searched parameter touches the preprocessing, so it is fitted once per fold and the prepared rows serve all trials.
    """
    spark = rows.sparkSession
    prepared = _folds(rows, spec, folds)
    rng = random.Random(seed)
    drawn = [space.draw(rng) for _ in range(trials)]

    def fold_error(job: tuple[int, int]) -> float:
        number, fold = job
        preprocessing, train, test = prepared[fold]
        model = fit_prepared(model_spec(TUNED, trial_sizes(drawn[number])), preprocessing, train)
        error = F.avg(F.abs(F.col(TARGET) - F.col(TUNED)))
        return model.add_prediction(test).agg(error).first()[0]

    jobs = [(number, fold) for number in range(trials) for fold in range(folds)]
    with ThreadPool(min(parallel, len(jobs))) as pool:
        errors = pool.map(inheritable_thread_target(spark)(fold_error), jobs, chunksize=1)
    # one small row per trial
    table = [
        (number, sum(errors[number * folds : (number + 1) * folds]) / folds, "COMPLETE", *params.values())
        for number, params in enumerate(drawn)
    ]
    return spark.createDataFrame(table, TRIALS)


HALVED = "number int, value double, state string, folds int, rounds int, depth int, rate double, child int, rows double, columns double, l1 double, l2 double"


def _folds(rows: DataFrame, spec: SeriesSpec, folds: int) -> list[tuple]:
    """Preprocessing, training and scored rows of each fold, prepared once for all trials."""
    folded = staged(expanding_folds(rows, spec, folds))
    prepared = []
    for fold in range(1, folds + 1):
        train, test = folded.where(F.col("fold") < fold), folded.where(F.col("fold") == fold)
        preprocessing = FeaturePreprocessor(scale=False).fit(train)
        prepared.append((preprocessing, *(packed(preprocessing.transform(part).select(TARGET, "features")) for part in (train, test))))
    return prepared


def staged_errors(model: TreeEnsemble, scored: DataFrame, counts: Sequence[int]) -> list[float]:
    """Mean absolute errors of the first so many trees, all from one pass over the rows."""
    wide = scored.select(TARGET, model.staged_column(list(counts)).alias("_staged"))
    errors = [F.avg(F.abs(F.col(TARGET) - F.get("_staged", F.lit(k)))) for k in range(len(counts))]
    return list(wide.agg(*(e.alias(f"e{k}") for k, e in enumerate(errors))).first())


def halving_search(
    rows: DataFrame, trials: Sequence[dict[str, float]], spec: SeriesSpec = HOURLY, folds: int = 3, keep: float = 0.5, parallel: int = 8
) -> DataFrame:
    """Mean fold errors of given trials; after each fold only the share ``keep`` with the lowest errors so far goes on.

    Trials that differ in ``rounds`` alone are one fit: shorter runs are scored by its first trees. ``state`` is ``COMPLETE`` for trials that saw every
    fold, else ``PRUNED`` with the mean over the ``folds`` they saw. With ``keep=1`` it is the full grid. Equal errors go by number.
    """
    spark = rows.sparkSession
    names = ("rounds", "depth", "rate", "child", "rows", "columns", "l1", "l2")
    default = {"child": FULL.boosting_child, "rows": FULL.boosting_rows, "columns": FULL.boosting_columns, "l1": FULL.boosting_l1, "l2": FULL.boosting_l2}
    drawn = [default | dict(trial) for trial in trials]
    errors: list[list[float]] = [[] for _ in drawn]
    alive = list(range(len(drawn)))
    for fold, (preprocessing, train, test) in enumerate(_folds(rows, spec, folds), 1):
        families: dict[tuple, list[int]] = {}
        for number in alive:
            families.setdefault(tuple(drawn[number][n] for n in names[1:]), []).append(number)

        def scored(numbers: list[int], train: DataFrame = train, test: DataFrame = test, preprocessing=preprocessing) -> list[float]:
            longest = max(numbers, key=lambda n: drawn[n]["rounds"])
            fitted = fit_prepared(model_spec(TUNED, trial_sizes(drawn[longest])), preprocessing, train)
            return staged_errors(fitted.model, test, [int(drawn[n]["rounds"]) for n in numbers])

        with ThreadPool(min(parallel, len(families))) as pool:
            found = pool.map(inheritable_thread_target(spark)(scored), families.values(), chunksize=1)
        for numbers, values in zip(families.values(), found):
            for number, value in zip(numbers, values):
                errors[number].append(value)
        if fold < folds:
            ranked = sorted(alive, key=lambda n: (sum(errors[n]) / len(errors[n]), n))
            alive = sorted(ranked[: max(1, math.ceil(keep * len(alive)))])
    # one small row per trial
    table = [
        (n, sum(e) / len(e), "COMPLETE" if len(e) == folds else "PRUNED", len(e), *(type_(drawn[n][c]) for c, type_ in zip(names, (int, int, float, int, float, float, float, float))))
        for n, e in enumerate(errors)
    ]
    return spark.createDataFrame(table, HALVED)


def best_trial(trials: DataFrame) -> dict[str, float]:
    """The parameters of the trial with the lowest error, the earliest of equal ones."""
    row = trials.where("state = 'COMPLETE'").orderBy("value", "number").first()
    return {name: row[name] for name in ("rounds", "depth", "rate", "child", "rows", "columns", "l1", "l2")}
