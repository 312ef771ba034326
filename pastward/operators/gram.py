"""Linear models of many training sets from one scan: means and co-moments add up.

Rows are told apart by a whole number ``part``, such as a fold or the set of cuts that a row lies behind. One scan gives the count, the means
and the centred co-moments of inputs and target for every part; those of any training set are merged from its parts. Ridge and
lasso are solved on them, and squared errors on any other set follow from its own, without its rows.

Sizes: one matrix of inputs by inputs for each part; the rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.operators.crossval import nested_positions
from pastward.operators.ordering import with_cutoffs
from pastward.operators.splits import expanding_folds
from pastward.schema import TARGET
from pastward.session import staged
from pastward.spec import HOURLY, SeriesSpec

FAN_IN = 64  # partial results that are merged at once
TIGHT = 1e-12  # relative change at which coordinate descent ends
MOST_SWEEPS = 100_000


@dataclass(frozen=True)
class Gram:
    """Rows, means and centred co-moments of some columns, the target last."""

    n: float
    mean: np.ndarray
    moment: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Gram:
        mean = values.mean(0) if len(values) else np.zeros(values.shape[1])
        centred = values - mean
        return cls(float(len(values)), mean, centred.T @ centred)

    def __add__(self, other: Gram) -> Gram:
        n = self.n + other.n
        if not n:
            return self
        step = other.mean - self.mean
        return Gram(n, self.mean + step * (other.n / n), self.moment + other.moment + np.outer(step, step) * (self.n * other.n / n))

    def scales(self) -> np.ndarray:
        """Population deviations of the inputs."""
        return np.sqrt(np.diag(self.moment)[:-1] / max(self.n, 1.0))

    def ridge(self, alpha: float) -> Linear:
        """Least squares plus ``alpha`` times the squared weights of the standardised inputs; constant inputs weigh nothing."""
        xx, xy = self.moment[:-1, :-1], self.moment[:-1, -1]
        used = np.flatnonzero(self.scales() > 0)
        weights = np.zeros(len(xy))
        if len(used):
            inner = xx[np.ix_(used, used)] + np.diag(alpha * self.scales()[used] ** 2)
            weights[used] = np.linalg.lstsq(inner, xy[used], rcond=None)[0]
        return self._line(weights)

    def _line(self, weights: np.ndarray) -> Linear:
        return Linear(weights, float(self.mean[-1] - weights @ self.mean[:-1]))

    def correlations(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the inputs that vary: their numbers, their correlation matrix, and their covariances with the target in units of their deviations."""
        scale = self.scales()
        used = np.flatnonzero(scale > 0)
        s = scale[used]
        return used, self.moment[np.ix_(used, used)] / (self.n * np.outer(s, s)), self.moment[used, -1] / (self.n * s)

    def lasso_path(self, penalties: Sequence[float]) -> list[Linear]:
        """Half the mean squared error plus a penalty times the absolute weights of the standardised inputs, for each penalty in turn.

        Coordinate descent; every solution starts the next.
        """
        used, q, c = self.correlations()
        w, out = np.zeros(len(used)), []
        for penalty in penalties:
            w = descended(q, c, w, penalty)
            whole = np.zeros(len(self.mean) - 1)
            whole[used] = w / self.scales()[used]
            out.append(self._line(whole))
        return out

    def largest_penalty(self) -> float:
        """The least penalty at which all weights are 0."""
        return float(np.abs(self.correlations()[2]).max(initial=0.0))

    def squared_error(self, line: Linear) -> float:
        """The sum of squared errors of a line on these rows."""
        direction = np.append(-line.weights, 1.0)
        shift = direction @ self.mean - line.intercept
        return float(max(direction @ self.moment @ direction, 0.0) + self.n * shift * shift)

    def scores(self, line: Linear) -> tuple[float | None, float | None]:
        """Root mean squared error and R²; both null without rows, R² also for a constant target."""
        if not self.n:
            return None, None
        error, spread = self.squared_error(line), float(self.moment[-1, -1])
        return (error / self.n) ** 0.5, 1 - error / spread if spread > 0 else None


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    intercept: float

    def column(self, columns: Sequence[str]) -> Column:
        """The prediction as a column expression."""
        return reduce(lambda a, b: a + b, (F.col(c) * F.lit(float(w)) for c, w in zip(columns, self.weights)), F.lit(self.intercept))


def descended(q: np.ndarray, c: np.ndarray, start: np.ndarray, penalty: float) -> np.ndarray:
    """Soft-threshold steps for one weight at a time until none moves; ``q`` has ones on its diagonal."""
    w, pull = start.copy(), c - q @ start
    for _ in range(MOST_SWEEPS):
        most = 0.0
        for j in range(len(w)):
            rho = pull[j] + w[j]
            new = np.sign(rho) * max(abs(rho) - penalty, 0.0)
            if new != w[j]:
                pull -= q[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most <= TIGHT * max(1.0, np.abs(w).max(initial=0.0)):
            return w
    raise RuntimeError("coordinate descent did not settle")


SHAPE = "part long, slice long, rows double, mean binary, moment binary"


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Gram] = {}
    for rows in batches:
        parts = rows.column("part").to_numpy(zero_copy_only=False)
        values = np.stack([rows.column(k).to_numpy(zero_copy_only=False) for k in range(1, rows.num_columns)], 1)
        for part in np.unique(parts).tolist():
            found = Gram.of(values[parts == part])
            held[part] = held[part] + found if part in held else found
    if held:
        grams = list(held.values())
        yield pa.RecordBatch.from_pydict({"part": list(held), "rows": [g.n for g in grams], "mean": [g.mean.tobytes() for g in grams], "moment": [g.moment.tobytes() for g in grams]})


def _read(rows, mean, moment) -> Gram:
    mean = np.frombuffer(mean)
    return Gram(rows, mean, np.frombuffer(moment).reshape(len(mean), len(mean)))


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("slice")
    total = reduce(lambda a, b: a + b, (_read(*r) for r in zip(rows["rows"], rows["mean"], rows["moment"])))
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "slice": [key[1]], "rows": [total.n], "mean": [total.mean.tobytes()], "moment": [total.moment.tobytes()]})


def grams(df: DataFrame, part: Column, columns: Sequence[str], target: str = TARGET) -> dict[int, Gram]:
    """The Gram matrix of each part, in one scan. Rows that lack a value or have a NaN are left out, as they could not be fitted."""
    numbers = [F.col(c).cast("double") for c in (*columns, target)]
    rows = df.select(part.cast("long").alias("part"), *(x.alias(f"x{k}") for k, x in enumerate(numbers)))
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(f"x{k}").isNotNull() & ~F.isnan(f"x{k}") for k in range(len(numbers))), F.col("part").isNotNull()))
    found = rows.mapInArrow(_partials, "part long, rows double, mean binary, moment binary")
    held = staged(found.withColumn("slice", F.spark_partition_id().cast("long")).select(*SHAPE.replace(",", "").split()[::2]))
    while True:
        held = staged(held.groupBy("part", F.expr(f"slice div {FAN_IN}").alias("_group")).applyInPandas(_merged, SHAPE))
        if not held.agg(F.max("slice")).first()[0]:
            return {r["part"]: _read(r["rows"], r["mean"], r["moment"]) for r in held.collect()}  # one matrix per part


def merged(found: dict[int, Gram], wanted: Callable[[int], bool], inputs: int) -> Gram:
    empty = Gram(0.0, np.zeros(inputs + 1), np.zeros((inputs + 1, inputs + 1)))
    return reduce(lambda a, b: a + b, (found[k] for k in sorted(found) if wanted(k)), empty)


def ridge_folds(rows: DataFrame, columns: Sequence[str], alpha: float, spec: SeriesSpec = HOURLY, folds: int = 5) -> DataFrame:
    """``fold, train_rows, test_rows, rmse, r2`` of ridge over expanding folds, from one scan."""
    found = grams(expanding_folds(rows, spec, folds), F.col("fold"), columns)
    out = []
    for fold in range(1, folds + 1):
        train, test = (merged(found, wanted, len(columns)) for wanted in (lambda k: k < fold, lambda k: k == fold))  # noqa: B023
        out.append((fold, int(train.n), int(test.n), *test.scores(train.ridge(alpha))))
    return rows.sparkSession.createDataFrame(out, "fold int, train_rows long, test_rows long, rmse double, r2 double")


def nested_ridge(
    rows: DataFrame, columns: Sequence[str], alphas: Sequence[float], spec: SeriesSpec = HOURLY, outer_folds: int = 5, inner_folds: int = 5
) -> DataFrame:
    """Ridge tuned inside every outer training set: ``outer_fold, alpha, inner_rmse, train_rows, rmse, r2``, one row per outer fold.

    The penalty with the lowest mean error over the inner folds is fitted on the whole outer training set and scored on the outer fold. All sets are unions
    of the stretches between cuts, so one scan serves ``outer_folds * inner_folds * len(alphas)`` fits. A row takes part once. Inner folds without rows to train
    on or to score do not count; an outer fold without them, or without any inner fold that counts, has no row.
    """
    positions = nested_positions(outer_folds, inner_folds)
    marks = [f"_outer_{i}" for i in range(1, outer_folds + 1)] + [f"_inner_{i}_{j}" for i in range(1, outer_folds + 1) for j in range(1, inner_folds + 1)]
    if len(marks) > 62:
        raise ValueError("more cuts than a whole number has bits")
    bit = {mark: 1 << k for k, mark in enumerate(marks)}
    marked = with_cutoffs(rows, spec, positions)
    behind = [F.when(F.col(spec.time) >= F.col(mark), F.lit(bit[mark])).otherwise(F.lit(0)).cast("long") for mark in marks]
    found = grams(marked, reduce(lambda a, b: a + b, behind), columns)

    def between(low: str | None, high: str | None) -> Gram:
        return merged(found, lambda k: (low is None or k & bit[low] > 0) and (high is None or not k & bit[high]), len(columns))

    def mean(errors: Iterable[float | None]) -> float:
        known = [e for e in errors if e is not None]
        return sum(known) / len(known) if known else float("inf")

    out = []
    for i in range(1, outer_folds + 1):
        ends = [f"_inner_{i}_{j}" for j in range(1, inner_folds + 1)] + [f"_outer_{i}"]
        inner = [(between(None, ends[j]), between(ends[j], ends[j + 1])) for j in range(inner_folds)]
        errors = {a: mean(test.scores(train.ridge(a))[0] for train, test in inner if train.n) for a in alphas}
        best = min(alphas, key=lambda a: (errors[a], a))
        train, test = between(None, ends[-1]), between(ends[-1], f"_outer_{i + 1}" if i < outer_folds else None)
        if train.n and test.n and errors[best] < float("inf"):
            out.append((i, float(best), errors[best], int(train.n), *test.scores(train.ridge(best))))
    return rows.sparkSession.createDataFrame(out, "outer_fold int, alpha double, inner_rmse double, train_rows long, rmse double, r2 double")


def penalties(largest: float, count: int = 20, least: float = 1e-3) -> list[float]:
    """Penalties from the largest one down to a share of it, in equal ratios."""
    return [largest * least ** (k / max(count - 1, 1)) for k in range(count)]


def lasso_path(train: DataFrame, columns: Sequence[str], shares: Sequence[float] | None = None, target: str = TARGET) -> DataFrame:
    """``step, penalty, feature, weight`` along falling penalties, ``shares`` of the one at which all weights are 0; weights are for the inputs as they are."""
    gram = merged(grams(train, F.lit(0), columns, target), lambda _: True, len(columns))
    most = gram.largest_penalty()
    steps = [most * s for s in shares] if shares is not None else penalties(most)
    lines = gram.lasso_path(steps)
    rows = [(k, float(p), c, float(w)) for k, (p, line) in enumerate(zip(steps, lines)) for c, w in zip((*columns, "intercept"), (*line.weights, line.intercept))]
    return train.sparkSession.createDataFrame(rows, "step int, penalty double, feature string, weight double")
