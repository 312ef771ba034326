"""Preprocessing fitted on training rows only: two branches, as Spark ML estimators."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward import schema as S
from pastward.functions.bands import ordinal_rank
from pastward.functions.yeo_johnson import centred_yeo_johnson, yeo_johnson
from pastward.operators.quantiles import exact_quantiles, present_values

EXACT = 1e-9  # relative width of the interval at which the search for a power ends
# logarithms of transformed values: beyond the first a difference to 1 loses its digits, beyond the second values or their squares their range
LEAST_LOG, MOST_LOG = -20.0, 300.0


def medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians; a column without any value has none and is left out."""
    rows = exact_quantiles(train, columns, [0.5]).collect()  # one row per column
    return {row["column"]: row["value"] for row in rows}


def category_counts(train: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """How often each level of each categorical column occurs."""
    texts = train.select(*(F.col(c).cast("string").alias(c) for c in columns))
    counts = (
        texts.unpivot([], list(columns), "column", "level")
        .where(F.col("level").isNotNull())
        .groupBy("column", "level")
        .agg(F.count("*").alias("rows"))
    )
    found: dict[str, dict[str, int]] = {c: {} for c in columns}
    for row in counts.collect():  # one row per level, which becomes a model input
        found[row["column"]][row["level"]] = row["rows"]
    return found


def most_frequent(levels: dict[str, int]) -> str | None:
    """The level that occurs most, the smallest of equally frequent ones."""
    return min(levels, key=lambda level: (-levels[level], level), default=None)


def impute(name: str, fill: float | str | None) -> Column:
    column = F.col(name)
    if isinstance(fill, float):
        return F.coalesce(F.nanvl(column.cast("double"), F.lit(None)), F.lit(fill))
    return F.coalesce(column.cast("string"), F.lit(fill))


def one_hot(value: Column, levels: Sequence[str]) -> list[Column]:
    """One 0/1 column per level; a level that was not there in training is all zeros."""
    return [F.coalesce((value == level).cast("double"), F.lit(0.0)) for level in levels]


def robust_scale(x: Column, center: float, width: float) -> Column:
    return (x - F.lit(center)) / F.lit(width)


def robust_statistics(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range; a range of zero divides by 1."""
    found: dict[str, dict[float, float]] = {}
    for row in exact_quantiles(train, columns, [0.25, 0.5, 0.75]).collect():  # three rows per column
        found.setdefault(row["column"], {})[row["p"]] = row["value"]
    tiny = 10 * 2.220446049250313e-16
    return {c: (q[0.5], q[0.75] - q[0.25] if q[0.75] - q[0.25] > tiny else 1.0) for c, q in found.items()}


def fit_powers(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The maximum-likelihood power of each column; constant columns keep 1, the identity.

    The likelihood's slope is 0 at its top. Each round evaluates the slope of every column at one power, on all rows, by one
    aggregate; intervals around the tops are widened until the slope changes its sign, and then narrowed.
    """
    part = present_values(train, columns).withColumnRenamed("value", "x").persist()
    try:
        searches = {c: _Search(centre) for c, centre in _centres(part).items()}
        while active := {c: s for c, s in searches.items() if not s.done}:
            for column, slope in _slopes(part, active).items():
                active[column].seen(slope)
    finally:
        part.unpersist()
    return {c: searches[c].best if c in searches else 1.0 for c in columns}


def power_centres(train: DataFrame, powers: dict[str, float]) -> dict[str, float]:
    """Centres for :func:`centred_yeo_johnson`, of the columns on one side of 0 whose transform doubles cannot hold in its plain form.

    These are columns that vary little for their size, as sums of many amounts do, whose powers are large.
    """
    x = F.col("value")
    facts = present_values(train, list(powers)).groupBy("column").agg(
        F.min(x).alias("least"), F.max(x).alias("most"), F.avg(F.log1p(F.abs(x))).alias("centre"), F.max(F.log1p(F.abs(x))).alias("top")
    )
    found = {}
    for row in facts.collect():  # one row per column
        above = row["least"] >= 0
        k = powers[row["column"]] if above else 2.0 - powers[row["column"]]
        if row["least"] < row["most"] and (above or row["most"] < 0) and (k * row["centre"] < LEAST_LOG or k * row["top"] > MOST_LOG):
            found[row["column"]] = row["centre"] if above else -row["centre"]
    return found


def powered(x: Column, name: str, state: dict) -> Column:
    """A column's power transform as it was learned; other columns stay as they are."""
    if name not in state.get("powers", {}):
        return x
    power, centre = state["powers"][name], state.get("centres", {}).get(name)
    return yeo_johnson(x, power) if centre is None else centred_yeo_johnson(x, power, centre)


class _Search:
    """The zero of a falling slope: doubling steps first, then the Illinois variant of the secant rule."""

    def __init__(self, centre: float) -> None:
        self.centre = centre
        self.at, self.step, self.done = 1.0, 0.0, False
        self.low: tuple[float, float] | None = None  # a power where the likelihood rises, and its slope
        self.high: tuple[float, float] | None = None  # one where it falls
        self.side = 0

    @property
    def best(self) -> float:
        return self.at

    def seen(self, slope: float | None) -> None:
        """Take the slope at ``at`` and move on; a slope beyond the range of doubles ends the search where it was last known."""
        if slope is None or not math.isfinite(slope):
            known = [end[0] for end in (self.low, self.high) if end]
            if not known or (self.low and self.high):
                self.done = True
                self.at = known[0] if known else 1.0
            else:  # half as far
                self.step /= 2
                self.at = known[0] + self.step
                self.done = abs(self.step) < EXACT * max(1.0, abs(self.at))
            return
        if slope == 0:
            self.done = True
            return
        rises = slope > 0
        if self.low and self.high:
            if rises:
                if self.side == 1:
                    self.high = (self.high[0], self.high[1] / 2)
                self.low, self.side = (self.at, slope), 1
            else:
                if self.side == -1:
                    self.low = (self.low[0], self.low[1] / 2)
                self.high, self.side = (self.at, slope), -1
        elif rises:
            self.low = (self.at, slope)
        else:
            self.high = (self.at, slope)
        if self.low and self.high:
            (a, up), (b, down) = self.low, self.high
            last, self.at = self.at, (a * down - b * up) / (down - up)
            if not min(a, b) < self.at < max(a, b):
                self.at = (a + b) / 2
            self.done = min(abs(b - a), abs(self.at - last)) <= EXACT * max(1.0, abs(self.at))
        else:
            self.step = 2 * self.step if self.step else (1.0 if rises else -1.0)
            self.at += self.step


def _centres(values: DataFrame) -> dict[str, float]:
    """A centre for the logarithms of each column that has two different values.

    Where all values are on one side of 0, powers of values in units of their geometric mean keep their digits at any power.
    """
    x = F.col("x")
    facts = values.groupBy("column").agg(F.min(x).alias("least"), F.max(x).alias("most"), F.avg(F.log1p(F.abs(x))).alias("centre"))
    rows = facts.where("least < most").collect()  # one row per column
    return {r["column"]: r["centre"] if r["least"] >= 0 or r["most"] < 0 else 0.0 for r in rows}


def _slopes(values: DataFrame, searches: dict[str, _Search]) -> dict[str, float | None]:
    """The slope of each column's mean log-likelihood at the power it asks for.

    With u = log(1 + |x|) less its centre and k the power of the value's side (2 - power below 0), the transform is
    sign·(exp(k·u) - 1) / k up to scale; d is its derivative by the power. The slope is mean(sign·u) - cov(transform, d) /
    var(transform), where the mean vanishes with a centre.
    """
    asked = values.sparkSession.createDataFrame([(c, float(s.at), float(s.centre)) for c, s in searches.items()], "of string, power double, centre double")
    # the powers come as rows, not as literals: every round runs the same compiled code
    rows = values.join(F.broadcast(asked), F.col("column") == F.col("of"))  # one row per column of the model
    below = F.col("x") < 0
    rows = rows.select("column", F.when(below, -1.0).otherwise(1.0).alias("sign"), (F.log1p(F.abs("x")) - F.col("centre")).alias("u"), F.when(below, 2.0 - F.col("power")).otherwise(F.col("power")).alias("k"), "centre")
    u, k = F.col("u"), F.col("k")
    flat = F.abs(k * u) < 1e-5  # series of the quotients near 0
    bent = F.when(flat, u * (1 + k * u / 2 + k * k * u * u / 6)).otherwise(F.try_divide(F.expm1(k * u), k))
    turn = F.when(flat, u * u * (0.5 + k * u / 3)).otherwise(F.try_divide(u * F.exp(k * u) - bent, k))
    rows = rows.select("column", "sign", "u", "centre", (F.col("sign") * bent).alias("bent"), turn.alias("turn"))
    # the derivative by the power has the sign of the side twice: once for the transform, once for 2 - power
    slope = F.avg(F.when(F.col("centre") == 0, F.col("sign") * u).otherwise(0.0)) - F.try_divide(F.covar_pop("bent", "turn"), F.var_pop("bent"))
    return {r["column"]: r["slope"] for r in rows.groupBy("column").agg(slope.alias("slope")).collect()}  # one row per column


def target_statistics(train: DataFrame, target: str = S.TARGET) -> tuple[float, float]:
    """Mean and population deviation of the target on training rows; a deviation of 0 counts as 1."""
    row = train.agg(F.avg(target).alias("mean"), F.stddev_pop(target).alias("std")).first()
    return row["mean"], row["std"] or 1.0


def standardize(value: Column, mean: float, std: float) -> Column:
    return (value - F.lit(mean)) / F.lit(std)


def restore(value: Column, mean: float, std: float) -> Column:
    return value * F.lit(std) + F.lit(mean)


class _PreprocessorParams(HasOutputCol):
    scale = Param(
        Params._dummy(),
        "scale",
        "power transform and robust scaling (for linear models) or imputation only (for trees)",
        typeConverter=TypeConverters.toBoolean,
    )
    powers = Param(
        Params._dummy(),
        "powers",
        "JSON object of frozen powers per continuous column; fitted when empty",
        typeConverter=TypeConverters.toString,
    )

    def __init__(self, *args) -> None:
        super().__init__(*args)
        self._setDefault(scale=False, powers="", outputCol="features")


class FeaturePreprocessor(Estimator, _PreprocessorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns medians, modes, levels and (for the scaled branch) powers and robust scales from training rows."""

    @keyword_only
    def __init__(self, *, scale: bool = False, powers: str = "", outputCol: str = "features") -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FeaturePreprocessorModel:
        scaled = self.getOrDefault("scale")
        dataset = dataset.select(*S.FEATURES)
        numbers = [*S.CONTINUOUS, *S.CYCLICAL]
        counts = category_counts(dataset, [*S.BINARY, *S.NOMINAL, *S.ORDINAL])
        state: dict = {
            "medians": medians(dataset, numbers),
            "modes": {c: most_frequent(levels) for c, levels in counts.items() if levels},
            "levels": {c: sorted(counts[c]) for c in S.NOMINAL},
        }
        if scaled:
            filled = dataset.select(*(impute(c, fill).alias(c) for c, fill in state["medians"].items()))
            continuous = [c for c in S.CONTINUOUS if c in state["medians"]]
            frozen = self.getOrDefault("powers")
            state["powers"] = json.loads(frozen) if frozen else fit_powers(filled, continuous)
            state["centres"] = power_centres(filled, {c: p for c, p in state["powers"].items() if c in filled.columns})
            state["robust"] = robust_statistics(filled.select(*(powered(F.col(c), c, state).alias(c) for c in filled.columns)), filled.columns)
        return FeaturePreprocessorModel(state=json.dumps(state), outputCol=self.getOutputCol())


class FeaturePreprocessorModel(Model, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Applies the learned values; rows keep all their columns and get one vector column."""

    state = Param(Params._dummy(), "state", "learned values as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, state: str = "{}", outputCol: str = "features") -> None:
        super().__init__()
        self._setDefault(state="{}", outputCol="features")
        self._set(**self._input_kwargs)

    def learned(self) -> dict:
        return json.loads(self.getOrDefault("state"))

    def encoded(self) -> dict[str, Column]:
        """The model input, column by column."""
        state = self.learned()
        columns: dict[str, Column] = {}
        for name in (*S.CONTINUOUS, *S.CYCLICAL):
            if name not in state["medians"]:
                continue
            value = powered(impute(name, state["medians"][name]), name, state)
            if "robust" in state:
                value = robust_scale(value, *state["robust"][name])
            columns[name] = value
        for name in S.BINARY:
            if name in state["modes"]:
                columns[name] = impute(name, state["modes"][name]).cast("double")
        for name in S.NOMINAL:
            levels = state["levels"][name]
            if levels:
                filled = impute(name, state["modes"][name])
                columns |= {f"{name}_{lv}": hot for lv, hot in zip(levels, one_hot(filled, levels))}
        for name in S.ORDINAL:
            if name in state["modes"]:
                columns[name] = ordinal_rank(impute(name, state["modes"][name]))
        return columns

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = self.encoded()
        inputs = {f"_in_{name}": column for name, column in columns.items()}
        assembler = VectorAssembler(inputCols=list(inputs), outputCol=self.getOutputCol())
        return assembler.transform(dataset.withColumns(inputs)).drop(*inputs)
