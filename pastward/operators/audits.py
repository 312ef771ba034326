"""Checks on features, predictions and outputs. Each returns the offending rows or counts; none repairs anything."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.functions.errors import is_finite
from pastward.operators.ordering import ROW, ROWS, number_rows, with_cutoffs
from pastward.operators.scoring import score
from pastward.schema import METRICS, TARGET
from pastward.session import staged
from pastward.spec import HOURLY, SeriesSpec


def causality_violations(
    series: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    spec: SeriesSpec = HOURLY,
    share: float = 0.5,
    value: str = TARGET,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Change the target from one row of each series on, and count the features that notice up to that row.

    ``build`` makes the features from a series. ``feature, rows, mismatches``: a past-only feature has 0 mismatches.
    """
    marked = staged(with_cutoffs(series, spec, lambda rows: {"_turn": F.floor(rows * F.lit(share))}))
    changed = F.when(F.col(spec.time) >= F.col("_turn"), F.col(value) * 3 + 1000).otherwise(F.col(value))
    perturbed = marked.withColumn(value, changed).select(*series.columns)

    def values(frame: DataFrame, prefix: str) -> DataFrame:
        return build(frame).select(spec.key, spec.time, *(F.col(f).alias(f"{prefix}{f}") for f in features))

    turns = marked.select(spec.key, spec.time, "_turn")
    both = values(marked.select(*series.columns), "a_").join(values(perturbed, "b_"), [spec.key, spec.time]).join(turns, [spec.key, spec.time])
    upto = both.where(F.col(spec.time) <= F.col("_turn"))
    kinds = dict(both.dtypes)

    counts = upto.agg(F.count("*").alias("rows"), *(F.count_if(_differs(kinds, f, tolerance)).alias(f) for f in features))
    return counts.unpivot(["rows"], list(features), "feature", "mismatches")


def causality_by_row(
    series: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    depth: int,
    spec: SeriesSpec = HOURLY,
    ahead: int = 1,
    value: str = TARGET,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Every row whose features notice a change of the target at or behind it: ``feature, key, time, turns``.

    Each row is a turn once: a short series of the ``depth`` rows before it, itself and ``ahead`` rows behind it is built twice, the second time with the
    target changed from the turn on, and the rows up to the turn have to agree. All turns are series of one table, so two builds check every position.
    ``depth`` is how far back the features look (so that they have a value at the turn), ``ahead`` how far ahead a mistake may reach; a row takes part
    in ``depth + ahead + 1`` short series. Keys are told apart as text. ``turns`` counts the turns that a row notices.
    """
    if depth < 1 or ahead < 0:
        raise ValueError("depth must be 1 or more, ahead 0 or more")
    taken = {c.lower() for c in series.columns}
    own, at, turn = (next(n for n in (name + "_" * k for k in range(99)) if n not in taken) for name in ("_own_key", "_at", "_turn"))
    numbered = number_rows(series, spec)
    turns = F.sequence(F.greatest(F.col(ROW) - ahead, F.lit(0)), F.least(F.col(ROW) + depth, F.col(ROWS) - 1))
    copies = numbered.select("*", F.col(spec.key).alias(own), F.col(ROW).alias(at), F.explode(turns).alias(turn))
    copies = staged(copies.withColumn(spec.key, F.concat_ws("|", F.col(turn), F.col(own).cast("string"))).drop(ROW, ROWS))
    changed = F.when(F.col(at) >= F.col(turn), F.col(value) * 3 + 1000).otherwise(F.col(value))

    def values(frame: DataFrame, prefix: str) -> DataFrame:
        return build(frame.select(*series.columns)).select(spec.key, spec.time, *(F.col(f).alias(f"{prefix}{f}") for f in features))

    keys = [spec.key, spec.time]
    upto = copies.where(F.col(at) <= F.col(turn)).select(*keys, own)
    both = values(copies, "a_").join(values(copies.withColumn(value, changed), "b_"), keys).join(upto, keys)
    kinds = dict(both.dtypes)
    noticed = F.array_compact(F.array(*(F.when(_differs(kinds, f, tolerance), F.lit(f)) for f in features)))
    found = both.select(F.col(own).alias(spec.key), spec.time, F.explode(noticed).alias("feature"))
    return found.groupBy("feature", spec.key, spec.time).agg(F.count("*").alias("turns"))


def _differs(kinds: dict[str, str], feature: str, tolerance: float) -> Column:
    """Whether ``a_`` and ``b_`` of a feature differ; sums of the same numbers may do so in their last digits."""
    a, b = F.col(f"a_{feature}"), F.col(f"b_{feature}")
    if kinds[f"a_{feature}"] != "double":
        return ~F.equal_null(a, b)
    close = F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return ~(F.equal_null(a, b) | F.coalesce(close, F.lit(False)))


def missing_names(required: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """Required names that are not present."""
    return required.select(name).distinct().join(present.select(name), name, "left_anti")


def non_finite_metrics(metrics: DataFrame) -> DataFrame:
    """Metric rows with a value that is missing, NaN or infinite."""
    return metrics.where(~_all_finite())


def require_finite(metrics: DataFrame) -> DataFrame:
    """The metric rows, or an error when one has a value that is not finite."""
    first = METRICS[0]
    checked = F.when(_all_finite(), F.col(first)).otherwise(F.raise_error(F.lit("a metric is not finite")))
    return metrics.withColumn(first, checked)


def _all_finite() -> Column:
    ok = F.lit(True)
    for name in METRICS:
        ok = ok & is_finite(F.col(name))
    return ok


def replay_metrics(predictions: DataFrame, stored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Recompute metrics from stored predictions next to the stored ones: largest difference, and whether it is small."""
    names = {name: f"stored_{name}" for name in METRICS}
    pairs = score(predictions).join(stored.select("model", *METRICS).withColumnsRenamed(names), "model", "full_outer")
    gap = F.greatest(*(F.abs(F.col(a) - F.col(b)) for a, b in names.items()))
    complete = F.lit(True)
    for a, b in names.items():
        complete = complete & F.col(a).isNotNull() & F.col(b).isNotNull()
    return pairs.select("model", gap.alias("difference"), (complete & (gap <= tolerance)).alias("agrees"))


def prediction_defects(
    predictions: DataFrame, source: DataFrame, spec: SeriesSpec = HOURLY, value: str = TARGET, models: Sequence[str] | None = None
) -> DataFrame:
    """Defects of stored predictions against their source rows: ``defect, rows``, counted for each row and model.

    Every model has to score every source row once, its actual must be the source value, and no row may be new. ``models`` are those that occur in
    the predictions if not given; a row that one of them lacks is not scored.
    """
    keys = [spec.key, spec.time]
    scored = predictions.groupBy(*keys, "model").agg(
        F.count("*").alias("copies"), F.min("actual").alias("least"), F.max("actual").alias("most")
    )
    if models is None:
        models = sorted(r["model"] for r in predictions.select("model").distinct().collect())  # one row per model
    each = F.explode(F.lit(list(models)).cast("array<string>")).alias("model")
    expected = source.select(*keys, F.col(value).alias("source_value"), each)
    both = scored.join(expected.withColumn("known", F.lit(True)), [*keys, "model"], "full_outer")
    counts = both.agg(
        F.count_if(F.col("copies") > 1).alias("scored_more_than_once"),
        F.count_if(F.col("known").isNull()).alias("not_in_source"),
        F.count_if(F.col("copies").isNull()).alias("not_scored"),
        F.count_if(
            F.col("copies").isNotNull()
            & F.col("known").isNotNull()
            & ~(F.equal_null("least", "source_value") & F.equal_null("most", "source_value"))
        ).alias("actual_differs"),
    )
    return counts.unpivot([], counts.columns, "defect", "rows")


def fold_defects(bounds: DataFrame, spec: SeriesSpec = HOURLY) -> DataFrame:
    """Folds that do not grow, that overlap, or whose scored part does not start right after their training part.

    ``bounds`` comes from :func:`pastward.operators.splits.fold_bounds`: a handful of rows per series.
    """
    nxt = bounds.select(
        spec.key,
        (F.col("fold") - 1).alias("fold"),
        F.col("train_rows").alias("next_train_rows"),
        F.col("train_end").alias("next_train_end"),
    )
    joined = bounds.join(nxt, [spec.key, "fold"], "left")
    return joined.select(
        spec.key,
        "fold",
        (F.col("train_end") < F.col("test_start")).alias("chronological"),
        F.coalesce(F.col("next_train_rows") == F.col("train_rows") + F.col("test_rows"), F.lit(True)).alias("expanding"),
        F.coalesce(F.col("next_train_end") == F.col("test_end"), F.lit(True)).alias("adjacent"),
    )
