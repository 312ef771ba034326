"""The whole run: audit, features, split, baselines, ensembles, cross-validation, search, choice, locked test, gate."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward import schema as S
from pastward.operators import models as M
from pastward.operators.audits import require_finite
from pastward.operators.crossval import model_folds
from pastward.operators.features import feature_table, missing_as_null
from pastward.operators.ordering import keep_last
from pastward.operators.quality import align_missing, audit, missing_counts
from pastward.operators.scoring import (
    append_metrics,
    choose_final,
    final_table,
    fold_summary,
    leaderboard,
    long_predictions,
    persistence_names,
    score,
)
from pastward.operators.splits import chronological_split, development, split_summary
from pastward.operators.tuning import SearchSpace, best_trial, search, trial_sizes
from pastward.session import staged, staging
from pastward.sources.fingerprint import file_hashes, provenance, require_files
from pastward.sources.series import read_hourly_csv, tail_rows, with_timestamp
from pastward.sources.sinks import guard_results, read_csv, results_exist, write_csv, write_json, write_parquet
from pastward.spec import HOURLY, SeriesSpec

SMOKE_ROWS = 6000
METRICS_PATH = "locked_test/scores"
REQUIRED = ("baselines/scores", "ensembles/fold_summary", "search/trials", METRICS_PATH, "summary")


@dataclass(frozen=True)
class Plan:
    """How thorough a run is."""

    sizes: M.Sizes = M.FULL
    space: SearchSpace = SearchSpace()
    folds: int = 5
    trials: int = 8
    search_folds: int = 3
    cv_models: tuple[str, ...] = (M.BAGGING, M.HISTOGRAM, M.BOOSTING)
    tail: int | None = None


FULL_PLAN = Plan()
SMOKE_PLAN = Plan(
    sizes=M.SMOKE, folds=3, trials=2, search_folds=2, cv_models=(M.BAGGING, M.BOOSTING), tail=SMOKE_ROWS
)


def read_series(spark: SparkSession, path: str, tail: int | None = None, key: str = "all") -> DataFrame:
    """Lines of an hourly CSV with their time, all as one series."""
    lines = missing_as_null(read_hourly_csv(spark, path))
    chosen = tail_rows(lines, tail, "file_order") if tail else lines
    return with_timestamp(chosen).withColumn("series_id", F.lit(key))


def run_files(spark: SparkSession, folder: str, canonical: str, raw: str, out: str, smoke: bool = False, overwrite: bool = False) -> DataFrame:
    """A run on two named CSV files of a folder, with their provenance."""
    guard_results(spark, f"{out}/{METRICS_PATH}", overwrite, smoke)
    require_files(spark, folder, [canonical, raw])
    plan = SMOKE_PLAN if smoke else FULL_PLAN
    hashes = file_hashes(spark, [f"{folder}/{canonical}", f"{folder}/{raw}"])
    write_json(provenance(hashes, folder, False, {"canonical": canonical, "raw": raw}), f"{out}/provenance", overwrite)
    lines = read_series(spark, f"{folder}/{canonical}", plan.tail)
    series = keep_last(lines, HOURLY, "file_order").drop("file_order")
    return run(series, read_hourly_csv(spark, f"{folder}/{raw}").drop("file_order"), out, plan, HOURLY, overwrite)


def feature_manifest(features: DataFrame) -> DataFrame:
    """``feature, role, type, rows, missing, levels`` of the model inputs as a feature table has them.

    The role follows from the declared columns, the rest from the table: NaN counts as missing, and ``levels`` are the distinct values of
    inputs that are no continuous numbers. An input that the table lacks is an error.
    """
    roles = {
        "continuous": S.CONTINUOUS,
        "cyclical": S.CYCLICAL,
        "binary": S.BINARY,
        "nominal": S.NOMINAL,
        "ordinal": S.ORDINAL,
    }
    kinds = dict(features.dtypes)
    absent = [c for c in S.FEATURES if c not in kinds]
    if absent:
        raise ValueError(f"the feature table has no column {', '.join(absent)}")

    def facts(name: str, role: str) -> Column:
        value = F.col(name)
        missing = value.isNull() | F.isnan(value) if kinds[name] in ("double", "float") else value.isNull()
        levels = F.size(F.collect_set(value)).cast("long") if role in ("binary", "nominal", "ordinal") else F.lit(None).cast("long")
        parts = {"feature": F.lit(name), "role": F.lit(role), "type": F.lit(kinds[name]), "rows": F.count("*"), "missing": F.count_if(missing), "levels": levels}
        return F.struct(*(column.alias(field) for field, column in parts.items()))

    each = [facts(name, role) for role, names in roles.items() for name in names]
    return features.agg(F.array(*each).alias("inputs")).select(F.inline("inputs"))


def fit_times(spark: SparkSession, fitted: list[M.FittedModel]) -> DataFrame:
    return spark.createDataFrame([(m.name, m.fit_seconds) for m in fitted], "model string, fit_seconds double")


def run(
    series: DataFrame, raw: DataFrame, out: str, plan: Plan = FULL_PLAN, spec: SeriesSpec = HOURLY, overwrite: bool = False
) -> DataFrame:
    """:func:`run_staged` in a staging area of its own; returns the locked-test table as it was written."""
    with staging(series.sparkSession):
        schema = run_staged(series, raw, out, plan, spec, overwrite).schema
    return read_csv(series.sparkSession, f"{out}/{METRICS_PATH}", schema).orderBy("role", "mae", "model")


def run_staged(series: DataFrame, raw: DataFrame, out: str, plan: Plan, spec: SeriesSpec, overwrite: bool) -> DataFrame:
    """Run everything on a series table that is unique on key and time; returns the locked-test table.

    Each stage writes its tables below ``out``. Choices are made on validation rows only; the test rows are read once,
    after the choice.
    """
    spark = series.sparkSession
    started = time.monotonic()
    keys = [spec.key, spec.time]

    def save(df: DataFrame, path: str) -> None:
        write_csv(df, f"{out}/{path}", overwrite)

    # data
    series = staged(series)
    audited = staged(audit(raw, series, spec))
    write_json(audited, f"{out}/audit", overwrite)
    missing = align_missing(missing_counts(raw), missing_counts(series))
    save(missing, "missing_values")
    rows = staged(chronological_split(staged(feature_table(series, spec)), spec))
    splits = split_summary(rows, spec)
    write_json(splits, f"{out}/split", overwrite)
    manifest = staged(feature_manifest(rows))
    write_json(manifest, f"{out}/features", overwrite)
    train, validation = rows.where("split = 'train'"), rows.where("split = 'validation'")

    def evaluate(predicted: DataFrame, names: list[str], path: str) -> DataFrame:
        """Store predictions, score the stored rows, store the scores."""
        wide = predicted.select(*keys, F.col(S.TARGET).alias("actual"), *names)
        write_parquet(wide, f"{out}/{path}/predictions", overwrite)
        stored = spark.read.parquet(f"{out}/{path}/predictions")
        return score(long_predictions(stored, keys, names, actual="actual"))

    # baselines
    fitted = M.fit_many([M.model_spec(M.RIDGE, plan.sizes), M.model_spec(M.FOREST, plan.sizes)], train)
    names = [*persistence_names(), M.RIDGE, M.FOREST]
    predicted = M.predict_many(fitted, M.with_persistence(validation))
    baseline = staged(evaluate(predicted, names, "baselines"))
    save(leaderboard(baseline), "baselines/scores")

    # ensembles
    members = M.fit_many([M.model_spec(name, plan.sizes) for name, _ in M.VOTES], train)
    predicted = M.predict_many(members, validation).withColumn(M.VOTING, M.vote())
    ensemble = staged(evaluate(predicted, [*(name for name, _ in M.VOTES), M.VOTING], "ensembles"))
    timed = ensemble.join(F.broadcast(fit_times(spark, members)), "model", "left")  # one row per model
    save(leaderboard(timed), "ensembles/scores")
    dev = development(rows).drop("split")
    folds = staged(model_folds(dev, [M.model_spec(name, plan.sizes) for name in plan.cv_models], spec, plan.folds))
    save(folds.orderBy("model", "fold"), "ensembles/folds")
    cv_summary = staged(fold_summary(folds))
    save(cv_summary, "ensembles/fold_summary")

    # search; its folds cover the validation rows, so the tuned model's validation score has seen them
    trials = staged(search(dev, spec, plan.space, plan.trials, plan.search_folds))
    save(trials.orderBy("number"), "search/trials")
    tuned_sizes = trial_sizes(best_trial(trials), plan.sizes)
    tuned = M.fit_many([M.model_spec(M.TUNED, tuned_sizes)], train)
    predicted = M.predict_many(tuned, validation)
    tuned_score = staged(evaluate(predicted, [M.TUNED], "search").withColumn("saw_validation", F.lit(True)))
    write_json(tuned_score, f"{out}/search/tuned_scores", overwrite)

    # choice, then the one look at the test rows
    candidates = append_metrics(baseline, ensemble, tuned_score)
    save(leaderboard(candidates), "candidates")
    selection = staged(choose_final(candidates))
    write_json(selection, f"{out}/choice", overwrite)
    chosen = selection.first()["model"]
    final_models = M.fit_selected(chosen, dev, plan.sizes, tuned_sizes)
    predicted = M.predict_selected(chosen, final_models, rows.where("split = 'test'"))
    names = list(dict.fromkeys([*persistence_names(), chosen]))
    scores = require_finite(evaluate(predicted, names, "locked_test"))
    final = staged(final_table(scores, chosen))
    save(final, METRICS_PATH)

    summary = experiment_summary(
        {
            "audit": audited,
            "features": manifest,
            "split": split_totals(splits),
            "baselines": baseline,
            "ensembles": timed,
            "folds": cv_summary,
            "tuned": tuned_score,
            "choice": selection,
            "locked_test": final,
        }
    ).withColumn("elapsed_minutes", F.lit((time.monotonic() - started) / 60.0))
    write_json(summary, f"{out}/summary", overwrite)
    require_outputs(spark, out)
    return final


def split_totals(splits: DataFrame) -> DataFrame:
    """One row for all series of a split summary: how many there are, their rows, and the outermost times of the parts."""
    sizes = [name for name in splits.columns if name == "rows" or name.endswith("_rows")]
    edges = [name for name in splits.columns if name.endswith(("_start", "_end"))]
    outermost = [(F.min if name.endswith("_start") else F.max)(name).alias(name) for name in edges]
    return splits.agg(F.count("*").alias("series"), *(F.sum(name).alias(name) for name in sizes), *outermost)


def experiment_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One nested document of result tables whose size does not follow the data: one row, a list of records per table."""
    document = None
    for name, table in tables.items():
        part = table.agg(F.to_json(F.collect_list(F.struct("*"))).alias("records")).withColumn("name", F.lit(name))
        document = part if document is None else document.unionByName(part)
    return document.agg(
        *(F.max(F.when(F.col("name") == name, F.col("records"))).alias(name) for name in tables)
    )


def require_outputs(spark: SparkSession, out: str) -> None:
    """Stop when a required output is absent or empty."""
    absent = [path for path in REQUIRED if not results_exist(spark, f"{out}/{path}")]
    if absent:
        raise RuntimeError(f"missing outputs: {', '.join(absent)}")
