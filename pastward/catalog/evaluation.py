"""Persistence models, metrics, leaderboards, selection and prediction checks (R1, A5-A9, O, U, E, B17, B23-B30, B33)."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pastward import schema as S
from pastward.catalog.base import (
    METRICS_SQL,
    NAIVE,
    W_SQL,
    daily_orders_by_priority,
    feature_sql,
    fold_sql,
    full_window_sql,
    hourly_all,
    hourly_by_type,
    long_sql,
    query,
    r,
    rounded,
    rs,
    split_sql,
    table,
    with_series,
)
from pastward.functions.errors import adjusted_r2
from pastward.operators.audits import (
    causality_by_row,
    causality_violations,
    fold_defects,
    non_finite_metrics,
    prediction_defects,
    replay_metrics,
    require_finite,
)
from pastward.operators.crossval import nested_persistence, persistence_folds
from pastward.catalog.features import all_features_sql
from pastward.operators.features import feature_table, lag_columns, persistence_table, rolling_columns
from pastward.operators.forecast import fixed_origin_forecast
from pastward.operators.ordering import over_history
from pastward.operators.scoring import (
    append_metrics,
    best_per_group,
    best_row,
    choose_final,
    final_table,
    fold_summary,
    leaderboard,
    long_predictions,
    persistence_names,
    score,
    score_extended,
    with_persistence,
    worst_rows,
)
from pastward.operators.quality import audit
from pastward.operators.splits import chronological_split, development, expanding_folds, fold_bounds, holdout, split_summary
from pastward.plans.experiment import REQUIRED, experiment_summary, feature_manifest, require_outputs, split_totals
from pastward.session import staged, work_folder
from pastward.sources.sinks import read_json, write_csv, write_json
from pastward.spec import DAILY, HOURLY

KEYS = ["series_id", "timestamp"]


def split_features(series):
    """The target and its persistence lags with their split. The lags are staged: finding the cut-offs reads them too."""
    return chronological_split(staged(persistence_table(series)))


def persistence_predictions(rows, *keys):
    return long_predictions(with_persistence(rows), [*keys, *KEYS], persistence_names())


def validation_rows(series):
    return split_features(series).where("split = 'validation'")


def validation_scores(spark, folder):
    return score(persistence_predictions(validation_rows(hourly_all(spark, folder))))


def _scored_sql(source: str = "hourly_all", where: str = "split = 'validation'", keys: str = "series_id, timestamp") -> str:
    return with_series(
        source, then=feature_sql(source) + "," + split_sql("feature_rows") + "," + long_sql("split_rows", keys, NAIVE, where)
    )


METRIC_LIST = rs("mae", "rmse", "r2", "smape_pct")


@query("r1_persistence_forecasts", _scored_sql("hourly_by_type") + "SELECT * FROM predictions")
def r1(spark, folder):
    rows = validation_rows(hourly_by_type(spark, folder))
    return persistence_predictions(rows)


@query(
    "j2_aligned_predictions",
    _scored_sql("hourly_by_type")
    + """SELECT series_id, timestamp, Consumption AS actual, consumption_lag_1 AS naive_lag_1, consumption_lag_24 AS naive_lag_24,
                consumption_lag_168 AS naive_lag_168 FROM split_rows WHERE split = 'validation'""",
)
def j2(spark, folder):
    rows = with_persistence(validation_rows(hourly_by_type(spark, folder)))
    return rows.select(*KEYS, F.col(S.TARGET).alias("actual"), *persistence_names())


@query("a5_regression_metrics", _scored_sql() + f"SELECT model, {METRIC_LIST} FROM (SELECT model, {METRICS_SQL} FROM predictions GROUP BY 1)")
def a5(spark, folder):
    return rounded(validation_scores(spark, folder))


@query(
    "a5_metrics_by_series",
    _scored_sql("hourly_by_type")
    + f"SELECT series_id, model, {METRIC_LIST} FROM (SELECT series_id, model, {METRICS_SQL} FROM predictions GROUP BY 1, 2)",
)
def a5_series(spark, folder):
    rows = validation_rows(hourly_by_type(spark, folder))
    return rounded(score(persistence_predictions(rows), "series_id"))


@query(
    "o2_leaderboard",
    _scored_sql() + f"SELECT model, {METRIC_LIST} FROM (SELECT model, {METRICS_SQL} FROM predictions GROUP BY 1) ORDER BY mae, model",
)
def o2(spark, folder):
    return rounded(leaderboard(validation_scores(spark, folder)))


FOLDED = with_series(
    "hourly_all",
    then=feature_sql("hourly_all")
    + ","
    + split_sql("feature_rows")
    + ", dev AS (SELECT * EXCLUDE (position, n) FROM split_rows WHERE split <> 'test'),"
    + fold_sql("dev", 5)
    + ","
    + long_sql("fold_rows", "series_id, timestamp, fold", NAIVE, "fold > 0"),
)
FOLD_METRICS = f"(SELECT model, fold, {METRICS_SQL} FROM predictions GROUP BY 1, 2)"


def development_rows(spark, folder):
    return staged(development(split_features(hourly_all(spark, folder))).drop("split"))


def fold_scores(spark, folder, folds=5):
    return persistence_folds(development_rows(spark, folder), HOURLY, folds)


@query("e1_cross_validation", FOLDED + f"SELECT model, fold, {METRIC_LIST} FROM {FOLD_METRICS}")
def e1(spark, folder):
    return rounded(fold_scores(spark, folder))


@query(
    "a6_fold_summary",
    FOLDED
    + f"""SELECT model, {r('avg(mae)')} AS mae_mean, {r('stddev_samp(mae)')} AS mae_std, {r('avg(rmse)')} AS rmse_mean,
                 {r('stddev_samp(rmse)')} AS rmse_std, {r('avg(r2)')} AS r2_mean, {r('avg(smape_pct)')} AS smape_mean
          FROM {FOLD_METRICS} GROUP BY 1""",
)
def a6(spark, folder):
    return rounded(fold_summary(fold_scores(spark, folder)))


@query(
    "a7_target_statistics",
    _scored_sql("hourly_by_type")
    + f"""SELECT series_id, {r('avg(Consumption)')} AS mean, {r('stddev_pop(Consumption)')} AS std
          FROM split_rows WHERE split = 'train' GROUP BY 1""",
)
def a7(spark, folder):
    train = split_features(hourly_by_type(spark, folder)).where("split = 'train'")
    return rounded(
        train.groupBy("series_id").agg(F.avg(S.TARGET).alias("mean"), F.stddev_pop(S.TARGET).alias("std"))
    )


@query("a8_best_model_per_fold", FOLDED + f"SELECT DISTINCT ON (fold) model, fold, {METRIC_LIST} FROM {FOLD_METRICS} ORDER BY fold, mae, model")
def a8(spark, folder):
    return rounded(best_per_group(fold_scores(spark, folder), "fold"))


@query("a9_mean_objective", FOLDED + f"SELECT model, {r('avg(mae)')} AS objective FROM {FOLD_METRICS} GROUP BY 1")
def a9(spark, folder):
    return rounded(fold_scores(spark, folder).groupBy("model").agg(F.avg("mae").alias("objective")))


@query(
    "o4_best_model",
    _scored_sql() + f"SELECT model, {METRIC_LIST} FROM (SELECT model, {METRICS_SQL} FROM predictions GROUP BY 1) ORDER BY mae, model LIMIT 1",
)
def o4(spark, folder):
    return rounded(best_row(validation_scores(spark, folder)))


@query(
    "u1_development_rows",
    _scored_sql("hourly_by_type") + "SELECT series_id, timestamp, Consumption, split FROM split_rows WHERE split <> 'test'",
)
def u1(spark, folder):
    return development(split_features(hourly_by_type(spark, folder))).select(*KEYS, S.TARGET, "split")


@query(
    "u2_append_metrics",
    _scored_sql()
    + f""", scores AS (SELECT model, {METRICS_SQL} FROM predictions GROUP BY 1)
        SELECT model, {METRIC_LIST}, NULL::BOOLEAN AS saw_validation FROM scores
        UNION ALL SELECT model || '_again', {METRIC_LIST}, true FROM scores""",
)
def u2(spark, folder):
    scores = validation_scores(spark, folder).withColumn("fit_seconds", F.lit(1.0))
    again = scores.withColumn("model", F.concat("model", F.lit("_again"))).withColumn("saw_validation", F.lit(True))
    return rounded(append_metrics(scores, again))


@query(
    "u3_set_difference",
    "SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT l_suppkey FROM lineitem",
)
def u3(spark, folder):
    customers = table(spark, folder, "orders").select("o_custkey").distinct()
    suppliers = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("o_custkey"))
    return customers.join(suppliers, "o_custkey", "left_anti")


@query(
    "e3_choose_final",
    _scored_sql() + f"SELECT model, {METRIC_LIST} FROM (SELECT model, {METRICS_SQL} FROM predictions GROUP BY 1) ORDER BY mae, model LIMIT 1",
)
def e3(spark, folder):
    scores = staged(validation_scores(spark, folder))
    first = scores.where("model <> 'naive_lag_24'").withColumn("fit_seconds", F.lit(0.5))
    return rounded(choose_final(first, scores.where("model = 'naive_lag_24'")))


def _locked(spark, folder):
    split = staged(split_features(hourly_all(spark, folder)))
    chosen = choose_final(score(persistence_predictions(split.where("split = 'validation'")))).first()["model"]
    scores = score(persistence_predictions(split.where("split = 'test'")))
    return final_table(scores, chosen)


LOCKED = (
    with_series(
        "hourly_all",
        then=feature_sql("hourly_all")
        + ","
        + split_sql("feature_rows")
        + ","
        + long_sql("split_rows", "series_id, timestamp, split", NAIVE),
    )
    + f""", scores AS (SELECT split, model, {METRICS_SQL} FROM predictions GROUP BY 1, 2),
         chosen AS (SELECT model FROM scores WHERE split = 'validation' ORDER BY mae, model LIMIT 1),
         final AS (SELECT model, 'baseline' AS role, {METRIC_LIST} FROM scores WHERE split = 'test'
                   UNION ALL SELECT model, 'selected_final_model', {METRIC_LIST} FROM scores JOIN chosen USING (model)
                   WHERE split = 'test')
    """
)


@query("e4_locked_test", LOCKED + "SELECT * FROM final")
def e4(spark, folder):
    return rounded(_locked(spark, folder))


@query("o3_role_and_error_order", LOCKED + "SELECT * FROM final ORDER BY role, mae, model")
def o3(spark, folder):
    return rounded(_locked(spark, folder))


@query("f3_selected_row", LOCKED + "SELECT * FROM final WHERE role = 'selected_final_model'")
def f3(spark, folder):
    return rounded(_locked(spark, folder).where("role = 'selected_final_model'"))


@query(
    "f4_non_finite_metrics",
    _scored_sql("hourly_by_type")
    + f"""SELECT series_id, model, {METRIC_LIST} FROM (SELECT series_id, model, {METRICS_SQL} FROM
              (SELECT series_id, model, CASE WHEN series_id = 'click' THEN 1 ELSE actual END AS actual, prediction FROM predictions)
              GROUP BY 1, 2) WHERE r2 IS NULL""",
)
def f4(spark, folder):
    rows = validation_rows(hourly_by_type(spark, folder))
    flat = persistence_predictions(rows).withColumn(
        "actual", F.when(F.col("series_id") == "click", 1.0).otherwise(F.col("actual"))
    )
    return rounded(non_finite_metrics(score(flat, "series_id")))


# --- checks and tables of the daily versions -------------------------------------------------------------------


def _audited(w):
    return {
        **lag_columns(S.TARGET, (1, 24), w, "consumption"),
        **rolling_columns(S.TARGET, (24,), w, "consumption", ("mean", "max")),
        "leaking_mean": F.avg(S.TARGET).over(w.rowsBetween(-2, 0)),
    }


AUDITED = {
    "consumption_lag_1": f"lag(y) OVER {W_SQL}",
    "consumption_lag_24": f"lag(y, 24) OVER {W_SQL}",
    "consumption_roll_mean_24": full_window_sql("avg(y)", "y", 24),
    "consumption_roll_max_24": full_window_sql("max(y)", "y", 24),
    "leaking_mean": "avg(y) OVER (PARTITION BY series_id ORDER BY timestamp ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
}
_AUDIT_COLUMNS = ", ".join(f"{text} AS {name}" for name, text in AUDITED.items())


@query(
    "b17_causality_audit",
    with_series(
        "hourly_by_type",
        then=f"""placed AS (SELECT series_id, timestamp, Consumption, row_number() OVER {W_SQL} - 1 AS position,
                            floor(count(*) OVER (PARTITION BY series_id) * 0.5::DOUBLE) AS turn FROM hourly_by_type),
                 before AS (SELECT *, {_AUDIT_COLUMNS} FROM (SELECT *, Consumption AS y FROM placed)),
                 after AS (SELECT *, {_AUDIT_COLUMNS}
                           FROM (SELECT *, CASE WHEN position >= turn THEN Consumption * 3 + 1000 ELSE Consumption END AS y FROM placed))""",
    )
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, count(*) AS rows, count(*) FILTER (a.{name} IS DISTINCT FROM b.{name}) AS mismatches
            FROM before a JOIN after b USING (series_id, timestamp) WHERE a.position <= a.turn"""
        for name in AUDITED
    ),
)
def b17(spark, folder):
    series = hourly_by_type(spark, folder).select(*KEYS, S.TARGET)
    return causality_violations(series, lambda frame: over_history(frame, HOURLY, 24, _audited), list(AUDITED))


# a feature that looks one row ahead in one hour of each series, and one that holds the row's own value in another
PEEK = "timestamp = TIMESTAMP_NTZ '2024-01-05 07:00:00'"
SELF = "timestamp = TIMESTAMP_NTZ '2024-01-09 11:00:00'"


@query(
    "b17_every_position",
    with_series("hourly_by_type")
    + """, near AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY series_id) AS n FROM hourly_by_type WINDOW w AS (PARTITION BY series_id ORDER BY timestamp))
        SELECT 'peeking' AS feature, series_id, timestamp, 2::BIGINT AS turns FROM near WHERE timestamp = TIMESTAMP '2024-01-05 07:00:00' AND place < n
        UNION ALL SELECT 'itself', series_id, timestamp, 1 FROM near WHERE timestamp = TIMESTAMP '2024-01-09 11:00:00'
        UNION ALL SELECT 'leaking_mean', series_id, timestamp, 1 FROM near""",
)
def b17_rows(spark, folder):
    """Two features that are past-only but for one row each, and one that leaks in all, among others that are past-only."""
    series = hourly_by_type(spark, folder).select(*KEYS, S.TARGET)

    def columns(w):
        before = F.lag(S.TARGET, 1).over(w)
        return {
            **_audited(w),
            "peeking": F.when(F.expr(PEEK), F.lead(S.TARGET, 1).over(w)).otherwise(before),
            "itself": F.when(F.expr(SELF), F.col(S.TARGET)).otherwise(before),
        }

    return causality_by_row(series, lambda frame: over_history(frame, HOURLY, 24, columns), [*AUDITED, "peeking", "itself"], 24)


def _holdout(name: str, share: float):
    @query(
        name,
        with_series("daily_orders_by_priority")
        + f"""SELECT series_id, Date, CASE WHEN row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY series_id) * {share}::DOUBLE)
                                           THEN 'train' ELSE 'test' END AS split
              FROM daily_orders_by_priority WINDOW w AS (PARTITION BY series_id ORDER BY Date)""",
    )
    def run(spark, folder):
        return holdout(daily_orders_by_priority(spark, folder).select("series_id", "Date"), DAILY, share)


_holdout("b23_holdout_80_20", 0.8)
_holdout("b23_holdout_90_10", 0.9)


@query(
    "b24_extended_metrics",
    _scored_sql()
    + f"""SELECT model, count(*) AS rows, {r('avg((actual - prediction) * (actual - prediction))', 5)} AS mse,
                 {r('avg(abs(actual - prediction) / abs(actual))')} AS mape,
                 {", ".join(r(f"any_value({m})") + f" AS {m}" for m in ("mae", "rmse", "r2", "smape_pct"))}
          FROM predictions JOIN (SELECT model, {METRICS_SQL} FROM predictions GROUP BY 1) USING (model) GROUP BY 1""",
)
def b24(spark, folder):
    rows = validation_rows(hourly_all(spark, folder))
    scores = score_extended(persistence_predictions(rows))
    return rounded(scores.withColumn("mse", F.round("mse", 5)))


@query(
    "b25_worst_rows",
    _scored_sql("hourly_by_type")
    + f"""SELECT series_id, timestamp, model, actual, prediction, {r('actual - prediction')} AS residual,
                 {r('abs(actual - prediction)')} AS absolute_error
          FROM predictions ORDER BY abs(actual - prediction) DESC, timestamp, series_id, model LIMIT 20""",
)
def b25(spark, folder):
    rows = validation_rows(hourly_by_type(spark, folder))
    return rounded(worst_rows(persistence_predictions(rows), "timestamp"))


@query(
    "b26_out_of_fold_predictions",
    FOLDED + "SELECT series_id, timestamp, fold, model, actual, prediction FROM predictions",
)
def b26(spark, folder):
    return persistence_predictions(expanding_folds(development_rows(spark, folder)).where("fold > 0"), "fold")


NESTED = with_series(
    "hourly_by_type",
    then=feature_sql("hourly_by_type")
    + """, placed AS (SELECT series_id, timestamp, Consumption, consumption_lag_1, consumption_lag_24, consumption_lag_168,
                             row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS position,
                             count(*) OVER (PARTITION BY series_id) AS n FROM feature_rows),
         outer_rows AS (SELECT p.*, o.fold AS outer_fold, n - (6 - o.fold) * (n // 6) AS prefix, n // 6 AS size
                        FROM placed p, (SELECT unnest(generate_series(1, 5)) AS fold) o),
         inner_rows AS (SELECT *, 1 + (position - (prefix - 3 * (prefix // 4))) // (prefix // 4) AS inner_fold
                        FROM outer_rows WHERE position < prefix AND position >= prefix - 3 * (prefix // 4)),"""
    + long_sql("inner_rows", "outer_fold, inner_fold", NAIVE)
    + f""", inner_scores AS (SELECT outer_fold, model, avg(mae) AS inner_mae FROM
               (SELECT outer_fold, inner_fold, model, {METRICS_SQL} FROM predictions GROUP BY 1, 2, 3) GROUP BY 1, 2),
         winners AS (SELECT outer_fold, arg_min(model, inner_mae) AS model, min(inner_mae) AS inner_mae FROM inner_scores GROUP BY 1),"""
    + long_sql("outer_rows", "outer_fold", NAIVE, "position >= prefix AND position < prefix + size").replace(
        "predictions AS", "outer_predictions AS"
    ),
)


@query(
    "b27_nested_cross_validation",
    NESTED
    + f"""SELECT outer_fold, model, {r('inner_mae')} AS inner_mae, {METRIC_LIST}
          FROM winners JOIN (SELECT outer_fold, model, {METRICS_SQL} FROM outer_predictions GROUP BY 1, 2) USING (outer_fold, model)""",
)
def b27(spark, folder):
    rows = staged(persistence_table(hourly_by_type(spark, folder)))
    return rounded(nested_persistence(rows, HOURLY, outer_folds=5, inner_folds=3))


HORIZON = 60


@query(
    "b28_fixed_origin_forecast",
    with_series(
        "daily_orders_by_priority",
        then="""origins AS (SELECT series_id, max(Date) - 90 AS origin FROM daily_orders_by_priority GROUP BY 1),
                steps AS (SELECT series_id, origin, unnest(generate_series(1, 60)) AS step FROM origins),
                known AS (SELECT d.* FROM daily_orders_by_priority d JOIN origins o USING (series_id) WHERE d.Date <= o.origin)""",
    )
    + """SELECT s.series_id, (s.origin + s.step::INTEGER)::DATE AS Date, 'last_value' AS method, l.last AS forecast
         FROM steps s JOIN (SELECT series_id, max_by(Consumption, Date) AS last FROM known GROUP BY 1) l USING (series_id)
         UNION ALL
         SELECT s.series_id, (s.origin + s.step::INTEGER)::DATE, 'seasonal_7', k.Consumption
         FROM steps s LEFT JOIN known k ON k.series_id = s.series_id
              AND k.Date = s.origin - 6 + ((s.step - 1) % 7)::INTEGER""",
)
def b28(spark, folder):
    daily = daily_orders_by_priority(spark, folder)
    origin = daily.groupBy("series_id").agg(F.date_sub(F.max("Date"), 90).alias("origin"))
    return fixed_origin_forecast(daily, origin, HORIZON)


@query(
    "b29_metric_replay",
    _scored_sql()
    + """SELECT model, model <> 'naive_lag_24' AS agrees FROM (SELECT DISTINCT model FROM predictions)""",
)
def b29(spark, folder):
    rows = validation_rows(hourly_all(spark, folder))
    predictions = staged(persistence_predictions(rows))
    # one stored value is tampered with and must be found
    tampered = F.when(F.col("model") == "naive_lag_24", F.col("mae") + 0.001).otherwise(F.col("mae"))
    stored = staged(score(predictions).withColumn("mae", tampered))
    return replay_metrics(predictions, stored, 1e-9).select("model", "agrees")


@query(
    "b30_prediction_audit",
    _scored_sql("hourly_by_type")
    + """, stored AS (SELECT * FROM (SELECT series_id, timestamp, model, CASE WHEN hour(timestamp) = 3 THEN actual + 1 ELSE actual END AS actual
                                 FROM predictions WHERE hour(timestamp) <> 5 AND NOT (hour(timestamp) = 7 AND model = 'naive_lag_24'))
                      UNION ALL SELECT series_id, timestamp, model, actual FROM predictions WHERE hour(timestamp) = 4
                      UNION ALL SELECT series_id, timestamp + INTERVAL 1 YEAR, model, actual FROM predictions WHERE hour(timestamp) = 6),
         keyed AS (SELECT series_id, timestamp, model, count(*) AS copies, min(actual) AS least, max(actual) AS most FROM stored GROUP BY 1, 2, 3),
         facts AS (SELECT k.copies, k.least, k.most, s.Consumption, k.series_id IS NOT NULL AS scored, s.series_id IS NOT NULL AS known
                   FROM keyed k FULL JOIN (SELECT s.*, v.model FROM split_rows s, (VALUES ('naive_lag_1'), ('naive_lag_24'), ('naive_lag_168')) AS v(model)
                                           WHERE split = 'validation') s
                        ON k.series_id = s.series_id AND k.timestamp = s.timestamp AND k.model = s.model)
         SELECT 'scored_more_than_once' AS defect, count(*) FILTER (copies > 1) AS rows FROM facts
         UNION ALL SELECT 'not_in_source', count(*) FILTER (NOT known) FROM facts
         UNION ALL SELECT 'not_scored', count(*) FILTER (NOT scored) FROM facts
         UNION ALL SELECT 'actual_differs', count(*) FILTER (scored AND known AND (least <> Consumption OR most <> Consumption)) FROM facts""",
)
def b30(spark, folder):
    rows = staged(validation_rows(hourly_by_type(spark, folder)))
    good = persistence_predictions(rows)
    hour = F.hour("timestamp")
    lacking = (hour == 7) & (F.col("model") == "naive_lag_24")
    changed = good.where((hour != 5) & ~lacking).withColumn("actual", F.when(hour == 3, F.col("actual") + 1).otherwise(F.col("actual")))
    twice = good.where(hour == 4)
    foreign = good.where(hour == 6).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 YEAR"))
    return prediction_defects(changed.unionByName(twice).unionByName(foreign), rows)


@query(
    "b30_fold_audit",
    with_series("hourly_by_type")
    + """SELECT series_id, fold, fold <> 5 AS chronological, fold NOT IN (2, 3) AS expanding, fold <> 4 AS adjacent
         FROM (SELECT DISTINCT series_id FROM hourly_by_type), (SELECT unnest(generate_series(1, 5))::INTEGER AS fold)""",
)
def b30_folds(spark, folder):
    bounds = fold_bounds(expanding_folds(hourly_by_type(spark, folder).select(*KEYS)))
    # fold 3 counts a row too many, fold 4 ends early, and fold 5 is trained on what it scores
    fold = F.col("fold")
    broken = bounds.withColumn("train_rows", F.when(fold == 3, F.col("train_rows") + 1).otherwise(F.col("train_rows")))
    broken = broken.withColumn("test_end", F.when(fold == 4, F.col("test_start")).otherwise(F.col("test_end")))
    return fold_defects(broken.withColumn("train_end", F.when(fold == 5, F.col("test_end")).otherwise(F.col("train_end"))))


@query(
    "b33_adjusted_r2",
    _scored_sql()
    + f"""SELECT model, {r('1 - (1 - r2) * (rows - 1) / (rows - 1 - 1)')} AS adjusted_r2
          FROM (SELECT model, count(*) AS rows, {METRICS_SQL} FROM predictions GROUP BY 1)""",
)
def b33(spark, folder):
    rows = validation_rows(hourly_all(spark, folder))
    scores = score_extended(persistence_predictions(rows))
    return rounded(scores.select("model", adjusted_r2(F.col("r2"), F.col("rows"), F.lit(1)).alias("adjusted_r2")))


MANIFEST = {"continuous": S.CONTINUOUS, "cyclical": S.CYCLICAL, "binary": S.BINARY, "nominal": S.NOMINAL, "ordinal": S.ORDINAL}


def _manifest_sql() -> str:
    kinds = {"continuous": "double", "cyclical": "double", "binary": "int", "nominal": "string", "ordinal": "string"}
    return "SELECT * FROM (WITH f AS (" + all_features_sql() + ") " + " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, '{role}' AS role, '{kinds[role]}' AS type, count(*) AS rows, count(*) FILTER ({name} IS NULL) AS missing,
            {f"count(DISTINCT {name})" if role in ("binary", "nominal", "ordinal") else "NULL::BIGINT"} AS levels FROM f"""
        for role, names in MANIFEST.items()
        for name in names
    ) + ")"


@query("e7_feature_manifest", _manifest_sql())
def e7(spark, folder):
    path = work_folder(spark)
    write_json(feature_manifest(feature_table(hourly_by_type(spark, folder))), path)
    return read_json(spark, path, "feature string, role string, type string, rows long, missing long, levels long")


@query(
    "e6_experiment_summary",
    _scored_sql("hourly_by_type")
    + f""", scored AS (SELECT model, {METRICS_SQL} FROM predictions GROUP BY 1),
         sizes AS (SELECT count(DISTINCT series_id) AS series, count(*) AS n FROM split_rows)
         SELECT series, n AS rows, (SELECT count(*) FROM hourly_by_type) AS canonical_rows,
                (SELECT arg_min(model, mae) FROM scored) AS best, (SELECT round(min(mae), 6) FROM scored) AS mae FROM sizes""",
)
def e6(spark, folder):
    series = hourly_by_type(spark, folder)
    rows = staged(split_features(series))
    scores = leaderboard(score(persistence_predictions(rows.where("split = 'validation'"))))
    tables = {"audit": audit(series, series), "split": split_totals(split_summary(rows)), "scores": scores}
    document = experiment_summary(tables)
    found = document.select(
        F.from_json("split", "array<struct<series: long, rows: long>>")[0].alias("s"),
        F.from_json("audit", "array<struct<canonical_rows: long>>")[0].alias("a"),
        F.array_min(F.transform(F.from_json("scores", "array<struct<model: string, mae: double>>"), lambda x: F.struct(x["mae"].alias("mae"), x["model"].alias("model")))).alias("b"),
    )
    return found.select("s.series", "s.rows", "a.canonical_rows", F.col("b.model").alias("best"), F.round("b.mae", 6).alias("mae"))


@query(
    "e8_final_gate",
    _scored_sql()
    + f""", scored AS (SELECT model, {METRICS_SQL} FROM predictions GROUP BY 1)
         SELECT attempt, passed, models FROM (SELECT count(*) AS models FROM scored),
                (VALUES ('whole', true), ('an output is missing', false), ('a metric is not finite', false)) AS v(attempt, passed)""",
)
def e8(spark, folder):
    scores = staged(validation_scores(spark, folder))
    whole, partial = work_folder(spark), work_folder(spark)
    for out, paths in ((whole, REQUIRED), (partial, REQUIRED[1:])):
        for path in paths:
            write_csv(scores, f"{out}/{path}")

    def passes(check):
        try:
            check()
            return True
        except (RuntimeError, PySparkException):
            return False

    infinite = scores.withColumn("mae", F.lit(float("inf")))
    tried = {
        "whole": passes(lambda: (require_outputs(spark, whole), require_finite(scores).collect())),  # one row per model
        "an output is missing": passes(lambda: require_outputs(spark, partial)),
        "a metric is not finite": passes(lambda: require_finite(infinite).collect()),
    }
    models = scores.count()
    return spark.createDataFrame([(a, ok, models) for a, ok in tried.items()], "attempt string, passed boolean, models long")
