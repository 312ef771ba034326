"""Fitted models, their cross-validation, search and importances.

Sizes are the full ones. SQL states whole fits where they are small: ridge on two columns by its normal equations, boosted trees and
random trees of one split (``*_stumps``) by trying every split. For full models it states which rows are predicted, the persistence errors
next to them, and that the model's error is below that of the persistence of 24 hours.
"""

from __future__ import annotations

from functools import partial

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pastward import schema as S
from pastward.catalog.base import (
    NAIVE,
    feature_sql,
    fold_sql,
    hourly_all,
    hourly_by_type,
    query,
    r,
    rounded,
    split_sql,
    table,
    with_series,
)
from pastward.catalog.evaluation import split_features
from pastward.operators import models as M
from pastward.operators.boosting import BoostedTrees
from pastward.operators.crossval import model_folds, nested_models, persistence_folds
from pastward.operators.features import feature_table
from pastward.operators.preprocess import FeaturePreprocessor
from pastward.operators.random_trees import COPIES, RandomTrees
from pastward.operators.scoring import (
    append_metrics,
    choose_final,
    final_table,
    fold_summary,
    leaderboard,
    long_predictions,
    persistence_names,
    score,
    with_persistence,
)
from pastward.operators.selection import importances, permutation_importance, select_top, stability_ranking
from pastward.operators.splits import chronological_split, development, expanding_folds
from pastward.operators.tuning import SearchSpace, halving_search, best_trial, search, trial_sizes
from pastward.plans.experiment import fit_times
from pastward.session import staged

KEYS = ["series_id", "timestamp"]
# queries of minutes: they come last, and the tests leave them to the checks
LONG = (
    "r3_random_forest",
    "r4_bagged_trees",
    "r5_histogram_boosting",
    "r6_gradient_boosting",
    "r7_voting_ensemble",
    "r8_tuned_boosting",
    "e1_cross_validated_models",
    "e2_random_search",
    "e2_halving_search",
    "b27_nested_models",
    "e4_locked_test_models",
    "b20_model_importance",
    "b21_permutation_importance",
    "b32_traditional_models",
)
SPLIT_SQL = with_series("hourly_all", then=feature_sql("hourly_all") + "," + split_sql("feature_rows"))
EVENTS_SQL = "(SELECT count(*) AS events FROM events)"


def split_rows(spark, folder, series=hourly_all):
    return staged(chronological_split(staged(feature_table(series(spark, folder)))))


def parts(rows):
    return rows.where("split = 'train'"), rows.where("split = 'validation'")


def _rows_sql(extra: str = "") -> str:
    """Keys and actual values of the validation rows, the persistence errors, and what must hold for every prediction."""
    return (
        SPLIT_SQL
        + f"""SELECT series_id, timestamp, round(Consumption, 6) AS actual, true AS predicted, true AS plausible,
                     {r('avg(abs(Consumption - consumption_lag_24)) OVER ()')} AS naive_mae, true AS beats_naive{extra}
              FROM split_rows WHERE split = 'validation'"""
    )


def _names_sql(names, rest: str) -> str:
    return f"SELECT model, {rest} FROM (VALUES {', '.join(f'({n!r})' for n in names)}) AS v(model), {EVENTS_SQL}"


def checked(name, train, predicted):
    """Whether each row has a finite prediction within the target's range on training rows, widened by that range, and whether the mean
    error of all is below that of the value 24 hours before."""
    low, high = train.agg(F.min(S.TARGET), F.max(S.TARGET)).first()
    value = F.col(name)
    held = staged(predicted)
    error = lambda column: F.avg(F.abs(F.col(S.TARGET) - F.col(column)))
    own, naive = held.agg(error(name), error("consumption_lag_24")).first()
    return held, [
        F.round(S.TARGET, 6).alias("actual"),
        (value.isNotNull() & ~F.isnan(value)).alias("predicted"),
        value.between(2 * low - high, 2 * high - low).alias("plausible"),
        F.round(F.lit(naive), 7).alias("naive_mae"),
        F.lit(own < naive).alias("beats_naive"),
    ]


def _predictions(spark, folder, model):
    train, validation = parts(split_rows(spark, folder))
    fitted = M.fit_many([M.model_spec(model)], train)
    held, columns = checked(model, train, M.predict_many(fitted, validation))
    return held.select(*KEYS, *columns)


for _id, _model in (
    ("r2_ridge", M.RIDGE),
    ("r3_random_forest", M.FOREST),
    ("r4_bagged_trees", M.BAGGING),
    ("r5_histogram_boosting", M.HISTOGRAM),
    ("r6_gradient_boosting", M.BOOSTING),
):
    query(_id, _rows_sql())(partial(_predictions, model=_model))


LAGS = ("consumption_lag_1", "consumption_lag_24")


@query(
    "r2_ridge_closed_form",
    SPLIT_SQL
    + """, m AS (
        SELECT avg(consumption_lag_1) AS ma, avg(consumption_lag_24) AS mb, avg(Consumption) AS my,
               count(*) * var_pop(consumption_lag_1) + 2 AS aa, count(*) * var_pop(consumption_lag_24) + 2 AS bb,
               count(*) * covar_pop(consumption_lag_1, consumption_lag_24) AS ab,
               count(*) * covar_pop(consumption_lag_1, Consumption) AS ay, count(*) * covar_pop(consumption_lag_24, Consumption) AS yb
        FROM split_rows WHERE split = 'train'),
      w AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
      SELECT series_id, timestamp, round(my + wa * (consumption_lag_1 - ma) + wb * (consumption_lag_24 - mb), 4) AS prediction
      FROM split_rows, w WHERE split = 'validation'""",
)
def r2_closed(spark, folder):
    rows = split_features(hourly_all(spark, folder))
    train, validation = parts(VectorAssembler(inputCols=list(LAGS), outputCol="features").transform(rows))
    model = M.ridge(train).fit(train)
    return model.transform(validation).select(*KEYS, F.round("prediction", 4).alias("prediction"))


@query(
    "r7_weighted_vote",
    with_series("hourly_by_type", then=feature_sql("hourly_by_type") + "," + split_sql("feature_rows"))
    + f"""SELECT series_id, timestamp, {r('(consumption_lag_1 + consumption_lag_24 + 2 * consumption_lag_168) / 4')} AS voting_regressor
          FROM split_rows WHERE split = 'validation'""",
)
def r7(spark, folder):
    rows = with_persistence(split_features(hourly_by_type(spark, folder)).where("split = 'validation'"))
    weights = tuple(zip(NAIVE, (1.0, 1.0, 2.0)))
    return rounded(rows.select(*KEYS, M.vote(weights).alias(M.VOTING)))


@query("r7_voting_ensemble", _rows_sql(", true AS vote_is_weighted_mean"))
def r7_models(spark, folder):
    train, validation = parts(split_rows(spark, folder))
    fitted = M.fit_many([M.model_spec(name) for name, _ in M.VOTES], train)
    predicted = M.predict_many(fitted, validation).withColumn(M.VOTING, M.vote())
    mean = (F.col(M.BAGGING) + F.col(M.HISTOGRAM) + 2 * F.col(M.BOOSTING)) / 4
    held, columns = checked(M.VOTING, train, predicted)
    return held.select(*KEYS, *columns, (F.abs(F.col(M.VOTING) - mean) < 1e-6).alias("vote_is_weighted_mean"))


FOLD_NAIVE_SQL = """(SELECT avg(mae) FROM (SELECT avg(abs(Consumption - consumption_lag_24)) AS mae FROM fold_rows WHERE fold > 0 GROUP BY fold))"""


def _folds_sql(folds: int) -> str:
    return SPLIT_SQL.rstrip() + f", dev AS (SELECT * FROM split_rows WHERE split <> 'test')," + fold_sql("dev", folds)


def _fold_naive(dev, folds):
    scores = persistence_folds(dev, folds=folds).where("model = 'naive_lag_24'")
    return scores.agg(F.avg("mae")).first()[0]


TRIALS = 8
SEARCH_FOLDS = 3


@query(
    "e2_random_search",
    _folds_sql(SEARCH_FOLDS)
    + f"""SELECT unnest(range({TRIALS}))::INTEGER AS number, 'COMPLETE' AS state, true AS inside_space, {r(FOLD_NAIVE_SQL)} AS naive_mae, true AS beats_naive""",
)
def e2(spark, folder):
    dev, space = development(split_rows(spark, folder)).drop("split"), SearchSpace()
    naive = _fold_naive(dev, SEARCH_FOLDS)
    inside = F.col("rounds").between(*space.rounds[:2])
    for name in ("depth", "rate", "child", "rows", "columns", "l1", "l2"):
        inside &= F.col(name).between(*getattr(space, name))
    found = search(dev, trials=TRIALS, folds=SEARCH_FOLDS)
    return found.select("number", "state", inside.alias("inside_space"), F.round(F.lit(naive), 7).alias("naive_mae"), (F.col("value") < naive).alias("beats_naive"))


GRID = [{"rounds": n, "depth": d, "rate": rate} for d in (3, 6) for rate in (0.03, 0.1) for n in (30, 90, 180)]


@query(
    "e2_halving_search",
    _folds_sql(SEARCH_FOLDS)
    + f"""SELECT state, folds, trials, {r(FOLD_NAIVE_SQL)} AS naive_mae, CASE state WHEN 'COMPLETE' THEN true END AS best_beats_naive
          FROM (VALUES ('PRUNED', 1, 6), ('PRUNED', 2, 3), ('COMPLETE', 3, 3)) AS v(state, folds, trials)""",
)
def e2_halving(spark, folder):
    """Of 12 trials half go on after the first fold and half of these after the second; four fits a fold serve all of them."""
    dev = development(split_rows(spark, folder)).drop("split")
    naive = _fold_naive(dev, SEARCH_FOLDS)
    found = halving_search(dev, GRID, folds=SEARCH_FOLDS)
    counted = found.groupBy("state", "folds").agg(F.count("*").cast("int").alias("trials"), F.min("value").alias("least"))
    beats = F.when(F.col("state") == "COMPLETE", F.col("least") < naive)
    return counted.select("state", "folds", "trials", F.round(F.lit(naive), 7).alias("naive_mae"), beats.alias("best_beats_naive"))


@query("r8_tuned_boosting", _rows_sql())
def r8(spark, folder):
    rows = split_rows(spark, folder)
    train, validation = parts(rows)
    trials = search(development(rows).drop("split"), trials=TRIALS, folds=SEARCH_FOLDS)
    fitted = M.fit_many([M.model_spec(M.TUNED, trial_sizes(best_trial(trials)))], train)
    held, columns = checked(M.TUNED, train, M.predict_many(fitted, validation))
    return held.select(*KEYS, *columns)


def _finite(*names):
    ok = F.lit(True)
    for name in names:
        ok &= F.col(name).isNotNull() & (F.abs(name) < float("inf"))
    return ok


CV_MODELS = (M.BAGGING, M.HISTOGRAM, M.BOOSTING)


@query(
    "e1_cross_validated_models",
    _folds_sql(5)
    + f"""SELECT model, 5::BIGINT AS folds, true AS finite, {r(FOLD_NAIVE_SQL)} AS naive_mae, true AS beats_naive
          FROM (VALUES {', '.join(f'({n!r})' for n in CV_MODELS)}) AS v(model)""",
)
def e1_models(spark, folder):
    dev = development(split_rows(spark, folder)).drop("split")
    folds = staged(model_folds(dev, [M.model_spec(name) for name in CV_MODELS], folds=5))
    counts = folds.groupBy("model").agg(F.count_distinct("fold").alias("folds"))
    finite = _finite("mae_mean", "mae_std", "rmse_mean", "rmse_std", "r2_mean", "smape_mean")
    naive = _fold_naive(dev, 5)
    return (
        fold_summary(folds)
        .join(counts, "model")
        .select("model", "folds", finite.alias("finite"), F.round(F.lit(naive), 7).alias("naive_mae"), (F.col("mae_mean") < naive).alias("beats_naive"))
    )


@query(
    "e4_locked_test_models",
    f"""SELECT 'baseline' AS role, 3::BIGINT AS rows, true AS finite FROM {EVENTS_SQL}
        UNION ALL SELECT 'selected_final_model', 1, true""",
)
def e4_models(spark, folder):
    rows = split_rows(spark, folder)
    train, validation = parts(rows)
    names = [M.RIDGE, M.FOREST, *(name for name, _ in M.VOTES)]
    fitted = M.fit_many([M.model_spec(name) for name in names], train)
    wide = M.predict_many(fitted, with_persistence(validation)).withColumn(M.VOTING, M.vote())
    candidates = [*persistence_names(), *names, M.VOTING]
    scored = staged(wide.select(*KEYS, S.TARGET, *candidates))
    chosen = choose_final(append_metrics(score(long_predictions(scored, KEYS, candidates)))).first()["model"]
    final_models = M.fit_selected(chosen, development(rows))
    predicted = M.predict_selected(chosen, final_models, rows.where("split = 'test'"))
    scores = score(long_predictions(predicted, KEYS, list(dict.fromkeys([*persistence_names(), chosen]))))
    return final_table(scores, chosen).groupBy("role").agg(F.count("*").alias("rows"), F.bool_and(_finite(*S.METRICS)).alias("finite"))


TRADITIONAL = ("linear_regression", "lasso", "decision_tree", "gradient_boosting")


@query("b32_traditional_models", _names_sql(TRADITIONAL, "true AS finite"))
def b32(spark, folder):
    train, validation = parts(split_rows(spark, folder))
    preprocessing = FeaturePreprocessor(scale=False).fit(train)
    prepared = M.packed(preprocessing.transform(train).select(S.TARGET, "features"))
    estimators = (M.linear(), M.linear(elasticNetParam=1.0, regParam=0.1), M.decision_tree(), M.boosting())
    fitted = [
        M.fit_prepared(M.ModelSpec(name, False, lambda _, e=estimator: e), preprocessing, prepared)
        for name, estimator in zip(TRADITIONAL, estimators)
    ]
    predicted = M.predict_many(fitted, validation)
    return leaderboard(score(long_predictions(predicted, KEYS, TRADITIONAL))).select("model", _finite(*S.METRICS).alias("finite"))


@query(
    "e5_fit_seconds",
    SPLIT_SQL
    + f"""SELECT model, count(*) AS train_rows, true AS timed FROM split_rows, (VALUES ('{M.RIDGE}'), ('decision_tree')) AS v(model)
          WHERE split = 'train' GROUP BY model""",
)
def e5(spark, folder):
    train, _ = parts(split_rows(spark, folder))
    specs = [M.model_spec(M.RIDGE), M.ModelSpec("decision_tree", False, lambda _: M.decision_tree())]
    times = fit_times(spark, M.fit_many(specs, train))
    return times.select("model", F.lit(train.count()).alias("train_rows"), (F.col("fit_seconds") > 0).alias("timed"))


def _fold_importances(spark, folder, with_permutation):
    """Importances of a forest of 200 trees fitted on the rows before each fold of the training part; permuted on that fold."""
    train, _ = parts(split_rows(spark, folder))
    folded = staged(expanding_folds(train.drop("split"), folds=3))
    tables = None
    for fold in (1, 2, 3):
        before = folded.where(F.col("fold") < fold)
        preprocessing = FeaturePreprocessor(scale=False).fit(before)
        names = list(preprocessing.encoded())
        prepared = M.packed(preprocessing.transform(before).select(S.TARGET, "features"))
        model = M.forest(numTrees=200).fit(prepared)
        if with_permutation:
            later = preprocessing.transform(folded.where(F.col("fold") == fold))
            found = permutation_importance(model, later, names).withColumnRenamed("importance", "score")
        else:
            found = spark.createDataFrame(importances(model, names), "feature string, score double")
        found = found.withColumn("fold", F.lit(fold))
        tables = found if tables is None else tables.unionByName(found)
    return tables


@query(
    "b20_model_importance",
    f"SELECT unnest(range(1, 4))::INTEGER AS fold, true AS from_0_up, 1.0::DOUBLE AS total FROM {EVENTS_SQL}",
)
def b20(spark, folder):
    found = _fold_importances(spark, folder, with_permutation=False)
    return found.groupBy("fold").agg(F.bool_and(F.col("score") >= 0).alias("from_0_up"), F.round(F.sum("score"), 6).alias("total"))


@query("b21_permutation_importance", f"SELECT 20::BIGINT AS kept, true AS shares_of_folds FROM {EVENTS_SQL}")
def b21(spark, folder):
    top = select_top(stability_ranking(staged(_fold_importances(spark, folder, with_permutation=True))))
    thirds = F.abs(F.col("stability") * 3 - F.round(F.col("stability") * 3)) < 1e-9
    return top.agg(F.count_distinct("feature").alias("kept"), F.bool_and(thirds).alias("shares_of_folds"))


NESTED_MODELS = (M.HISTOGRAM, M.BAGGING)


@query(
    "b27_nested_models",
    SPLIT_SQL.rstrip()
    + ", dev AS (SELECT * EXCLUDE (split) FROM split_rows WHERE split <> 'test'),"
    + fold_sql("dev", 5)
    + f""" SELECT o.fold AS outer_fold, (SELECT count(*) FROM fold_rows b WHERE b.fold < o.fold) AS train_rows, count(*) AS test_rows,
                  {r("avg(abs(Consumption - consumption_lag_24))")} AS naive_mae, true AS beats_naive, true AS plausible_inner
           FROM fold_rows o WHERE o.fold > 0 GROUP BY o.fold""",
)
def b27_models(spark, folder):
    dev = staged(development(split_rows(spark, folder)).drop("split"))
    found = staged(nested_models(dev, [M.model_spec(name, M.SMOKE) for name in NESTED_MODELS], outer_folds=5, inner_folds=3))
    naive = persistence_folds(dev, folds=5).where("model = 'naive_lag_24'").select(F.col("fold").alias("outer_fold"), F.col("mae").alias("naive"))
    both = found.join(naive, "outer_fold")
    inner = F.col("inner_mae").between(F.col("mae") / 3, F.col("mae") * 3)
    return both.select("outer_fold", "train_rows", "test_rows", F.round("naive", 7).alias("naive_mae"), (F.col("mae") < F.col("naive")).alias("beats_naive"), inner.alias("plausible_inner"))


# trees of one split, stated in SQL by trying every split

STUMP_LAGS = ("consumption_lag_1", "consumption_lag_24", "consumption_lag_168")
HOURS_SQL = "(epoch(timestamp)::BIGINT // 3600)"


def _long_sql(rows: str, columns: int, keep: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT {k} AS f, f{k} AS v, {keep} FROM {rows}" for k in range(columns))


def _chosen_sql(columns: int) -> str:
    return "CASE f " + " ".join(f"WHEN {k} THEN f{k}" for k in range(columns)) + " END"


def boosted_stumps_sql(p: BoostedTrees, columns: int) -> str:
    """Rounds of one split over ``r0`` (key columns, y, f0, f1, …, trained, margin); the margin after them is in ``r<rounds>``."""
    bent = (lambda g: f"sign({g}) * greatest(abs({g}) - {p.l1}, 0)") if p.l1 else (lambda g: g)
    part = lambda g, h: f"pow({bent(g)}, 2) / ({h} + {p.l2})"
    leaf = lambda g, h: f"-{p.rate} * {bent(g)} / ({h} + {p.l2})"
    out = []
    for k in range(p.rounds):
        out.append(
            f"""s{k} AS (SELECT f, v, sum(g) AS g, count(*) AS h FROM ({_long_sql(f"r{k}", columns, "margin - y AS g, trained")}) WHERE trained GROUP BY f, v),
            c{k} AS (SELECT f, v, sum(g) OVER w AS g, sum(h) OVER w AS h, sum(g) OVER (PARTITION BY f) AS all_g, sum(h) OVER (PARTITION BY f) AS all_h
                     FROM s{k} WINDOW w AS (PARTITION BY f ORDER BY v)),
            b{k} AS (SELECT * FROM c{k} WHERE h >= {p.child} AND all_h - h >= {p.child}
                     ORDER BY round({part("g", "h")} + {part("(all_g - g)", "(all_h - h)")} - {part("all_g", "all_h")}, 6) DESC, f, v LIMIT 1),
            r{k + 1} AS (SELECT a.* REPLACE (margin + CASE WHEN {_chosen_sql(columns)} <= v THEN {leaf("g", "h")} ELSE {leaf("(all_g - g)", "(all_h - h)")} END AS margin)
                         FROM r{k} a, b{k})"""
        )
    return ",\n".join(out)


STUMPS = BoostedTrees(rounds=4, rate=0.3, leaves=2, l2=0.5, child=20, bins=1 << 20)
PENALISED = BoostedTrees(rounds=4, rate=0.2, depth=1, l1=400.0, l2=3.0, child=3, bins=1 << 20)
LINES = BoostedTrees(rounds=3, rate=0.5, leaves=2, l1=10.0, l2=2.0, child=50)
SERIES_ROWS_SQL = (
    SPLIT_SQL.rstrip()
    + f""", plain AS (SELECT series_id, timestamp, Consumption AS y, {", ".join(f"{c} AS f{k}" for k, c in enumerate(STUMP_LAGS))}, split = 'train' AS trained
            FROM split_rows WHERE split IN ('train', 'validation')),
    r0 AS (SELECT *, (SELECT avg(y) FROM plain WHERE trained) AS margin FROM plain),
"""
)


def _series_rows(spark, folder):
    rows = split_features(hourly_all(spark, folder)).where("split <> 'test'")
    return parts(staged(VectorAssembler(inputCols=list(STUMP_LAGS), outputCol="features").transform(rows)))


for _id, _stumps in (("r5_boosted_stumps", STUMPS), ("r6_penalised_stumps", PENALISED)):

    @query(_id, SERIES_ROWS_SQL + boosted_stumps_sql(_stumps, 3) + f" SELECT series_id, timestamp, round(margin, 4) AS prediction FROM r{_stumps.rounds} WHERE NOT trained")
    def _stump_predictions(spark, folder, model=_stumps):
        train, validation = _series_rows(spark, folder)
        return model.fit(train).transform(validation).select(*KEYS, F.round("prediction", 4).alias("prediction"))


LINE_INPUTS = ("l_quantity", "l_discount", "l_tax")


@query(
    "r5_boosted_stumps_by_line",
    f"""WITH plain AS (SELECT {", ".join(f"{c}::DOUBLE AS f{k}" for k, c in enumerate(LINE_INPUTS))}, round(l_extendedprice::DOUBLE / 100) AS y, true AS trained FROM lineitem),
        r0 AS (SELECT *, (SELECT avg(y) FROM plain) AS margin FROM plain),
        {boosted_stumps_sql(LINES, 3)}
        SELECT round(margin, 3) AS prediction, count(*) AS rows FROM r{LINES.rounds} GROUP BY 1""",
)
def r5_lines(spark, folder):
    """Rows grow with the table; beyond a block the histograms come from many tasks."""
    lines = table(spark, folder, "lineitem").select(F.round(F.col("l_extendedprice").cast("double") / 100).alias(S.TARGET), *(F.col(c).cast("double").alias(c) for c in LINE_INPUTS))
    rows = staged(VectorAssembler(inputCols=list(LINE_INPUTS), outputCol="features").transform(lines))
    return LINES.fit(rows).transform(rows).groupBy(F.round("prediction", 3).alias("prediction")).agg(F.count("*").alias("rows"))


def draw_sql(*parts: str) -> str:
    """``tree_model.draw`` of whole numbers from 0 to below 2**32."""
    steps = ("xor(x, x >> 16)", "(x * 2246822507) & 4294967295", "xor(x, x >> 13)", "(x * 3266489909) & 4294967295", "xor(x, x >> 16)")
    mixed = "[(xor(h, p) + 2654435769) & 4294967295]"
    for step in steps:
        mixed = f"list_transform({mixed}, lambda x: {step})"
    return f"(list_reduce([0::UBIGINT, {', '.join(f'({p})::UBIGINT' for p in parts)}], lambda h, p: {mixed}[1]) / 4294967296.0::DOUBLE)"


RANDOM = RandomTrees(trees=7, depth=1, leaf=2, rows=0.85, columns=1.0, seed=11)


def _counts_sql(p: RandomTrees) -> str:
    term = upto = math.exp(-p.rows)
    steps = []
    for k in range(1, COPIES):
        steps.append(f"(u >= {upto!r}::DOUBLE)::INTEGER")
        term *= p.rows / k
        upto += term
    return " + ".join(steps)


@query(
    "r4_random_stumps",
    SERIES_ROWS_SQL
    + f"""drawn AS (SELECT *, {_counts_sql(RANDOM)} AS n FROM (SELECT *, {draw_sql(HOURS_SQL, "t", str(RANDOM.seed))} AS u FROM r0, range({RANDOM.trees}) AS trees(t) WHERE trained)),
          long AS (SELECT * FROM ({_long_sql("drawn", 3, "t, y, n")}) WHERE n > 0),
          extent AS (SELECT t, f, min(v) AS low, max(v) AS high FROM long GROUP BY t, f),
          cuts AS (SELECT t, f, CASE WHEN cut < high THEN cut ELSE low END AS cut
                   FROM (SELECT *, low + {draw_sql("1", "f", "t", str(RANDOM.seed + 2))} * (high - low) AS cut FROM extent WHERE low < high)),
          sums AS (SELECT t, f, any_value(cut) AS cut, count(*) FILTER (v <= cut) AS rows_left, count(*) FILTER (v > cut) AS rows_right,
                          sum(n) FILTER (v <= cut) AS w, sum(n * y) FILTER (v <= cut) AS s, sum(n) AS all_w, sum(n * y) AS all_s
                   FROM long JOIN cuts USING (t, f) GROUP BY t, f),
          best AS (SELECT DISTINCT ON (t) * FROM sums WHERE rows_left >= {RANDOM.leaf} AND rows_right >= {RANDOM.leaf}
                   ORDER BY t, round(s * s / w + pow(all_s - s, 2) / (all_w - w) - all_s * all_s / all_w, 4) DESC, f)
          SELECT series_id, timestamp, round(avg(CASE WHEN {_chosen_sql(3)} <= cut THEN s / w ELSE (all_s - s) / (all_w - w) END), 4) AS prediction
          FROM r0, best WHERE NOT trained GROUP BY series_id, timestamp""",
)
def r4_stumps(spark, folder):
    train, validation = _series_rows(spark, folder)
    hours = F.expr("unix_seconds(cast(timestamp as timestamp)) div 3600")
    return RANDOM.fit(train, mark=hours).transform(validation).select(*KEYS, F.round("prediction", 4).alias("prediction"))
