"""Linear models of many training sets from one scan (E1, B27, B32), on two lags, which SQL can solve."""

from __future__ import annotations

from pyspark.sql import functions as F

from pastward.catalog.base import feature_sql, fold_sql, hourly_by_type, query, r, rounded, table, with_series
from pastward.catalog.evaluation import persistence_table
from pastward.operators.gram import grams, lasso_path, nested_ridge, ridge_folds
from pastward.session import staged
from pastward.spec import HOURLY

LAGS = ("consumption_lag_1", "consumption_lag_24")
ALPHA = 2.0
ALPHAS = (1.0, 100.0, 10_000.0)
SHARES = (0.9, 0.5, 0.2, 0.05, 0.0)
# co-moments of a training set, and the ridge weights on standardised inputs from them
MOMENTS_SQL = """avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) AS n, count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb,
    count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS yb"""


def _weights_sql(alpha: str) -> str:
    p, q = f"(aa * (1 + {alpha} / n))", f"(bb * (1 + {alpha} / n))"
    return f"(ay * {q} - yb * ab) / ({p} * {q} - ab * ab) AS wa, (yb * {p} - ay * ab) / ({p} * {q} - ab * ab) AS wb"


ERROR_SQL = "y - my - wa * (a - ma) - wb * (b - mb)"
SCORES_SQL = f"sqrt(avg(pow({ERROR_SQL}, 2))) AS rmse, 1 - avg(pow({ERROR_SQL}, 2)) / nullif(var_pop(y), 0) AS r2"
SERIES_SQL = with_series("hourly_by_type", then=feature_sql("hourly_by_type")).rstrip()


@query(
    "e1_ridge_folds",
    SERIES_SQL
    + ","
    + fold_sql("feature_rows", 5)
    + f""", lags AS (SELECT fold, consumption_lag_1 AS a, consumption_lag_24 AS b, Consumption AS y FROM fold_rows),
        m AS (SELECT k, {MOMENTS_SQL} FROM lags JOIN range(1, 6) AS ks(k) ON fold < k GROUP BY k),
        w AS (SELECT *, {_weights_sql(str(ALPHA))} FROM m),
        s AS (SELECT k, any_value(n) AS train_rows, count(*) AS test_rows, {SCORES_SQL} FROM w JOIN lags ON fold = k GROUP BY k)
        SELECT k::INTEGER AS fold, train_rows, test_rows, {r('rmse')} AS rmse, {r('r2')} AS r2 FROM s""",
)
def e1_ridge(spark, folder):
    return rounded(ridge_folds(staged(persistence_table(hourly_by_type(spark, folder))), LAGS, ALPHA))


@query(
    "b27_nested_ridge",
    SERIES_SQL
    + f""", placed AS (SELECT consumption_lag_1 AS a, consumption_lag_24 AS b, Consumption AS y,
                              row_number() OVER (PARTITION BY series_id ORDER BY timestamp) - 1 AS position, count(*) OVER (PARTITION BY series_id) AS n FROM feature_rows),
        prefixes AS (SELECT a, b, y, position, i, j, n // 6 AS size, n - (6 - i) * (n // 6) AS prefix FROM placed, range(1, 6) AS o(i), range(1, 7) AS p(j)),
        bounds AS (SELECT *, CASE WHEN j < 6 THEN prefix - (6 - j) * (prefix // 6) ELSE prefix END AS low,
                          CASE WHEN j < 6 THEN prefix - (5 - j) * (prefix // 6) ELSE prefix + size END AS high FROM prefixes),
        m AS (SELECT i, j, {MOMENTS_SQL} FROM bounds WHERE position < low GROUP BY i, j),
        w AS (SELECT *, {_weights_sql('alpha')} FROM m, (VALUES {", ".join(f"({a}::DOUBLE)" for a in ALPHAS)}) AS v(alpha)),
        s AS (SELECT i, j, alpha, any_value(w.n) AS train_rows, {SCORES_SQL} FROM w JOIN bounds USING (i, j) WHERE position >= low AND position < high GROUP BY i, j, alpha),
        best AS (SELECT DISTINCT ON (i) i, alpha, error FROM (SELECT i, alpha, avg(rmse) AS error FROM s WHERE j < 6 GROUP BY i, alpha) ORDER BY i, error, alpha)
        SELECT i::INTEGER AS outer_fold, alpha, {r('error')} AS inner_rmse, train_rows, {r('rmse')} AS rmse, {r('r2')} AS r2
        FROM best JOIN s USING (i, alpha) WHERE j = 6""",
)
def b27_ridge(spark, folder):
    rows = staged(persistence_table(hourly_by_type(spark, folder)))
    return rounded(nested_ridge(rows, LAGS, ALPHAS, HOURLY, outer_folds=5, inner_folds=5))


# the lasso in two inputs: of the solutions for each choice of signs the best is the minimum
SIGNS_SQL = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)) AS signs(p, q)"


@query(
    "b32_lasso_path",
    SERIES_SQL
    + f""", m AS (SELECT avg(consumption_lag_1) AS ma, avg(consumption_lag_24) AS mb, avg(Consumption) AS my, stddev_pop(consumption_lag_1) AS sa,
                         stddev_pop(consumption_lag_24) AS sb, corr(consumption_lag_1, consumption_lag_24) AS k,
                         covar_pop(consumption_lag_1, Consumption) / sa AS ca, covar_pop(consumption_lag_24, Consumption) / sb AS cb FROM feature_rows),
        steps AS (SELECT *, greatest(abs(ca), abs(cb)) * share AS penalty FROM m, (VALUES {", ".join(f"({n}, {s}::DOUBLE)" for n, s in enumerate(SHARES))}) AS v(step, share)),
        ways AS (SELECT *, CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN ca - penalty * p ELSE (ca - penalty * p - k * (cb - penalty * q)) / (1 - k * k) END AS wa,
                        CASE WHEN q = 0 THEN 0 WHEN p = 0 THEN cb - penalty * q ELSE (cb - penalty * q - k * (ca - penalty * p)) / (1 - k * k) END AS wb
                 FROM steps, {SIGNS_SQL}),
        best AS (SELECT DISTINCT ON (step) *, wa / sa AS a, wb / sb AS b FROM ways
                 ORDER BY step, (wa * wa + wb * wb + 2 * k * wa * wb) / 2 - ca * wa - cb * wb + penalty * (abs(wa) + abs(wb)))
        SELECT step::INTEGER AS step, {r('penalty')} AS penalty, feature, {r("CASE feature WHEN 'consumption_lag_1' THEN a WHEN 'consumption_lag_24' THEN b ELSE my - a * ma - b * mb END", 6)} AS weight
        FROM best, (VALUES ('consumption_lag_1'), ('consumption_lag_24'), ('intercept')) AS v(feature)""",
)
def b32_lasso(spark, folder):
    path = lasso_path(staged(persistence_table(hourly_by_type(spark, folder))), LAGS, SHARES)
    return path.select("step", F.round("penalty", 7).alias("penalty"), "feature", F.round("weight", 6).alias("weight"))


LINE_INPUTS = ("l_quantity", "l_discount")


@query(
    "b32_line_moments",
    """SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT AS part, count(*)::DOUBLE AS n, round(avg(l_quantity)::DOUBLE, 6) AS mean_quantity,
              round(covar_pop(l_quantity::DOUBLE, l_extendedprice::DOUBLE), 2) AS with_price, round(var_pop(l_discount::DOUBLE), 8) AS discount_spread
       FROM lineitem GROUP BY 1""",
)
def b32_moments(spark, folder):
    """The scan itself, over a table whose rows grow."""
    part = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    found = grams(table(spark, folder, "lineitem"), part, LINE_INPUTS, "l_extendedprice")
    rows = [(k, g.n, float(g.mean[0]), float(g.moment[0, 2] / g.n), float(g.moment[1, 1] / g.n)) for k, g in found.items()]  # one row per part
    out = spark.createDataFrame(rows, "part long, n double, mean_quantity double, with_price double, discount_spread double")
    return out.select("part", "n", F.round("mean_quantity", 6).alias("mean_quantity"), F.round("with_price", 2).alias("with_price"), F.round("discount_spread", 8).alias("discount_spread"))
