"""Train-only fitting: statistics come from training rows alone and equal their textbook values."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pastward import schema as S
from pastward.functions.yeo_johnson import centred_yeo_johnson, yeo_johnson
from pastward.operators import models as M
from pastward.operators import preprocess as P
from pastward.operators.features import feature_table
from pastward.operators.splits import chronological_split
from pastward.session import staged
from pastward.spec import HOURLY


@pytest.fixture(scope="module")
def split(spark):
    """A seasonal series of 1400 hours with weather, as a split feature table."""
    rng = np.random.default_rng(42)
    n = 1400
    hours = np.arange(n)
    y = 500 + 200 * np.sin(2 * np.pi * hours / 168) + 80 * np.sin(2 * np.pi * hours / 24) + rng.normal(0, 15, n)
    rain = np.where(rng.random(n) < 0.03, np.nan, np.maximum(rng.normal(0, 1.5, n), 0).round(2))
    start = np.datetime64("2020-01-01T00", "h")
    rows = [
        ("a", (start + int(h)).astype("datetime64[us]").item(), float(v), float(10 + 5 * np.sin(h / 50)), None if np.isnan(x) else float(x), float(h % 24 > 8))
        for h, v, x in zip(hours, y, rain)
    ]
    series = spark.createDataFrame(
        rows, "series_id string, timestamp timestamp_ntz, Consumption double, Temperature double, Rain double, Sun double"
    )
    return staged(chronological_split(staged(feature_table(series))))


def parts(split):
    return tuple(split.where(F.col("split") == name) for name in ("train", "validation", "test"))


def reference_yj(x, power):
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if power == 0 else ((x[pos] + 1) ** power - 1) / power
    out[~pos] = -np.log1p(-x[~pos]) if power == 2 else -((1 - x[~pos]) ** (2 - power) - 1) / (2 - power)
    return out


@pytest.mark.parametrize("power", [-1.0, 0.0, 0.4, 1.0, 2.0, 3.5])
def test_yeo_johnson(spark, power):
    x = np.array([-5.0, -1.0, -0.2, 0.0, 0.3, 1.0, 9.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1)
    got = [row[0] for row in df.select(yeo_johnson(F.col("x"), power)).collect()]
    np.testing.assert_allclose(got, reference_yj(x, power), rtol=1e-12)


def test_powers_maximise_the_likelihood(spark):
    rng = np.random.default_rng(1)
    data = {
        "skewed": np.exp(rng.normal(0, 0.6, 800)),
        "signed": rng.normal(0.5, 2, 800) ** 3,
        "far": rng.normal(1000, 3, 800),
        "constant": np.full(800, 4.0),
    }
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*data.values())], ", ".join(f"{c} double" for c in data))
    powers = P.fit_powers(df, list(data))
    assert powers["constant"] == 1.0

    def likelihood(x, power):
        spread = ((x + 1) ** power / power).var() if (x >= 0).all() and power != 0 else reference_yj(x, power).var()
        return -len(x) / 2 * np.log(spread) + (power - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    for name in ("skewed", "signed"):
        grid = np.linspace(powers[name] - 0.02, powers[name] + 0.02, 4001)
        best = grid[np.argmax([likelihood(data[name], p) for p in grid])]
        assert powers[name] == pytest.approx(best, abs=2e-5)
    # the same answer for any partitioning
    for parts_ in (1, 7):
        again = P.fit_powers(df.repartition(parts_), list(data))
        assert all(again[name] == pytest.approx(powers[name], rel=1e-8) for name in data)
    # a power far from the start
    for step in (-0.5, 0.5):
        assert likelihood(data["far"], powers["far"]) >= likelihood(data["far"], powers["far"] + step)


@pytest.mark.parametrize("sign", [1, -1])
def test_powers_of_nearly_constant_and_one_sided_columns(spark, sign):
    rng = np.random.default_rng(2)
    x = sign * (900 + np.where(rng.random(500) < 0.97, rng.normal(0, 0.01, 500), rng.normal(-30, 5, 500)))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    power = P.fit_powers(df, ["x"])["x"]
    assert P.fit_powers(df.repartition(5), ["x"])["x"] == pytest.approx(power, rel=1e-8)
    u = np.log1p(np.abs(x)).astype(np.longdouble)
    u -= u.mean()

    def likelihood(p):
        k = p if sign > 0 else 2 - p
        return -np.log((np.expm1(k * u) / k).var()) / 2

    assert all(likelihood(power) >= likelihood(power + step) for step in (-1e-3, 1e-3, -1.0, 1.0))


@pytest.mark.parametrize("power", [-3.0, -0.5, 1.5, 3.0, 4.5])
@pytest.mark.parametrize("centre", [0.7, -0.7])
def test_centred_transform_is_a_line_of_the_plain_one(spark, power, centre):
    x = np.array([-5.0, -1.0, -0.2, 0.0, 0.3, 1.0, 9.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1)
    got = np.array([row[0] for row in df.select(centred_yeo_johnson(F.col("x"), power, centre)).collect()])
    k = power if centre > 0 else 2 - power
    scale, shift = np.exp(k * 0.7), np.sign(centre) * np.expm1(k * 0.7) / k
    np.testing.assert_allclose(got, (reference_yj(x, power) - shift) / scale, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("sign", [1, -1])
@pytest.mark.parametrize("tail", [1, -1])
def test_large_powers_keep_inputs_finite_and_apart(split, sign, tail):
    """Values that vary by a thousandth have powers of hundreds; their plain transforms overflow or are all alike."""
    train, validation, _ = parts(split)
    change = lambda df: df.withColumn("consumption_lag_1", sign * (F.lit(1e6) + tail * 30 * F.log1p(F.abs("consumption_lag_1") % 97)))
    model = P.FeaturePreprocessor(scale=True).fit(change(train))
    power = model.learned()["powers"]["consumption_lag_1"]
    assert abs(power) > 100
    place = list(model.encoded()).index("consumption_lag_1")
    rows = [(r[0], r[1][place]) for r in model.transform(change(train).unionByName(change(validation))).select("consumption_lag_1", "features").collect()]
    x, got = np.array(sorted(rows)).T
    assert np.isfinite(got).all()
    k = power if sign > 0 else 2 - power
    fitted = np.array([r[0] for r in change(train).select("consumption_lag_1").collect()])
    centre = np.log1p(abs(fitted)).mean()
    line = lambda v: sign * np.expm1(k * (np.log1p(abs(v)) - centre)) / k
    low, middle, high = np.quantile(line(fitted), [0.25, 0.5, 0.75])
    np.testing.assert_allclose(got, (line(x) - middle) / (high - low), rtol=1e-6, atol=1e-6)


def test_fitted_values_ignore_later_rows(split):
    train, *_ = parts(split)
    later = F.col("split") != "train"
    mutated = split.withColumns(
        {c: F.when(later, F.col(c) * 100 + 7).otherwise(F.col(c)) for c in S.CONTINUOUS}
    ).withColumn("season", F.when(later, "monsoon").otherwise(F.col("season")))
    frozen = json.dumps(dict.fromkeys(S.CONTINUOUS, 0.5))
    one = P.FeaturePreprocessor(scale=True, powers=frozen).fit(train).learned()
    two = P.FeaturePreprocessor(scale=True, powers=frozen).fit(mutated.where("split = 'train'")).learned()
    assert one == two and "monsoon" not in one["levels"]["season"]


def test_branches_and_their_statistics(split, tmp_path):
    train, validation, _ = parts(split)
    pdf = train.toPandas()
    tree = P.FeaturePreprocessor(scale=False).fit(train)
    state = tree.learned()
    for name in S.CONTINUOUS:
        assert state["medians"][name] == pytest.approx(pdf[name].median(), rel=1e-12)
    assert state["modes"]["rain_intensity"] == pdf["rain_intensity"].mode().min()
    assert state["levels"]["hour_period"] == sorted(pdf["hour_period"].unique())
    scaled = P.FeaturePreprocessor(scale=True).fit(train)
    learned = scaled.learned()
    name = "rain_lag_1"
    x = pdf[name].astype(float).fillna(pdf[name].median()).to_numpy()
    bent = reference_yj(x, learned["powers"][name])
    center, width = learned["robust"][name]
    assert center == pytest.approx(np.median(bent), rel=1e-9)
    spread = np.quantile(bent, 0.75) - np.quantile(bent, 0.25)
    assert width == pytest.approx(spread if spread else 1.0, rel=1e-9)
    vectors = [row[0].toArray() for row in scaled.transform(validation).select("features").collect()]
    assert np.isfinite(vectors).all() and len(vectors[0]) == len(scaled.encoded())
    assert set(tree.transform(validation).columns) == {*validation.columns, "features"}
    path = str(tmp_path / "model")
    tree.write().save(path)
    assert P.FeaturePreprocessorModel.load(path).learned() == state


def test_unseen_and_missing_categories(split):
    train, validation, _ = parts(split)
    model = P.FeaturePreprocessor(scale=False).fit(train)
    odd = validation.limit(1).withColumns({"season": F.lit("monsoon"), "rain_intensity": F.lit("drizzle"), "rain_lag_1": F.lit(None).cast("double")})
    columns = model.encoded()
    row = odd.select(*(c.alias(n) for n, c in columns.items())).first().asDict()
    assert all(row[n] == 0.0 for n in columns if n.startswith("season_"))
    assert row["rain_intensity"] == -1.0 and row["rain_lag_1"] == model.learned()["medians"]["rain_lag_1"]


def test_ridge_equals_its_closed_form(split):
    train, *_ = parts(split)
    preprocessing = P.FeaturePreprocessor(scale=True).fit(train)
    prepared = preprocessing.transform(train).persist()
    fitted = M.fit_prepared(M.model_spec(M.RIDGE), preprocessing, prepared)
    rows = prepared.select("features", S.TARGET).collect()
    x = np.array([row[0].toArray() for row in rows])
    y = np.array([row[1] for row in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    weights = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(x.shape[1]), xc.T @ yc)
    expected = xc @ weights + y.mean()
    got = [row[0] for row in fitted.add_prediction(prepared).select(M.RIDGE).collect()]
    np.testing.assert_allclose(got, expected, rtol=1e-7)
    prepared.unpersist()


def test_models_beat_persistence_and_repeat(split):
    from pastward.operators.scoring import long_predictions, persistence_names, score, with_persistence

    train, validation, _ = parts(split)
    specs = [M.model_spec(name, M.SMOKE) for name in (M.RIDGE, M.FOREST)]
    keys = [HOURLY.key, HOURLY.time]

    def errors():
        predicted = M.predict_many(M.fit_many(specs, train), with_persistence(validation))
        names = [*persistence_names(), M.RIDGE, M.FOREST]
        return {row["model"]: row["mae"] for row in score(long_predictions(predicted, keys, names)).collect()}

    one, two = errors(), errors()
    assert one[M.RIDGE] < min(one[name] for name in persistence_names())
    assert one[M.FOREST] < one["naive_lag_24"]
    assert one == pytest.approx(two)


def test_vote_is_a_weighted_mean(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0)], f"{M.BAGGING} double, {M.HISTOGRAM} double, {M.BOOSTING} double")
    assert df.select(M.vote()).first()[0] == pytest.approx((1 + 2 + 8) / 4)
