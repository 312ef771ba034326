"""Inputs by name, fingerprints that tell rows apart, and cuts between rows of one time."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pastward.catalog import QUERIES
from pastward.operators.ordering import first_rows, keep_last, last_rows
from pastward.operators.scoring import worst_rows
from pastward.operators.splits import chronological_split, expanding_folds
from pastward.sources.fingerprint import row_hash, table_fingerprint
from pastward.sources.series import read_hourly_csv
from pastward.sources.sinks import read_csv
from pastward.spec import HOURLY


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,Time,Temperature,Consumption,Note,Rain,Sun\n2020-01-01,0:00,7.5,500,n,,3\n")
    row = read_hourly_csv(spark, str(tmp_path / "x.csv")).first()
    assert (row.Consumption, row.Temperature, row.Rain, row.Sun) == (500.0, 7.5, None, 3.0)


def test_absent_columns_and_wrong_values_are_errors(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n")
    with pytest.raises(ValueError, match="no column c"):
        read_csv(spark, str(tmp_path / "x.csv"), "a int, c int")
    with pytest.raises(Exception, match="b has a value that is no int"):
        read_csv(spark, str(tmp_path / "x.csv"), "b int").collect()


def test_row_hashes_keep_columns_and_nulls_apart(spark):
    rows = [("a\x1f=b", "c"), ("a", "b\x1f=c"), ("ab", "c"), ("a", "bc"), (None, "1"), ("1", None), ("", None), (None, ""), ("-", None), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(row_hash(F.col("x"), F.col("y")).alias("h")).distinct().count() == len(rows)


def test_table_fingerprint_sees_nulls_and_does_not_overflow(spark):
    left, right = (spark.createDataFrame([r], "x int, y int") for r in ((None, 1), (1, None)))
    assert table_fingerprint(left).first() != table_fingerprint(right).first()
    assert table_fingerprint(left.limit(0)).first()[:] == (0, 0, 0)
    many = spark.range(1000).select(F.lit(1).alias("x"))
    assert table_fingerprint(many).first().low == 1000 * table_fingerprint(many.limit(1)).first().low


def test_a_cut_between_rows_of_one_time_is_an_error(hourly):
    df = hourly({"a": ([i // 4 for i in range(100)], list(range(100)))})
    for cut in (lambda: chronological_split(df), lambda: first_rows(df, HOURLY, 70), lambda: last_rows(df, HOURLY, 30)):
        with pytest.raises(Exception, match="rows of equal timestamp"):
            cut().collect()
    even = hourly({"a": ([i // 2 for i in range(120)], list(range(120)))})
    sizes = dict(chronological_split(even).groupBy("split").count().collect())
    assert sizes == {"train": 84, "validation": 18, "test": 18}
    assert expanding_folds(even, folds=5).where("fold = 5").count() == 20
    assert first_rows(even, HOURLY, 70).count() == 70 and last_rows(even, HOURLY, 30).count() == 30


def test_ties_are_decided(spark):
    df = spark.createDataFrame([("s", 1, 5, 0.5), ("s", 1, 5, 0.7), ("s", 1, 4, 0.9)], "series_id string, timestamp int, o int, v double")
    assert [r.v for r in keep_last(df, HOURLY, "o").collect()] == [0.7]
    rows = spark.createDataFrame([(k, 1, "m", 1.0, 2.0) for k in "cab"], "series_id string, t int, model string, actual double, prediction double")
    assert [r.series_id for r in worst_rows(rows, "t", 2).collect()] == ["a", "b"]


def test_orders_of_any_priority_make_an_input_present(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "5-LOW"), (2, "1-URGENT"), (9, "1-URGENT"), (None, "5-LOW")], "o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r["name"] for r in QUERIES["s3_required_inputs"](spark, str(tmp_path)).collect()] == [3]
