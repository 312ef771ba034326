"""Result tables as CSV, JSON or Parquet, never overwritten by accident."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


PACK_LINES = 256  # lines of a text file that are written as one row


def packed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``at, value`` in order to fewer rows whose values are lines with line ends between them, under the first line's place."""
    for rows in batches:
        at, lines = rows.column("at").to_pylist(), rows.column("value").to_pylist()
        starts = range(0, len(lines), PACK_LINES)
        values = ["\n".join(lines[k : k + PACK_LINES]) for k in starts]
        yield pa.RecordBatch.from_arrays([pa.array([at[k] for k in starts], pa.int64()), pa.array(values, pa.string())], ["at", "value"])


def results_exist(spark: SparkSession, path: str) -> bool:
    """Whether a path holds files."""
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def guard_results(spark: SparkSession, path: str, overwrite: bool, smoke: bool = False) -> None:
    """An error if the path holds files. ``overwrite`` lifts it for full runs; smoke runs keep off earlier results in any case."""
    if results_exist(spark, path) and (smoke or not overwrite):
        raise FileExistsError(f"there are files in {path} already; a full run may overwrite them if it is told to")


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode(_mode(overwrite)).csv(path, header=True)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode(_mode(overwrite)).option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode(_mode(overwrite)).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Columns are found by their names in the header, in any order; others are left out.

    An absent column, a value that is not of its type, or files with unequal headers are errors.
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    lines = spark.read.csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    absent = [f.name for f in wanted if f.name not in lines.columns]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    return lines.select(*(_typed(f).alias(f.name) for f in wanted))


def _typed(field: T.StructField) -> Column:
    text = F.col(f"`{field.name}`")
    value = text.try_cast(field.dataType)
    wrong = F.raise_error(F.concat(F.lit(f"{field.name} has a value that is no {field.dataType.simpleString()}: "), text))
    return F.when(text.isNotNull() & value.isNull(), wrong).otherwise(value)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")
