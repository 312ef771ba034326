"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_inside: list[list[str]] = []  # the folders made inside each open staging()


def local_session(cores: int | str = "*", name: str = "pastward") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """A fresh path below the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster that would be one machine's disk.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pastward-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set(CHECKPOINT_DIR, base)
    path = f"{base.rstrip('/')}/pastward-{uuid.uuid4().hex}"
    for made in _inside:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end. A result that is still to be read has to be written elsewhere by then."""
    made: list[str] = []
    _inside.append(made)
    try:
        yield
    finally:
        _inside[:] = [other for other in _inside if other is not made]
        for path in made:
            delete(spark, path)


def staged(df: DataFrame) -> DataFrame:
    """Write a result that several later jobs read to the shared folder, and read it back.

    This cuts the lineage in a way that outlives lost executors. The folder stays until the :func:`staging` around it ends.
    """
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
