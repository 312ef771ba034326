"""Tables shared by the operators: reading inputs, written intermediate tables, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.session import work_folder

WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until none of them meets a column of ``taken`` (case is ignored)."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name = "_" + name
        out.append(name)
        lower.add(name.lower())
    return out


def text_mark(text: Column) -> Column:
    """32 bits of the text. They tell rows apart that share a ``doc_id``; rows alike in both get the same result anyway."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


class Work:
    """Written tables of one operator call, below the shared folder named in ``spark.checkpoint.dir``.

    A written table cuts the lineage and outlives lost executors, so the shuffle files that made it go as soon as it is there.
    ``drop`` deletes a table that nothing reads any more; what the returned result still reads stays until ``close``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = work_folder(spark)
        self.made = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/t{self.made}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._written_at = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for frame in frames:
            if frame is not None and hasattr(frame, "_written_at"):
                self._delete(frame._written_at)

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
