"""Written intermediate tables."""

from __future__ import annotations

import time

from pastward.llm.work import CLEANUP, Work


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toString()
    return {name for name in files.replace(")", ",").split(",") if "/shuffle_" in name}


def test_shuffle_files_go_when_a_table_is_written(spark):
    work, setting, old = Work(spark), spark.conf.get(CLEANUP), shuffle_files(spark)
    counted = spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count()
    out = work.put(counted)
    assert spark.conf.get(CLEANUP) == setting
    for _ in range(50):
        left = shuffle_files(spark) - old
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert sorted(r["count"] for r in out.collect()) == [100] * 100 and counted.count() == 100
    work.close()
