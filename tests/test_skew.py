from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pastward.operators.skew import joined_to_groups


@pytest.mark.parametrize("share", [5, 1000])
def test_groups_of_any_size_are_joined(spark, share):
    rnd = random.Random(3)
    keys = [("hot", 1)] * 500 + [(f"k{rnd.randrange(300)}", rnd.choice([1, 2])) for _ in range(500)] + [(None, 1), ("hot", None)] * 30
    rows = spark.createDataFrame([(k, j, i) for i, (k, j) in enumerate(keys)], "k string, j int, _heavy int")
    groups = rows.where("k IS NOT NULL").groupBy("k", "j").agg(F.count("*").alias("n"), F.max("_heavy").alias("top"))
    got = sorted(map(tuple, joined_to_groups(rows, groups, ["k", "j"], "n", share=share).collect()), key=repr)
    tops = {k: (keys.count(k), max(i for i, x in enumerate(keys) if x == k)) for k in set(keys) if None not in k}
    assert got == sorted(((*k, i, *tops.get(k, (None, None))) for i, k in enumerate(keys)), key=repr)
    assert joined_to_groups(rows, groups.limit(0), ["k", "j"], "n").count() == len(keys)
