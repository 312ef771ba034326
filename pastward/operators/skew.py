"""Joins of rows to one row per key where a key may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000
SPREAD = 1 << 20


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int | None = None, share: int = SHARE) -> DataFrame:
    """``rows`` left-joined to ``groups``, which has one row for each combination of ``keys`` with the number ``size`` of rows that carry it.

    Keys of a ``share``-th of all rows or more are ``share`` at most, whatever the input; these are broadcast. All others go through a shuffle,
    or a broadcast where Spark finds them small enough: ``groups`` should be a written table. Rows that are served already are spread in that
    shuffle, so none of its keys has more than a ``share``-th of the rows. Null keys find nothing. ``total`` is the sum of the sizes if not given.
    """
    taken = {c.lower() for c in (*rows.columns, *groups.columns)}
    mark, salt = (next(n for n in (name + "_" * k for k in range(99)) if n not in taken) for name in ("_heavy", "_salt"))
    own = [c for c in groups.columns if c not in keys]
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * share >= total

    def named(part: DataFrame, prefix: str) -> DataFrame:
        return part.select(*(F.col(c).alias(f"{prefix}{c}") for c in groups.columns))

    def same(prefix: str):
        return reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.col(f"`{prefix}{k}`") for k in keys))

    heavy = named(groups.where(large), f"{mark}h_").withColumn(mark, F.lit(True))
    light = named(groups.where(~large), f"{mark}l_").withColumn(f"{salt}_", F.lit(0).cast("long"))
    lacking = reduce(lambda a, b: a | b, (F.col(f"`{k}`").isNull() for k in keys))
    first = rows.join(F.broadcast(heavy), same(f"{mark}h_"), "left")
    first = first.withColumn(salt, F.when(F.col(mark) | lacking, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(0))
    both = first.join(light, same(f"{mark}l_") & (F.col(salt) == F.col(f"{salt}_")), "left")
    found = [F.coalesce(F.col(f"`{mark}h_{c}`"), F.col(f"`{mark}l_{c}`")).alias(c) for c in own]
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), *found)
