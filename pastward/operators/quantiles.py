"""Exact order statistics of groups of any size.

Equal values are counted first. The counts are dealt out by ranges of values, so each slice of a group is bounded and the
slices are in order; the rows before a slice follow from one number per slice. Only slices that hold a wanted rank are
ranked, each on its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pastward.session import staged


def present_values(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form ``by…, column, value`` without missing values."""
    numbers = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns))
    return numbers.unpivot(list(by), list(columns), "column", "value").where("value IS NOT NULL AND NOT isnan(value)")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Linearly interpolated quantiles: one row ``by…, column, p, value`` per group, column and probability.

    ``slices`` is the number of value ranges, that of shuffle partitions if not given.
    """
    group = [*by, "column"]
    counted = staged(present_values(df, columns, by).groupBy(*group, "value").agg(F.count("*").alias("rows")))
    order = [*group, "value"]
    ranged = counted.repartitionByRange(slices, *order) if slices else counted.repartitionByRange(*order)
    sliced = staged(ranged.withColumn("slice", F.spark_partition_id()))

    whole = W.partitionBy(*group)
    sums = sliced.groupBy(*group, "slice").agg(F.sum("rows").alias("held"))
    before = F.sum("held").over(whole.orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*group, "slice", "held", F.coalesce(before, F.lit(0)).alias("before"), F.sum("held").over(whole).alias("n"))
    rank = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    wanted = F.array(*(F.struct(F.lit(float(p)).alias("p"), rank(p).alias("rank"), end(rank(p)).alias("at")) for p in probs for end in (F.floor, F.ceil)))
    here = F.filter(wanted, lambda t: (t["at"] >= F.col("before")) & (t["at"] < F.col("before") + F.col("held")))
    targets = sums.select(*(F.col(c).alias(f"of_{c}") for c in (*group, "slice")), "before", F.array_distinct(here).alias("wanted")).where(F.size("wanted") > 0)

    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*group, "slice")))
    upto = F.sum("rows").over(W.partitionBy(*group, "slice").orderBy("value"))
    ranked = sliced.join(targets, same).withColumn("last", F.col("before") + upto - 1)
    hits = F.filter("wanted", lambda t: (t["at"] <= F.col("last")) & (t["at"] > F.col("last") - F.col("rows")))
    found = ranked.select(*group, "value", F.explode(hits).alias("hit")).select(*group, "value", "hit.*")
    low, high = (F.max(F.when(F.col("at") == end("rank"), F.col("value"))) for end in (F.floor, F.ceil))
    share = F.col("rank") - F.floor("rank")
    return found.groupBy(*group, "p", "rank").agg(low.alias("low"), high.alias("high")).select(
        *group, "p", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("value")
    )
