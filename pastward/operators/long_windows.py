"""Rolling statistics whose cost does not follow the window's width.

Mean, deviation and extremes: positions are cut into segments as long as the window, so that a window is the end of one segment and
the beginning of the next. One scan forward gives every row the statistics of its segment up to it, one scan backward those from it on; a window
is put together from two of these rows. Nothing is taken away again, so digits are not lost.

Quantiles: the ranks of a block's values are split bit by bit, each level keeping how many rows before a position have a 0 there. A window's
order statistic is found by one step per bit, for all windows of the block at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pastward.operators.ordering import BLOCK, ROW, ROWS, number_rows, over_history, own_block, with_history
from pastward.spec import HOURLY, SeriesSpec

STATS = ("mean", "std", "min", "max")


def segment_levels(spec: SeriesSpec, value: str, windows: Sequence[int], prefix: str, stats: Sequence[str] = STATS) -> list[dict[str, Column]]:
    """``<prefix>_roll_<stat>_<n>`` over the ``n`` rows before each row, null unless all have a value; two steps for ``over_history``."""
    x = F.col(value)
    aggregates = {"count": F.count(x), "mean": F.avg(x), "var": F.var_pop(x), "min": F.min(x), "max": F.max(x)}
    needed = {"count", "min", "max", *(("mean", "var") if "std" in stats else ()), *(s for s in stats if s != "std")}
    first: dict[str, Column] = {}
    second: dict[str, Column] = {}
    w = W.partitionBy(spec.key, BLOCK).orderBy(ROW)
    for n in windows:
        if n < 1:
            raise ValueError("a window needs a row")
        segment = W.partitionBy(spec.key, BLOCK, F.floor(F.col(ROW) / n))
        upto = segment.orderBy(ROW).rowsBetween(W.unboundedPreceding, 0)
        onward = segment.orderBy(F.desc(ROW)).rowsBetween(W.unboundedPreceding, 0)
        for stat in sorted(needed):
            first[f"_upto_{stat}_{n}"] = aggregates[stat].over(upto)
        for stat in sorted(needed):
            first[f"_from_{stat}_{n}"] = aggregates[stat].over(onward)
        head = F.col(ROW) % n  # rows of the window in the row's own segment
        end = lambda stat, n=n: F.lag(f"_from_{stat}_{n}", n).over(w)
        start = lambda stat, n=n, head=head: F.when(head > 0, F.lag(f"_upto_{stat}_{n}", 1).over(w))
        whole = (end("count") + F.coalesce(start("count"), F.lit(0))) == n
        share = head / F.lit(float(n))
        step = F.coalesce(start("mean") - end("mean"), F.lit(0.0))
        spread = end("var") * (1 - share) + F.coalesce(start("var"), F.lit(0.0)) * share + step * step * share * (1 - share)
        low, high = F.least(end("min"), F.coalesce(start("min"), end("min"))), F.greatest(end("max"), F.coalesce(start("max"), end("max")))
        # equal values are their mean, digit by digit; the sample deviation of one row is missing
        built = {
            "mean": lambda: F.when(low == high, low).otherwise(end("mean") + step * share),
            "std": lambda: F.when(low == high, 0.0).otherwise(F.sqrt(spread * F.lit(float(n)) / F.lit(float(n - 1)))) if n > 1 else F.lit(None).cast("double"),
            "min": lambda: low,
            "max": lambda: high,
        }
        second |= {f"{prefix}_roll_{stat}_{n}": F.when(whole, built[stat]()) for stat in stats}
    return [first, second]


def rolling_statistics(df: DataFrame, value: str, windows: Sequence[int], prefix: str, spec: SeriesSpec = HOURLY, stats: Sequence[str] = STATS) -> DataFrame:
    """Add the columns of :func:`segment_levels` to a series table that is unique on key and time."""
    return over_history(df, spec, max(windows), lambda _: segment_levels(spec, value, windows, prefix, stats))


class RankTable:
    """Ranks of values by bits, with counts of zeros before every position; finds order statistics of any stretch."""

    def __init__(self, values: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        self.levels: list[tuple[np.ndarray, int]] = []
        for bit in range(max(len(values) - 1, 0).bit_length() - 1, -1, -1):
            zero = (ranks >> bit) & 1 == 0
            before = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((before, int(before[-1])))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def order_statistic(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` others below it among positions ``low`` to before ``high``."""
        low, high, k, rank = low.copy(), high.copy(), k.copy(), np.zeros(len(low), np.int64)
        for before, zeros in self.levels:
            a, b = before[low], before[high]
            left = k < b - a
            low, high = np.where(left, a, zeros + low - a), np.where(left, b, zeros + high - b)
            k = np.where(left, k, k - (b - a))
            rank = 2 * rank + ~left
        return self.sorted[rank]


def sliding_quantile(values: np.ndarray, width: int, p: float) -> np.ndarray:
    """Linearly interpolated quantile of the ``width`` values before each place; missing unless all of them are there."""
    out = np.full(len(values), np.nan)
    missing = np.concatenate([[0], np.cumsum(np.isnan(values))])
    high = np.arange(width, len(values))
    high = high[missing[high] == missing[high - width]]
    if len(high):
        table, rank = RankTable(values), p * (width - 1)
        below = np.full(len(high), int(np.floor(rank)))
        a = table.order_statistic(high - width, high, below)
        b = a if rank == below[0] else table.order_statistic(high - width, high, below + 1)
        out[high] = a + (b - a) * (rank - below[0])
    return out


def rolling_quantiles(
    df: DataFrame, value: str, windows: Sequence[int], prefix: str, spec: SeriesSpec = HOURLY, probs: dict[str, float] | None = None
) -> DataFrame:
    """Add ``<prefix>_roll_<name>_<n>`` for each window and each of ``probs`` (the median by default), null unless the ``n`` rows before have a value.

    The table must be unique on key and time; NaN counts as missing. One task holds a block of rows and the rows before it.
    """
    probs = probs or {"median": 0.5}
    added = [(f"{prefix}_roll_{name}_{n}", n, p) for n in windows for name, p in probs.items()]
    blocks = with_history(number_rows(df, spec), spec, max(windows)).withColumn("_own", own_block(spec) == F.col(BLOCK)).withColumn("_x", F.col(value).cast("double"))
    shape = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name, _, _ in added)])
    kept = df.columns

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(ROW)
        own = rows.column("_own").to_numpy()
        x = rows.column("_x").to_numpy()
        out = rows.select(kept).filter(pa.array(own))
        for name, n, p in added:
            found = sliding_quantile(x, n, p)[own]
            out = out.append_column(name, pa.array(found, pa.float64(), mask=np.isnan(found)))
        return out

    return blocks.drop(ROWS).groupBy(spec.key, BLOCK).applyInArrow(run, shape)
