"""Exponentially weighted means of the past: e = (w·e + a·y) / (w + a) with a = 2 / (span + 1), starting at the first value.

``w`` is 1 - a to the power of the rows since the last value, so a missing value keeps the mean but ages it; without gaps
this is e = (1 - a)·e + a·y. Every step is affine in e, so rows are cut into chunks: a chunk's own steps make one affine map,
the maps of the few chunks that still matter give the mean a chunk starts from, and inside a chunk the mean is a running
sum. Only one row per chunk is ever ordered per series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pastward.operators.ordering import BLOCK, ROW, own_block
from pastward.spec import SeriesSpec

CHUNK = "_chunk"
CARRIES = "_carries"
FIRST = "_ewm_first"  # the first value of the chunk before the current row
FIRST_ROW = "_ewm_first_row"
LARGEST_WEIGHT = 1e100  # bound on the inverse weights inside a chunk
SMALLEST_WEIGHT = 5e-324  # weights below this are 0 as doubles


def present(value: str) -> Column:
    """The value as a number; NaN counts as missing."""
    return F.nanvl(F.col(value).cast("double"), F.lit(None))


def decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def chunk_rows(spec: SeriesSpec, spans: tuple[float, ...]) -> int:
    """Rows per chunk: a power of two that divides a block and keeps the inverse weights of every span in range."""
    if min(spans) <= 1:
        raise ValueError("spans must be above 1")
    fastest = min(decay(span) for span in spans)
    limit = math.log(LARGEST_WEIGHT) / -math.log(fastest)
    return min(spec.block_rows, 2 ** int(math.log2(max(limit, 1.0))))


def _shares(span: float, rows: Column) -> tuple[Column, Column]:
    """What is kept of the old mean and taken of a new value that comes ``rows`` rows after the last one."""
    w, a = F.pow(F.lit(decay(span)), rows), 1.0 - decay(span)
    return w / (w + a), F.lit(a) / (w + a)


def _steps(rows: DataFrame, spec: SeriesSpec, value: str, spans: tuple[float, ...]) -> DataFrame:
    """Columns of blocked rows that tell the mean after any row from the mean before the chunk.

    For each span: the logarithm of what is kept of the chunk's first value, and the sum of later values in units of it.
    """
    inside = W.partitionBy(spec.key, BLOCK, CHUNK).orderBy(ROW)
    before, upto = inside.rowsBetween(W.unboundedPreceding, -1), inside.rowsBetween(W.unboundedPreceding, 0)
    y = present(value)
    rows = rows.withColumns(
        {
            "_ewm_last": F.max(F.when(y.isNotNull(), F.col(ROW))).over(before),
            FIRST: F.first(y, ignorenulls=True).over(before),
            FIRST_ROW: F.min(F.when(y.isNotNull(), F.col(ROW))).over(before),
        }
    )
    since = F.when(y.isNotNull() & F.col("_ewm_last").isNotNull(), F.col(ROW) - F.col("_ewm_last"))
    kept = {i: F.coalesce(F.log(_shares(span, since)[0]), F.lit(0.0)) for i, span in enumerate(spans)}
    rows = rows.withColumns({f"_ewm_kept_{i}": F.sum(log).over(upto) for i, log in kept.items()})
    taken = {i: F.coalesce(_shares(span, since)[1] * y, F.lit(0.0)) * F.exp(-F.col(f"_ewm_kept_{i}")) for i, span in enumerate(spans)}
    rows = rows.withColumns({f"_ewm_taken_{i}": F.sum(part).over(upto) for i, part in taken.items()})
    return rows.drop("_ewm_last")


def _chunk_maps(blocks: DataFrame, spec: SeriesSpec, value: str, spans: tuple[float, ...]) -> DataFrame:
    """Per chunk: its first and last row with a value, its first value, and for each span the last of ``_steps``."""
    y = present(value)
    own = blocks.where(F.col(BLOCK) == own_block(spec))
    ends = [F.max_by(F.struct(f"_ewm_kept_{i}", f"_ewm_taken_{i}"), ROW).alias(f"end_{i}") for i in range(len(spans))]
    return own.groupBy(spec.key, CHUNK).agg(
        F.min(F.when(y.isNotNull(), F.col(ROW))).alias("first_row"),
        F.max(F.when(y.isNotNull(), F.col(ROW))).alias("last_row"),
        F.min_by(y, F.when(y.isNotNull(), F.col(ROW))).alias("first"),
        *ends,
    )


def chunk_carries(blocks: DataFrame, spec: SeriesSpec, value: str, spans: tuple[float, ...]) -> DataFrame:
    """Per block, a map from chunk to the row of the last value before the chunk and the mean of each span there."""
    size = chunk_rows(spec, spans)
    maps = _chunk_maps(blocks, spec, value, spans)
    order = W.partitionBy(spec.key).orderBy(CHUNK)
    # a chunk's weight falls by that of its rows and grows by 1 / a for a gap at most; twice as many chunks make up for gaps
    reach = 2 + max(2 * math.ceil(math.log(SMALLEST_WEIGHT) / (size * math.log(decay(span)))) for span in spans)
    recent = order.rowsBetween(-reach, -1)
    filled = maps.where("first_row IS NOT NULL").withColumn("rows", F.col("first_row") - F.lag("last_row").over(order))
    for i, span in enumerate(spans):
        old, new = _shares(span, F.col("rows"))
        end = F.exp(F.col(f"end_{i}._ewm_kept_{i}"))
        step = F.struct(
            F.coalesce(end * old, F.lit(0.0)).alias("times"),
            (end * (F.coalesce(new, F.lit(1.0)) * F.col("first") + F.col(f"end_{i}._ewm_taken_{i}"))).alias("plus"),
        )
        filled = filled.withColumn(f"step_{i}", step)
    follow = lambda acc, s: acc * s["times"] + s["plus"]
    filled = filled.withColumns({f"before_{i}": F.collect_list(f"step_{i}").over(recent) for i in range(len(spans))})
    after = [follow(F.aggregate(f"before_{i}", F.lit(0.0), follow), F.col(f"step_{i}")).alias(f"after_{i}") for i in range(len(spans))]
    filled = filled.select(F.col(spec.key).alias("of_key"), F.col(CHUNK).alias("of_chunk"), *after)
    both = maps.select(spec.key, CHUNK, "last_row").join(filled, F.col(spec.key).eqNullSafe(F.col("of_key")) & (F.col(CHUNK) == F.col("of_chunk")), "left")
    past = order.rowsBetween(W.unboundedPreceding, -1)
    latest = [F.last(c, ignorenulls=True).over(past).cast("double") for c in ("last_row", *(f"after_{i}" for i in range(len(spans))))]
    carries = both.select(spec.key, CHUNK, F.array(*latest).alias("carry"))
    # a block holds block_rows / size chunks, so the map is small
    return carries.groupBy(spec.key, F.floor(F.col(CHUNK) * size / spec.block_rows).alias(BLOCK)).agg(
        F.map_from_entries(F.collect_list(F.struct(CHUNK, "carry"))).alias(CARRIES)
    )


def join_carries(history: DataFrame, spec: SeriesSpec, value: str, spans: tuple[float, ...]) -> DataFrame:
    """Add to blocked rows the chunk number, the block's carries and the columns that :func:`ewm_columns` reads.

    Rows and carries are spread by key and block, the spreading that the look-back windows need anyway.
    """
    blocks = _steps(history.withColumn(CHUNK, F.floor(F.col(ROW) / chunk_rows(spec, spans))), spec, value, spans)
    # copied rows lie in chunks of earlier blocks, which are not read
    return blocks.join(chunk_carries(blocks, spec, value, spans).hint("shuffle_hash"), [spec.key, BLOCK], "left")


def ewm_columns(spec: SeriesSpec, value: str, spans: tuple[float, ...], prefix: str) -> dict[str, Column]:
    """The mean of all rows before the current one, for frames made by :func:`join_carries`; null before the first value."""
    before = W.partitionBy(spec.key, BLOCK, CHUNK).orderBy(ROW)
    carry = F.try_element_at(F.col(CARRIES), F.col(CHUNK))
    rows = F.col(FIRST_ROW) - carry[0]
    columns = {}
    for i, span in enumerate(spans):
        old, new = _shares(span, rows)
        mean = carry[i + 1]
        start = F.coalesce(old * mean + new * F.col(FIRST), F.col(FIRST))
        kept, taken = (F.lag(f"_ewm_{name}_{i}").over(before) for name in ("kept", "taken"))
        columns[f"{prefix}_{span}"] = F.when(F.col(FIRST_ROW).isNull(), mean).otherwise(F.exp(kept) * (start + taken))
    return columns


def helpers(spans: tuple[float, ...]) -> list[str]:
    """The columns that :func:`join_carries` adds."""
    return [CHUNK, CARRIES, FIRST, FIRST_ROW, *(f"_ewm_{name}_{i}" for i in range(len(spans)) for name in ("kept", "taken"))]
