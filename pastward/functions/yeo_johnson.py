"""The Yeo-Johnson power transform as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def yeo_johnson(x: Column, power: Column | float) -> Column:
    power = power if isinstance(power, Column) else F.lit(float(power))
    mirrored = 2.0 - power
    return (
        F.when((x >= 0) & (power != 0.0), F.try_divide(F.pow(x + 1.0, power) - 1.0, power))
        .when(x >= 0, F.log1p(x))
        .when(mirrored != 0.0, F.try_divide(1.0 - F.pow(1.0 - x, mirrored), mirrored))
        .otherwise(-F.log1p(-x))
    )


def centred_yeo_johnson(x: Column, power: float, centre: float) -> Column:
    """The transform less a shift and over a factor, so that large powers keep their digits where the plain form leaves the range of doubles.

    ``centre`` is a logarithm of 1 + |x| in the middle of the values, negative if the values are: these are taken in units of it. What
    lies on the other side of 0 follows the same line, as far as doubles reach.
    """
    side = 1.0 if centre >= 0 else -1.0
    k = power if side > 0 else 2.0 - power
    shift = min(-k * abs(centre), 700.0)
    u = F.log1p(F.abs(x)) - F.lit(abs(centre))
    here = F.lit(side) * F.expm1(F.lit(k) * u) / F.lit(k)
    there = yeo_johnson(x, power) * F.lit(math.exp(shift)) + F.lit(side * math.expm1(shift) / k)
    return F.when((x >= 0) if side > 0 else (x < 0), here).otherwise(there)
