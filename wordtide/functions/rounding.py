"""Rounding of doubles by their exact value, ties to even, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _halves(x: Column) -> tuple[Column, Column]:
    """Two doubles of half the digits each whose sum is ``x``."""
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    return high, x - high


def rounded(x: Column, digits: int) -> Column:
    """The double nearest to the exact value of ``x`` rounded to ``digits`` (0 to 3) decimals; a value just between two goes to the even one.

    ``x`` times the power of ten is kept as a double and its exact error, so that 0.125 is a tie and 2.675, which is
    a little less, is none.  Beyond 2**52 / 10**digits, where doubles have no such decimals to lose or the product no fraction, ``x`` stays.
    """
    ten = float(10**digits)
    p = x * F.lit(ten)
    high, low = _halves(x)
    error = (high * F.lit(ten) - p) + low * F.lit(ten)  # exact: powers of ten up to 1000 have few digits
    floor = F.floor(p).cast("double")
    over = (p - floor - F.lit(0.5)) + error
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(F.pmod(floor, F.lit(2.0)))
    whole = floor + up
    return F.when(F.abs(p) < F.lit(float(1 << 52)), whole / F.lit(ten)).otherwise(x)
