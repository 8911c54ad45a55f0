"""Rounding to decimal places by a number's exact binary value, ties to even, as column functions.

Spark rounds the shortest decimal form of a double, so 0.285 (which is a little less) would become 0.29.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multiplying by this splits a double into two halves of 26 bits.
SPLIT = float((1 << 27) + 1)
#: From here on a double has no places to round.
WHOLE = float(1 << 52)


def round_exact(value: Column, digits: int) -> Column:
    """The double that is nearest to `value` rounded to `digits` places (0 to 6); null, NaN and infinities stay."""
    scale = F.lit(float(10**digits))
    size = F.abs(value)
    product = size * scale
    split = size * F.lit(SPLIT)
    high = split - (split - size)
    missed = (high * scale - product) + (size - high) * scale  # product + missed is exact
    below = F.floor(product)
    over = (product - below - F.lit(0.5)) + missed
    units = below + F.when(over > 0, 1).when(over < 0, 0).otherwise(below % 2)
    return F.when(product < F.lit(WHOLE), F.signum(value) * units / scale).otherwise(value)
