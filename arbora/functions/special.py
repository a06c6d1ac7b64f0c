"""Formulas as column expressions."""

from __future__ import annotations

import math
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floors under logarithms, as results depend on them.
RATIO_FLOOR, PROB_FLOOR = 1e-300, 1e-10


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, stepped down by the recurrence."""
    y = x + 8
    steps = F.ln(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) + 1 / (1188 * F.pow(y, F.lit(9)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - steps


def floored_ln(x: Column, floor: float) -> Column:
    return F.ln(F.greatest(x, F.lit(floor)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
