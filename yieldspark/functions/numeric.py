"""Numeric expressions with the rounding and null rules of the yield model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_zero(column: Column) -> Column:
    """max(0, x)."""
    return F.greatest(F.lit(0.0), column.cast("double"))


def flag_to_double(column: Column) -> Column:
    """Boolean pass flag as 1.0/0.0; a missing flag counts as not passed."""
    return F.when(column, F.lit(1.0)).otherwise(F.lit(0.0))


def round_half_even(column: Column) -> Column:
    """Round to a whole number, ties to even (2.5 → 2, 3.5 → 4)."""
    return F.rint(column)


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def tenths_half_even_exact(value: Column) -> Column:
    """Round ``value`` to tenths, ties to even, on the exact binary value.

    This is how C/Python ``%.1f`` prints a double (0.45 → 0.5 but 0.35 → 0.3,
    since the doubles nearest to them lie above and below the tie).  The exact
    product ``value·10`` is ``p + e`` from TwoSum of ``value·8`` and
    ``value·2`` (both exact power-of-two scalings); only when ``p`` sits
    exactly on a ``.5`` tie does the sign of ``e`` decide.
    """
    a = value * F.lit(8.0)
    b = value * F.lit(2.0)
    p = a + b
    bb = p - a
    e = (a - (p - bb)) + (b - bb)
    lower = F.floor(p).cast("double")
    tie = (p - lower) == F.lit(0.5)
    tenths = (
        F.when(tie & (e > 0), lower + F.lit(1.0))
        .when(tie & (e < 0), lower)
        .otherwise(F.rint(p))
    )
    return tenths / F.lit(10.0)


def percent_text(numerator: Column, denominator: Column) -> Column:
    """``100·num/den`` printed with one decimal and a percent sign (``"12.3%"``).

    The percentage is first snapped to 9 decimals so the label does not depend
    on the summation order of float numerators; it is then rounded like
    ``%.1f`` rounds a double (half-even on the exact binary value), which
    Java's formatter alone does not do.
    """
    value = F.round(
        F.try_divide(F.lit(100.0) * numerator.cast("double"), denominator.cast("double")), 9
    )
    return F.format_string("%.1f%%", tenths_half_even_exact(value))


def percent_2dp(rate: Column) -> Column:
    """``100·rate`` rounded to two decimals, ties to even on the scaled value."""
    return F.rint((F.lit(100.0) * rate) * F.lit(100.0)) / F.lit(100.0)
