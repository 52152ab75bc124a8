"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL for a zero or missing denominator."""
    return F.try_divide(num, den)


def no_nan(x: Column) -> Column:
    """NaN becomes NULL, so that missing has one spelling downstream."""
    return F.when(~F.isnan(x), x)


def to_number(x: Column) -> Column:
    """Lenient cast to double: anything unparseable becomes NULL."""
    return no_nan(x.try_cast("double"))


def true_only(cond: Column) -> Column:
    """A comparison with a missing side counts as false."""
    return F.coalesce(cond, F.lit(False))


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))
