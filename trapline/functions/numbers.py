"""Numeric clean-up shared by features and flows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """NULL for NaN and both infinities."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def finite_or_zero(value: Column) -> Column:
    return F.coalesce(finite(value), F.lit(0.0))


def log1p_clipped(value: Column) -> Column:
    """log(1 + x) with negative x taken as 0."""
    return F.log1p(F.greatest(value, F.lit(0.0)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0, NULL included."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def number(text: Column) -> Column:
    """Lenient numeric parse: NULL for anything that is not a number."""
    return finite(text.try_cast("double"))
