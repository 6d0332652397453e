"""Arithmetic under one rule: missing stays missing, infinities become missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return finite(F.try_divide(numerator.cast("double"), denominator.cast("double")))


def cagr(current: Column, previous: Column, years: float) -> Column:
    """Compound growth; only defined between two positive values."""
    both = (current > 0) & (previous > 0)
    return F.when(both, F.pow(safe_divide(current, previous), F.lit(1.0 / years)) - 1.0)


def is_true(condition: Column) -> Column:
    """A comparison with a missing value counts as false."""
    return F.coalesce(condition, F.lit(False))


def exact_sum(value: Column, decimals: int) -> Column:
    """Sum of amounts with a fixed number of decimals, added up as whole units.

    Long addition is exact, so the total does not depend on task order, and the
    buffer is one long per group.
    """
    scale = 10 ** decimals
    return F.sum(F.round(value * float(scale)).cast("long")) / F.lit(float(scale))


def first_match(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    otherwise = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return out.otherwise(otherwise)
