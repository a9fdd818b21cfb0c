"""Reusable aggregate expressions.

Ratios use doubles and ``try_divide``: a zero or missing denominator gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator * F.lit(100.0), denominator)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def rate_pct(condition: Column) -> Column:
    """Share of all rows that satisfy the condition."""
    return pct(count_if(condition), F.count(F.lit(1)))


def share_pct(condition: Column, amount: Column) -> Column:
    """Share of an amount that falls on rows satisfying the condition."""
    return pct(F.sum(F.when(condition, amount).otherwise(F.lit(0.0))), F.sum(amount))


def flag_rate_pct(flag: Column) -> Column:
    """Average of 100 / 0 over a boolean; a NULL flag counts as 0."""
    return F.avg(F.when(flag, F.lit(100.0)).otherwise(F.lit(0.0)))


def weighted_avg(value: Column, weight: Column) -> Column:
    return ratio(F.sum(value * weight), F.sum(weight))


def margin_pct(amount: Column, cost: Column) -> Column:
    return pct(F.sum(amount) - F.sum(cost), F.sum(amount))


def per_active_day(amount: Column, day: Column) -> Column:
    """Amount per distinct day that has rows."""
    return ratio(F.sum(amount), F.countDistinct(day))


def credit_balance(amount: Column) -> Column:
    """Sum of a credit-balance account shown as a positive number."""
    return -F.sum(amount)
