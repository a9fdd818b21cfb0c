"""Typed reporting periods, applied as range predicates on the fact's own date column.

A period is half open, ``[start, end)``, so the predicate is a plain comparison that
reaches the Parquet scan and prunes date partitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def _month_start(year: int, month_index: int) -> date:
    """First day of the month ``month_index`` (0 = January; may run over the year)."""
    return date(year + month_index // 12, month_index % 12 + 1, 1)


def month_column(day: str) -> str:
    """The column by which a table is laid out whose rows belong to a day."""
    return f"{day}_month"


@dataclass(frozen=True)
class Period:
    start: date
    end: date

    @classmethod
    def year(cls, year: int) -> Period:
        return cls(date(year, 1, 1), date(year + 1, 1, 1))

    @classmethod
    def quarter(cls, year: int, quarter: int) -> Period:
        first = (quarter - 1) * 3
        return cls(_month_start(year, first), _month_start(year, first + 3))

    @classmethod
    def month(cls, year: int, month: int) -> Period:
        return cls(_month_start(year, month - 1), _month_start(year, month))

    @classmethod
    def between(cls, first_day: date, last_day: date) -> Period:
        """Both days included."""
        return cls(first_day, last_day + timedelta(days=1))

    def shift_months(self, months: int) -> Period:
        def moved(day: date) -> date:
            target = _month_start(day.year, day.month - 1 + months)
            following = _month_start(target.year, target.month)
            return target + timedelta(days=min(day.day, (following - target).days) - 1)

        return Period(moved(self.start), moved(self.end))

    def prior_year(self) -> Period:
        return self.shift_months(-12)

    def prior_quarter(self) -> Period:
        return self.shift_months(-3)

    def overlaps(self, other: Period) -> bool:
        return self.start < other.end and other.start < self.end

    def on_month(self, month: Column) -> Column:
        """Over first days of months: those that the period touches."""
        return (month >= F.lit(self.start.replace(day=1))) & (month < F.lit(self.end))

    def on(self, day: Column) -> Column:
        return (day >= F.lit(self.start)) & (day < F.lit(self.end))

    def on_key(self, key: Column) -> Column:
        """The same range on an integer ``YYYYMMDD`` key, with no calendar join."""
        first, after = (d.year * 10000 + d.month * 100 + d.day for d in (self.start, self.end))
        return (key >= F.lit(first)) & (key < F.lit(after))
