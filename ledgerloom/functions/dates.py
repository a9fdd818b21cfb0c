"""Date keys, calendar attributes and date arithmetic, all as built-in expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_to_key(day: Column) -> Column:
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def key_to_date(key: Column) -> Column:
    return F.make_date((key / 10000).cast("int"), (key / 100).cast("int") % 100, key % 100)


def clamp_date(day: Column, first: Column, last: Column) -> Column:
    return F.least(F.greatest(day, first), last)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def days_before(day: Column, days: int) -> Column:
    return F.date_sub(day, days)


def fiscal_label(day: Column) -> Column:
    """``FY25-Q3``; the fiscal year is the calendar year."""
    return F.concat(F.lit("FY"), F.date_format(day, "yy"), F.lit("-Q"), F.quarter(day).cast("string"))


# Every calendar attribute is a function of the day alone, so a fact can be grouped by
# one without joining the calendar.
CALENDAR_ATTRIBUTES = {
    "year_num": F.year,
    "quarter_num": F.quarter,
    "month_num": F.month,
    "year": F.year,
    "quarter": F.quarter,
    "month": F.month,
    "week_of_year": F.weekofyear,
    "day_of_month": F.dayofmonth,
    "day_of_week": lambda d: F.date_format(d, "EEEE"),
    "month_name": lambda d: F.date_format(d, "MMMM"),
    "fiscal_period": fiscal_label,
    "is_month_end": lambda d: F.last_day(d) == d,
    "is_weekend": lambda d: F.dayofweek(d).isin(1, 7),
}


def build_calendar(bounds: DataFrame, holidays: list[date] | None = None) -> DataFrame:
    """One row per day for the single row ``bounds(first_day, last_day)``."""
    day = F.col("full_date")
    spine = bounds.select(F.explode(F.sequence("first_day", "last_day", F.expr("interval 1 day"))).alias("full_date"))
    names = [
        "day_of_week", "day_of_month", "week_of_year", "month_num", "month_name",
        "quarter_num", "fiscal_period", "year_num", "is_month_end", "is_weekend",
    ]
    holiday = day.isin(holidays) if holidays else F.lit(False)
    return spine.select(
        date_to_key(day).alias("date_key"),
        day,
        *[CALENDAR_ATTRIBUTES[n](day).alias(n) for n in names],
        holiday.alias("is_holiday"),
    )
