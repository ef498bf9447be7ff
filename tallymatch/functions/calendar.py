"""Calendar attributes of a month-end period."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_end(day: Column) -> Column:
    return F.last_day(F.to_date(day))


def as_of_date(as_of: date | None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of)


def _month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _quarter_number(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day)


def months_crossed(earlier: Column, later: Column) -> Column:
    """Month boundaries between two days, so 31 January to 28 February is one month."""
    return _month_number(later) - _month_number(earlier)


def quarters_crossed(earlier: Column, later: Column) -> Column:
    return _quarter_number(later) - _quarter_number(earlier)


def calendar_parts(period: Column) -> list[Column]:
    return [
        F.year(period).alias("validation_year"),
        F.month(period).alias("validation_month"),
        F.quarter(period).alias("validation_quarter"),
        F.dayofmonth(period).alias("validation_day"),
        F.date_format(period, "MMMM").alias("month_name"),
        F.date_format(period, "MMM").alias("month_abbreviation"),
    ]


def period_keys(period: Column) -> list[Column]:
    return [
        F.date_format(period, "yyyyMM").alias("period_key"),
        F.date_format(period, "yyyy-MM").alias("period_year_month"),
        F.concat(F.year(period).cast("string"), F.lit("Q"), F.quarter(period).cast("string")).alias("quarter_key"),
    ]


def _flag(condition: Column) -> Column:
    # a null period is in no month or quarter: 0, not null
    return F.when(condition, 1).otherwise(0)


def relative_dates(period: Column, as_of: Column) -> list[Column]:
    """Where the period lies relative to ``as_of``."""
    last_quarter = F.add_months(as_of, -3)
    return [
        _flag(F.last_day(as_of) == period).alias("is_current_month"),
        _flag(F.last_day(F.add_months(as_of, -1)) == period).alias("is_previous_month"),
        _flag(_quarter_number(as_of) == _quarter_number(period)).alias("is_current_quarter"),
        _flag(_quarter_number(last_quarter) == _quarter_number(period)).alias("is_previous_quarter"),
        _flag(F.year(as_of) == F.year(period)).alias("is_current_year"),
        months_crossed(period, as_of).alias("months_from_current"),
        quarters_crossed(period, as_of).alias("quarters_from_current"),
    ]


def completeness(period: Column, as_of: Column, epoch: Column) -> list[Column]:
    return [
        months_crossed(epoch, period).alias("sort_order"),
        _flag(period < F.last_day(as_of)).alias("is_month_complete"),
        F.dayofmonth(F.last_day(period)).alias("days_in_month"),
    ]
