"""Variance measures and categories of one forecast/actual pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymatch.config import CategoryLabels

# Percent markers for a missing side.
NO_ACTUAL_PERCENT = 999.99
NO_FORECAST_PERCENT = -999.99


def amount_or_zero(amount: Column, amount_type: str = "double") -> Column:
    """The amount in the configured type, with null and NaN read as 0."""
    if amount_type == "double":
        value = amount.cast("double")
        return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
    # a NaN does not fit a decimal: it becomes null under try_cast
    return F.coalesce(amount.try_cast(amount_type), F.lit(0).cast(amount_type))


def variance_percent(actual: Column, forecast: Column) -> Column:
    """Absolute variance as percent of actual, two decimals; markers where one side is zero.

    A negative actual gives a negative percent. Inputs must be free of nulls (``amount_or_zero``).
    """
    return (
        F.when((actual == 0) & (forecast == 0), F.lit(0.0))
        .when(actual == 0, F.lit(NO_ACTUAL_PERCENT))
        .when(forecast == 0, F.lit(NO_FORECAST_PERCENT))
        .otherwise(F.round((F.abs(forecast - actual) * 100.0 / actual).cast("double"), 2))
    )


def variance_category(actual: Column, forecast: Column, labels: CategoryLabels) -> Column:
    """First rule that holds; the last label is reached only with infinite amounts."""
    return (
        F.when(F.abs(forecast - actual) == 0, labels.match)
        .when((actual == 0) & (forecast != 0), labels.missing_usage)
        .when((actual != 0) & (forecast == 0), labels.missing_forecast)
        .when(forecast > actual, labels.more_forecast)
        .when(actual > forecast, labels.more_usage)
        .otherwise(labels.error)
    )


def category_flags(category: Column, labels: CategoryLabels) -> list[Column]:
    return [
        category.isin(labels.critical).cast("int").alias("is_critical_issue"),
        (category == labels.match).cast("int").alias("is_perfect_match"),
        category.isin(labels.variances).cast("int").alias("has_variance"),
    ]
