"""The detail view: wide, calendar-enriched comparison with exclusion reasons."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch import schema
from tallymatch.config import CategoryLabels, ReconConfig
from tallymatch.functions import calendar as cal
from tallymatch.functions.variance import category_flags
from tallymatch.operators import compare as cmp
from tallymatch.operators import metadata as md
from tallymatch.operators import normalize as nz


def view_config(cfg: ReconConfig) -> ReconConfig:
    return replace(cfg, labels=CategoryLabels.snake(), pre_aggregate=False, normalize_keys=False)


def parsed_usage(source, cfg: ReconConfig) -> DataFrame:
    return nz.parse_key_view(nz.scan_usage(source, cfg))


def reasons(source, cfg: ReconConfig, parts: DataFrame | None = None) -> DataFrame:
    low = md.low_usage_parts(parsed_usage(source, cfg), md.last_forecast_period(source), cfg, parts)
    return md.exclusion_reasons(source, low, cfg, parts)


def listed_usage_dropped(source, cfg: ReconConfig, reason_rows: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    usage = parsed_usage(source, cfg) if parsed is None else parsed
    kept = md.exclude_listed(nz.filter_companies(usage, cfg, keep_null=False), reason_rows)
    return nz.normalize_usage_view(kept, cfg)


def comparison(source, cfg: ReconConfig, period: date | None = None, with_prod_code: bool = True) -> DataFrame:
    """Compared rows. A single ``period`` is cut out of both sides before the join: it is part of the join key, so
    the result is the same and only one month is shuffled. Reasons look at the whole run range, but then only at the
    parts of that month."""
    cfg = view_config(cfg)
    parts = None
    if period is None:
        parsed, sent = parsed_usage(source, cfg), nz.scan_forecast(source, cfg)
    else:
        first = max(period.replace(day=1), cfg.start)
        last = min(period, cfg.end)
        parsed = nz.parse_key_view(source.usage(first, last))
        sent = source.forecast(first, last)
        forecast_parts = sent.select(F.col("product").alias("part_num"), "company")
        parts = parsed.select(*schema.PART_KEY).unionByName(forecast_parts).distinct()
    reason_rows = reasons(source, cfg, parts)
    usage = listed_usage_dropped(source, cfg, reason_rows, parsed)
    forecast = nz.normalize_forecast_view(sent, cfg)
    part_master = source.part_master() if with_prod_code else None
    compared = cmp.compare_view(usage, forecast, reason_rows, part_master, cfg, source.unique_grain)
    return compared if period is None else compared.where(F.col("period") == F.lit(period))


def _wide(compared: DataFrame, identity: list[Column], cfg: ReconConfig) -> DataFrame:
    period, as_of = F.col("period"), cal.as_of_date(cfg.as_of)
    epoch = F.lit(cfg.sort_epoch or cfg.start)
    amounts = [F.coalesce(f"qty_{c}", F.lit(0.0)).alias(f"qty_{c}_amount") for c in "abcd"]
    return compared.select(
        *identity,
        period.alias("validation_date"),
        "actual_usage",
        "forecast_usage",
        F.col("variance").alias("variance_amount"),
        "variance_percent",
        "absolute_variance",
        "variance_category",
        *category_flags(F.col("variance_category"), CategoryLabels.snake()),
        *amounts,
        "original_key",
        "exclusion_reason",
        *cal.calendar_parts(period),
        *cal.period_keys(period),
        *cal.relative_dates(period, as_of),
        *cal.completeness(period, as_of, epoch),
    )


def view_full(source, cfg: ReconConfig) -> DataFrame:
    """39 columns: identity 5, amounts 5, category 1, flags 3, components 6, calendar 6, keys 3, relative 7, state 3."""
    identity = [
        F.col("company").alias("company_code"),
        F.col("location").alias("location_name"),
        F.col("part_num"),
        F.col("prod_code"),
    ]
    return _wide(comparison(source, cfg), identity, cfg)


def view_single_period(source, cfg: ReconConfig, period: date) -> DataFrame:
    """The view of one month, without product code, in report order."""
    identity = [
        F.col("company").alias("company_code"),
        F.col("location").alias("location_name"),
        F.col("part_num").alias("product_code"),
    ]
    compared = comparison(source, cfg, period, with_prod_code=False)
    return _wide(compared, identity, cfg).orderBy("company_code", "location_name", "product_code")
