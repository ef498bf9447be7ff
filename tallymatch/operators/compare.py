"""Full outer comparison of usage and forecast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch import schema
from tallymatch.config import CategoryLabels, ReconConfig
from tallymatch.functions.variance import amount_or_zero, category_flags, variance_category, variance_percent
from tallymatch.operators.hotkeys import HotKeyConfig, salted_full_outer
from tallymatch.operators.metadata import METADATA_FLAGS, with_reasons
from tallymatch.sinks.results import written


def _match(keys: list[str], null_safe: bool) -> Column:
    pairs = [(F.col(f"u.{k}"), F.col(f"f.{k}")) for k in keys]
    return reduce(
        lambda a, b: a & b, [left.eqNullSafe(right) if null_safe else left == right for left, right in pairs]
    )


def full_outer(
    usage: DataFrame, forecast: DataFrame, keys: list[str], null_safe: bool, unique_grain: bool, hot: HotKeyConfig = HotKeyConfig()
) -> DataFrame:
    """Full outer join with resolved key columns and the markers ``in_usage`` / ``in_forecast``.

    Rows sharing a key multiply. With ``null_safe`` null keys match each other, otherwise they never match.

    ``unique_grain`` states that both sides hold only a handful of rows per key. If not, one key (say, all rows
    whose part number could not be parsed) may hold a large part of the data, and adaptive execution cannot split
    a full outer join. Both sides are then written once, and the join spreads the keys that a sketch finds to be hot.
    """
    if not unique_grain:
        return salted_full_outer(written(usage), written(forecast), keys, null_safe, ("in_usage", "in_forecast"), hot)

    left = usage.withColumn("in_usage", F.lit(True)).alias("u")
    right = forecast.withColumn("in_forecast", F.lit(True)).alias("f")
    return left.join(right, _match(keys, null_safe), "full_outer").select(
        *[F.coalesce(f"u.{k}", f"f.{k}").alias(k) for k in keys],
        *[F.col(f"u.{c}").alias(c) for c in usage.columns if c not in keys],
        *[F.col(f"f.{c}").alias(c) for c in forecast.columns if c not in keys],
        F.coalesce("in_usage", F.lit(False)).alias("in_usage"),
        F.coalesce("in_forecast", F.lit(False)).alias("in_forecast"),
    )


def pre_aggregated(usage: DataFrame) -> DataFrame:
    """Optional: one usage row per compare key, so plants sharing a location do not match a forecast row twice.

    Amounts and counts add up, a flag holds if it holds at one of the plants, the lowest method code is kept.
    """
    merged = {"actual_usage": F.sum, "transaction_count_12mo": F.sum, "method_code": F.min}
    columns = [c for c in usage.columns if c not in schema.COMPARE_KEY and c != "plant"]
    return usage.groupBy(*schema.COMPARE_KEY).agg(*[merged.get(c, F.max)(c).alias(c) for c in columns])


def join_sides(
    usage: DataFrame, forecast: DataFrame, cfg: ReconConfig, unique_grain: bool, keep_plant: bool = False
) -> DataFrame:
    """The joined rows before any null is replaced; null keys match null keys."""
    if cfg.pre_aggregate:
        usage = pre_aggregated(usage)
    elif not keep_plant:
        usage = usage.drop("plant")
    return full_outer(usage, forecast, schema.COMPARE_KEY, null_safe=True, unique_grain=unique_grain)


def with_variance(joined: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Missing amounts become 0; then variance (forecast - actual), its percent and its absolute value."""
    filled = joined.withColumns(
        {c: amount_or_zero(F.col(c), cfg.amount_type) for c in ("actual_usage", "forecast_usage")}
    )
    actual, forecast = F.col("actual_usage"), F.col("forecast_usage")
    return filled.withColumns(
        {
            "variance": forecast - actual,
            "variance_percent": variance_percent(actual, forecast),
            "absolute_variance": F.abs(forecast - actual),
        }
    )


def compare(usage: DataFrame, forecast: DataFrame, cfg: ReconConfig, unique_grain: bool = False) -> DataFrame:
    joined = join_sides(usage, forecast, cfg, unique_grain)
    return with_variance(joined, cfg).drop("in_usage", "in_forecast")


def categorize(compared: DataFrame, labels: CategoryLabels) -> DataFrame:
    category = variance_category(F.col("actual_usage"), F.col("forecast_usage"), labels)
    return compared.withColumn("variance_category", category)


def match_presence(joined: DataFrame) -> DataFrame:
    """Joined rows by the side they come from, and how many have a positive amount on both sides."""
    used, forecasted = F.col("in_usage"), F.col("in_forecast")
    positive = (F.col("actual_usage") > 0) & (F.col("forecast_usage") > 0)
    presence = (
        F.when(used & forecasted, "both").when(used, "usage_only").otherwise("forecast_only").alias("presence")
    )
    return joined.groupBy(presence).agg(F.count("*").alias("n_rows"), F.count_if(positive).alias("positive_rows"))


def compare_view(
    usage: DataFrame,
    forecast: DataFrame,
    reasons: DataFrame,
    part_master: DataFrame | None,
    cfg: ReconConfig,
    unique_grain: bool = False,
) -> DataFrame:
    """Detail-view comparison: null keys never match, one output row per exclusion reason of the resolved key.

    Only rows without usage can have a reason, because listed usage was dropped before. So forecast rows bring the
    reasons of their key with them into the join, and the wide result is not shuffled for them.
    """
    usage = usage.withColumnRenamed("plant", "usage_plant")
    forecast = with_reasons(forecast, reasons).withColumnRenamed("plant", "forecast_plant")
    joined = (
        full_outer(usage, forecast, schema.COMPARE_KEY, null_safe=False, unique_grain=unique_grain)
        .withColumn("plant", F.coalesce("usage_plant", "forecast_plant"))
        .drop("usage_plant", "forecast_plant", "original_period", *schema.COUNT_COLUMNS)
    )
    # the difference is taken on exact zeros-for-null, as the categories are
    measured = categorize(with_variance(joined, cfg), cfg.labels)
    own = F.when(~F.col("in_usage"), F.col("reasons"))
    reasoned = measured.withColumn(
        "exclusion_reason", F.explode(F.coalesce(own, F.array(F.lit("Not_Excluded"))))
    ).drop("reasons", "in_usage", "in_forecast")
    if part_master is None:
        return reasoned
    return reasoned.join(part_master.select(*schema.PART_KEY, "prod_code"), schema.PART_KEY, "left")


def add_flags(compared: DataFrame, labels: CategoryLabels) -> DataFrame:
    return compared.select("*", *category_flags(F.col("variance_category"), labels))


RESULT_COLUMNS = [
    "company",
    "location",
    "part_num",
    "period",
    "actual_usage",
    *METADATA_FLAGS,
    "transaction_count_12mo",
    "forecast_usage",
    "variance",
    "variance_percent",
    "absolute_variance",
    "variance_category",
]
