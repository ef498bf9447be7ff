"""Root causes of flagged rows, for all of them at once instead of one part at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch import schema
from tallymatch.config import ReconConfig
from tallymatch.functions.calendar import month_end
from tallymatch.functions.variance import amount_or_zero
from tallymatch.operators.lookup import lookup
from tallymatch.operators.metadata import code_number, total_units, unique_metadata
from tallymatch.operators.normalize import normalize_key_text, parse_key, reverse_map_site, usage_rule
from tallymatch.sources.literal import small_frame

CASE_KEY = ["part_num", "period", "plant", "company"]

# Owner, verdict, priority (null = by usage volume) and severity of each root cause.
ROOT_CAUSES = [
    ("CONFIGURATION_ISSUE", "Configuration/Admin team", "NOT A DATA ISSUE - Configuration choice", "Low", "Low"),
    (
        "LEGITIMATE_MISSING_PART",
        "Procurement/Planning team",
        "LEGITIMATE DATA INTEGRITY ISSUE - Requires action",
        None,
        "Medium-High",
    ),
    ("DATA_SYNC_ISSUE", "IT/Integration team", "SYSTEM ISSUE - Check integration", "High", "High"),
    (
        "FORECASTING_ACCURACY",
        "Planning/Forecasting team",
        "FORECASTING ISSUE - Review parameters",
        "Medium",
        "Low-Medium",
    ),
    ("UNKNOWN", "Analysis team", "UNKNOWN - Requires manual review", "Medium", None),
]
HIGH_VOLUME = 50
MEDIUM_VOLUME = 10
STANDARD_CLASSES = ["PUR", "MFG"]


def with_plant(result: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Result rows with the plant to look them up at: that of the usage row, or, for rows without usage, the one their
    location stands for. A result that was written without plants has only the latter."""
    if "plant" not in result.columns:
        return reverse_map_site(result, cfg)
    mapped = reverse_map_site(result.withColumnRenamed("plant", "__used_plant"), cfg)
    plant = F.when(F.col("in_usage"), F.col("__used_plant")).otherwise(F.col("plant"))
    return mapped.withColumn("plant", plant).drop("__used_plant", "in_usage")


def flagged(result: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Rows that are no match."""
    return with_plant(result.where(F.col("variance_category") != cfg.labels.match), cfg)


def chosen(result: DataFrame, keys: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Rows, matches too, whose company, part, location and period are in the table ``keys``."""
    wanted = keys.select(*schema.COMPARE_KEY).distinct()
    return with_plant(lookup(result, wanted, schema.COMPARE_KEY, "left_semi"), cfg)


def of_cases(rows: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """Only the rows with a key of some case. Put before the first shuffle of a whole table: few case keys are broadcast,
    many are shuffled, and what is grouped and sorted afterwards is as large as the cases are many."""
    return lookup(rows, cases.select(*keys).distinct(), keys, "left_semi")


def _of_cases(rows: DataFrame, cases: DataFrame, keys: list[str], reduced: bool) -> DataFrame:
    """For tables that meet the cases exactly later on: ``reduced`` ones hold hardly more than the rows of the cases, and
    are not shuffled once more to leave out the rest."""
    return rows if reduced else of_cases(rows, cases, keys)


def case_keys(cases: DataFrame) -> DataFrame:
    """Distinct keys to look up. Plants sharing a location give several rows per key, so lookups go by this."""
    return cases.select(*CASE_KEY).distinct()


def _parsed(usage: DataFrame, cfg: ReconConfig) -> DataFrame:
    return normalize_key_text(parse_key(usage), schema.USAGE_KEY, cfg)


def usage_history(cases: DataFrame, usage: DataFrame, cfg: ReconConfig, reduced: bool = False) -> DataFrame:
    """Look-back and all-time usage of every case key; keys without usage keep zero counts.

    The look-back has a lower bound only, 12 months before the period of the case. Usage is summed up per key and
    month, cases are added as empty months, and one window per key gives every case its own look-back. A window
    group holds one part at one site, so its size is the number of months, however many raw rows there were.
    """
    monthly = (
        _of_cases(_parsed(usage, cfg), cases, schema.USAGE_KEY, reduced)
        .groupBy(*schema.USAGE_KEY, F.to_date("period_end").alias("period"))
        .agg(
            F.count("*").alias("n_rows"),
            F.sum(total_units()).alias("units"),
            F.count(total_units()).alias("n_units"),
        )
    )
    stacked = monthly.withColumn("used_period", F.col("period")).unionByName(
        case_keys(cases).withColumn("is_case", F.lit(True)), allowMissingColumns=True
    )
    key = ", ".join(schema.USAGE_KEY)
    since = (
        # newest first: the frame then only grows from row to row, while one that reaches to the end of the group is
        # summed up anew for every row
        f"over (partition by {key} order by period desc "
        f"range between unbounded preceding and interval {cfg.lookback_months} month following)"
    )
    # same partitioning and order, so both frames share one sort
    ever = f"over (partition by {key} order by period desc range between unbounded preceding and unbounded following)"
    return (
        stacked.select(
            *CASE_KEY,
            "is_case",
            F.expr(f"coalesce(sum(units) {since}, 0.0)").alias("total_12mo"),
            F.expr(f"coalesce(sum(n_rows) {since}, 0)").alias("active_periods"),
            F.expr(f"sum(n_units) {since}").alias("valued_12mo"),
            F.expr(f"coalesce(sum(n_rows) {ever}, 0)").alias("periods_ever"),
            F.expr(f"min(used_period) {ever}").alias("first_usage"),
            F.expr(f"max(used_period) {ever}").alias("last_usage"),
            F.expr(f"sum(units) {ever}").alias("total_ever"),
            F.expr(f"sum(n_units) {ever}").alias("valued_ever"),
        )
        .where(F.col("is_case"))
        .select(
            *CASE_KEY,
            "total_12mo",
            "active_periods",
            _mean("total_12mo", "valued_12mo").alias("mean_12mo"),
            "periods_ever",
            "first_usage",
            "last_usage",
            "total_ever",
            _mean("total_ever", "valued_ever").alias("mean_ever"),
        )
    )


def _mean(total: str, count: str) -> Column:
    return F.when(F.col(count) > 0, F.round(F.col(total) / F.col(count), 2))


def forecast_presence(cases: DataFrame, forecast: DataFrame, cfg: ReconConfig, reduced: bool = False) -> DataFrame:
    """Forecast rows ever sent for the company and part of each case, whatever the location."""
    sent = normalize_key_text(
        forecast.select("company", F.col("product").alias("part_num"), "period", "qty"), schema.PART_KEY, cfg
    )
    by_part = _of_cases(sent, cases, schema.PART_KEY, reduced).groupBy("company", "part_num").agg(
        F.count("*").alias("forecast_rows"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.sum("qty").alias("total_qty"),
    )
    parts = cases.select("company", "part_num").distinct()
    return parts.join(by_part, schema.PART_KEY, "left").select(
        "company",
        "part_num",
        F.coalesce("forecast_rows", F.lit(0)).alias("forecast_rows"),
        F.col("forecast_rows").isNotNull().alias("ever_in_forecast"),
        "first_period",
        "last_period",
        "total_qty",
    )


def verify(
    cases: DataFrame, usage: DataFrame, forecast: DataFrame, cfg: ReconConfig, reduced: bool = False
) -> DataFrame:
    """Recompute both amounts of every case from the raw tables and compare with the reported ones.

    The forecast lookup ignores the location; of several rows the first by location and period is taken.
    """
    case = [*CASE_KEY, "location"]
    used = (
        usage_rule(_of_cases(_parsed(usage, cfg), cases, schema.USAGE_KEY, reduced), cfg)
        .groupBy(*schema.USAGE_KEY, F.to_date("period_end").alias("period"))
        .agg(F.min(F.struct(F.col("actual_usage").isNull(), "actual_usage")).alias("first"))
        .select(*CASE_KEY, F.col("first.actual_usage").alias("found_actual"))
        .dropna(subset=schema.USAGE_KEY)
    )
    sent = normalize_key_text(
        forecast.select(
            "company",
            F.col("product").alias("part_num"),
            month_end(F.col("period")).alias("period"),
            "location",
            F.to_date("period").alias("sent_period"),
            "qty",
        ),
        schema.PART_KEY,
        cfg,
    )
    first_sent = _of_cases(sent, cases, schema.PART_KEY, reduced).groupBy("company", "part_num", "period").agg(
        F.min_by("qty", F.struct("location", "sent_period", "qty")).alias("found_forecast")
    )
    first_sent = first_sent.dropna(subset=schema.PART_KEY)
    found = (
        cases.select(*case, "actual_usage", "forecast_usage")
        .transform(lookup, used, CASE_KEY)
        .transform(lookup, first_sent, ["part_num", "period", "company"])
        .withColumns({c: amount_or_zero(F.col(c), cfg.amount_type) for c in ("found_actual", "found_forecast")})
    )
    actual_ok = F.col("found_actual") == F.col("actual_usage")
    forecast_ok = F.col("found_forecast") == F.col("forecast_usage")
    return found.withColumns(
        {"actual_matches": actual_ok, "forecast_matches": forecast_ok, "data_verified": actual_ok & forecast_ok}
    )


def criteria(
    cases: DataFrame, history: DataFrame, part_master: DataFrame, part_site: DataFrame, cfg: ReconConfig
) -> DataFrame:
    """Exclusion criteria of every case key.

    The four metadata flags are unset without metadata, the low-usage flag without look-back usage. Low usage counts
    towards ``any_failed`` only where metadata exists. The method code is no criterion here.
    """
    sites = of_cases(normalize_key_text(part_site, schema.USAGE_KEY, cfg), cases, schema.USAGE_KEY)
    described = normalize_key_text(
        normalize_key_text(part_master, schema.PART_KEY, cfg).join(sites, schema.PART_KEY).select(
            *schema.USAGE_KEY, "class_id", "inactive", "runout", "non_stock"
        ),
        schema.USAGE_KEY,
        cfg,
    )
    # a doubled metadata row fails the job, as it does in the run
    described = unique_metadata(described, ["class_id", "inactive", "runout", "non_stock"]).select(
        *schema.USAGE_KEY, F.struct("class_id", "inactive", "runout", "non_stock").alias("m"), F.lit(True).alias("known")
    )

    def when_known(flag: Column) -> Column:
        return F.when(F.col("known"), F.coalesce(flag, F.lit(False)))

    low_usage = F.when(F.col("active_periods") > 0, F.col("total_12mo") <= cfg.max_low_units)
    checked = (
        case_keys(cases)
        .join(history.select(*CASE_KEY, "total_12mo", "active_periods"), CASE_KEY, "left")
        .join(described, schema.USAGE_KEY, "left")
        .select(
            *CASE_KEY,
            "total_12mo",
            F.col("m.class_id").alias("class_id"),
            when_known(F.col("m.non_stock").cast("boolean")).alias("fails_non_stock"),
            when_known(F.col("m.inactive").cast("boolean")).alias("fails_inactive"),
            when_known(F.col("m.runout").cast("boolean")).alias("fails_runout"),
            when_known(F.col("m.class_id").isin(*cfg.excluded_classes)).alias("fails_class"),
            low_usage.alias("fails_low_usage"),
            "known",
        )
    )
    any_flag = F.col("fails_non_stock") | F.col("fails_inactive") | F.col("fails_runout") | F.col("fails_class")
    any_failed = F.when(F.col("known"), any_flag | F.coalesce("fails_low_usage", F.lit(False)))
    return checked.withColumns(
        {"any_failed": any_failed, "should_be_excluded": F.coalesce(any_failed, F.lit(False))}
    ).drop("known")


def root_cause_of(excluded: Column, ever_sent: Column, actual: Column, sent: Column, exclusions_on: bool) -> Column:
    return (
        F.when(excluded & F.lit(not exclusions_on), "CONFIGURATION_ISSUE")
        .when(~excluded & ~ever_sent, "LEGITIMATE_MISSING_PART")
        .when(~excluded & ever_sent & (sent == 0), "DATA_SYNC_ISSUE")
        .when((actual > 0) & (sent > 0), "FORECASTING_ACCURACY")
        .otherwise("UNKNOWN")
    )


def root_cause(
    cases: DataFrame, checked: DataFrame, presence: DataFrame, cfg: ReconConfig, exclusions_on: bool | None = None
) -> DataFrame:
    """Every flagged row with its evidence and its root cause; joins are on distinct keys and add no rows."""
    enabled = cfg.apply_exclusions if exclusions_on is None else exclusions_on
    evidence = checked.select(
        *CASE_KEY, "total_12mo", "class_id", "fails_non_stock", "fails_low_usage", "should_be_excluded"
    )
    cause = root_cause_of(
        F.col("should_be_excluded"),
        F.col("ever_in_forecast"),
        F.col("actual_usage"),
        F.col("forecast_usage"),
        enabled,
    )
    return (
        cases.select(*CASE_KEY, "location", "actual_usage", "forecast_usage", "variance_category")
        .transform(lookup, evidence, CASE_KEY)
        .transform(lookup, presence.select(*schema.PART_KEY, "ever_in_forecast"), schema.PART_KEY)
        .withColumns(
            {
                "total_12mo": F.coalesce("total_12mo", F.lit(0.0)),
                "should_be_excluded": F.coalesce("should_be_excluded", F.lit(False)),
                "ever_in_forecast": F.coalesce("ever_in_forecast", F.lit(False)),
            }
        )
        .withColumn("root_cause", cause)
    )


def root_cause_priority(diagnosed: DataFrame) -> DataFrame:
    """Add owner, verdict, severity and priority; a missing part is ranked by its look-back volume."""
    names = ("root_cause", "owner", "verdict", "fixed_priority", "severity")
    kinds = T.StructType([T.StructField(n, T.StringType()) for n in names])
    causes = small_frame(diagnosed.sparkSession, kinds, ROOT_CAUSES)
    by_volume = (
        F.when(F.col("total_12mo") > HIGH_VOLUME, "High")
        .when(F.col("total_12mo") > MEDIUM_VOLUME, "Medium")
        .otherwise("Low")
    )
    return (
        diagnosed.join(F.broadcast(causes), "root_cause")
        .withColumn("priority", F.coalesce("fixed_priority", by_volume))
        .drop("fixed_priority")
    )


def quick_patterns(diagnosed: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Four patterns that can be read off without the full decision chain; several may hold."""
    stocked = ~F.col("fails_non_stock")
    never = ~F.col("ever_in_forecast")
    used, sent = F.col("actual_usage") > 0, F.col("forecast_usage") > 0
    patterns = {
        "non_stock_low_usage": F.col("fails_non_stock") & (F.col("total_12mo") <= cfg.max_low_units) & never,
        "stocked_never_forecast": stocked
        & F.col("class_id").isin(STANDARD_CLASSES)
        & (F.col("total_12mo") > MEDIUM_VOLUME)
        & never,
        "stopped_in_forecast": ~never & (F.col("forecast_usage") == 0) & used,
        "forecast_variance": used & sent & ~F.col("should_be_excluded"),
    }
    return diagnosed.select(
        *CASE_KEY,
        "location",
        "actual_usage",
        "forecast_usage",
        *[F.coalesce(p, F.lit(False)).alias(name) for name, p in patterns.items()],
    )


# --- lookups of one part -----------------------------------------------------------------------------------------


def part_forecast_lookup(forecast: DataFrame, part_num: str) -> DataFrame:
    """All forecast rows of a part, newest first."""
    return forecast.where(F.col("product") == part_num).orderBy("product", F.desc("period"), "company", "location")


def part_usage_lookup(usage: DataFrame, text: str, newest: int | None = None) -> DataFrame:
    """Monthly totals of all keys containing the text, newest first; only the ``newest`` rows if that is asked for."""
    found = (
        usage.where(F.col("site_part_key").contains(text))
        .groupBy("site_part_key", "period_end")
        .agg(F.sum(total_units()).alias("total_usage"))
        .orderBy(F.desc("period_end"), "site_part_key")
    )
    return found if newest is None else found.limit(newest)


def part_exemption_lookup(source, part_num: str, cfg: ReconConfig) -> DataFrame:
    """Method code and description of a part at each plant."""
    codes = source.method_codes().where(F.col("code_type") == cfg.method_code_type)
    return (
        source.part_site()
        .where(F.col("part_num") == part_num)
        .join(source.part_site_ud(), F.col("row_id") == F.col("foreign_row_id"))
        .join(codes.withColumn("code", code_number(F.col("code_id"))), "company")
        .where(F.col("method_code").cast("double") == F.col("code"))
        .select("method_code", "code_desc", "company", "plant", "part_num", "non_stock", "row_id")
        .orderBy("company", "plant", "code_desc", "row_id")
    )


def part_card_lookup(part_master: DataFrame, company: str, part_num: str) -> DataFrame:
    """Part card; the description columns are shown where the table has them."""
    optional = [c for c in ("part_description", "user_char_1") if c in part_master.columns]
    return part_master.where((F.col("company") == company) & (F.col("part_num") == part_num)).select(
        "company", "part_num", *optional, "inactive", "runout", "class_id", "prod_code"
    )
