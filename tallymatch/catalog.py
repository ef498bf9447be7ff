"""Every operator as a runnable query over one sample directory."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch import schema
from tallymatch.config import CategoryLabels, ReconConfig
from tallymatch.functions import calendar as cal
from tallymatch.functions.variance import variance_percent
from tallymatch.operators import compare as cmp
from tallymatch.operators import investigate as inv
from tallymatch.operators import metadata as md
from tallymatch.operators import normalize as nz
from tallymatch.operators import report, runlog
from tallymatch.plans import detail_view as view
from tallymatch.plans import reconcile as run
from tallymatch.plans.investigation import Investigation
from tallymatch.plans.job import RunLog, result_path, run_job
from tallymatch.sinks import MonthlyResult, read_result, shared_dir, write_result
from tallymatch.sources import DerivedSource

Query = Callable[[SparkSession, str], DataFrame]

CONFIG = ReconConfig(
    start=date(2000, 1, 1),
    end=date(2000, 12, 31),
    companies=("NORTH", "SOUTH", "EAST"),
    excluded_companies=("WEST",),
    locations={
        "NORTH": {
            "HQ": "North HQ",
            "A1": "Harbor",
            "A2": "Harbor",
            "B7": "Mill",
        },
        "EAST": {"HQ": "East", "E5": "Quarry"},
        "SOUTH": {"HQ": "South"},
        "WEST": {"HQ": "West"},
    },
    default_locations={"NORTH": "North HQ", "SOUTH": "South", "EAST": "East", "WEST": "West"},
    as_of=date(2001, 2, 15),
)
NO_EXCLUSIONS = replace(CONFIG, apply_exclusions=False)
VIEW = view.view_config(CONFIG)
CONFIG_FILE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "conf", "example.json")
SINGLE_PERIOD = date(2000, 8, 31)
LOOKUP_PART = "P_1"
PAGE = 2

QUERIES: dict[str, Query] = {}


def query(build: Callable[[DerivedSource], DataFrame]) -> Callable[[DerivedSource], DataFrame]:
    """Register a builder under its own name."""

    def runnable(spark: SparkSession, directory: str) -> DataFrame:
        return build(DerivedSource(spark, directory))

    QUERIES[build.__name__] = runnable
    return build


class _UndeclaredGrain(DerivedSource):
    """The same tables without the promise that no compare key is hot."""

    unique_grain = False


# --- scans -------------------------------------------------------------------------------------------------------


@query
def scan_usage(s):
    return nz.scan_usage(s, CONFIG)


@query
def scan_forecast(s):
    return nz.scan_forecast(s, CONFIG)


@query
def scan_part_metadata(s):
    return md.scan_part_metadata(s, CONFIG)


@query
def source_row_counts(s):
    return nz.source_row_counts(s.usage(), s.forecast())


@query
def view_date_bounds(s):
    return md.view_date_bounds(s, CONFIG)


# --- expressions -------------------------------------------------------------------------------------------------


def _all_keys(s: DerivedSource) -> DataFrame:
    """Full keys of all usage rows, and text with one and with no underscore."""
    parts = s.part_master()
    return (
        s.usage()
        .select("site_part_key")
        .unionByName(parts.select(F.col("part_num").alias("site_part_key")))
        .unionByName(parts.select(F.col("prod_code").alias("site_part_key")))
    )


@query
def parse_key(s):
    return nz.parse_key(_all_keys(s))


@query
def parse_key_view(s):
    return nz.parse_key_view(_all_keys(s))


@query
def key_cardinality(s):
    return nz.key_cardinality(s.usage())


@query
def map_location(s):
    return nz.map_location(nz.parse_key(_all_keys(s)), CONFIG)


@query
def map_location_view(s):
    return nz.map_location_view(nz.parse_key_view(_all_keys(s)), CONFIG)


@query
def reverse_map_site(s):
    return nz.reverse_map_site(s.forecast(), CONFIG)


@query
def usage_rule(s):
    return nz.usage_rule(nz.parse_key(s.usage()), CONFIG).select("site_part_key", "period_end", "actual_usage")


@query
def month_end(s):
    return s.read("lineitem").select(
        "l_orderkey", "l_linenumber", cal.month_end(F.col("l_shipdate")).alias("period")
    )


@query
def tran_totals(s):
    return md.tran_totals(s.usage()).select("site_part_key", "period_end", "total_transactions")


@query
def filter_companies(s):
    return nz.filter_companies(nz.parse_key(nz.scan_usage(s, CONFIG)), CONFIG).select(
        "company", "plant", "part_num", "period_end"
    )


@query
def normalize_usage(s):
    return nz.normalize_usage(nz.scan_usage(s, CONFIG), CONFIG)


@query
def normalize_forecast(s):
    return nz.normalize_forecast(nz.scan_forecast(s, CONFIG), CONFIG)


def _periods(s: DerivedSource) -> tuple[DataFrame, list]:
    return s.usage().withColumnRenamed("period_end", "period"), ["site_part_key", "period"]


@query
def calendar_parts(s):
    rows, keys = _periods(s)
    return rows.select(*keys, *cal.calendar_parts(F.col("period")))


@query
def period_keys(s):
    rows, keys = _periods(s)
    return rows.select(*keys, *cal.period_keys(F.col("period")))


@query
def relative_dates(s):
    rows, keys = _periods(s)
    period, as_of = F.col("period"), cal.as_of_date(CONFIG.as_of)
    return rows.select(
        *keys, *cal.relative_dates(period, as_of), *cal.completeness(period, as_of, F.lit(CONFIG.start))
    )


# --- exclusions and frequency ------------------------------------------------------------------------------------


def _normalized(s: DerivedSource) -> DataFrame:
    return nz.normalize_usage(nz.scan_usage(s, CONFIG), CONFIG)


def _enriched(s: DerivedSource) -> DataFrame:
    return md.enrich_metadata(_normalized(s), md.scan_part_metadata(s, CONFIG))


@query
def enrich_metadata(s):
    return _enriched(s)


@query
def exclusion_keys(s):
    return md.exclusion_keys(md.scan_part_metadata(s, CONFIG), CONFIG)


@query
def apply_exclusions(s):
    return md.apply_exclusions(_normalized(s), md.scan_part_metadata(s, CONFIG), CONFIG)


@query
def frequency_counts(s):
    return md.frequency_counts(md.frequency_usage(s, CONFIG), CONFIG)


@query
def frequency_filter(s):
    counts = md.frequency_counts(md.frequency_usage(s, CONFIG), CONFIG)
    return md.frequency_filter(_normalized(s), counts, CONFIG)


@query
def frequency_full_history(s):
    history = replace(CONFIG, start=date(2000, 7, 1), frequency_source="full_history", frequency_measure="units")
    return md.frequency_counts(md.frequency_usage(s, history), history)


@query
def exclusion_impact(s):
    return run.impact(s, CONFIG)


# --- comparison --------------------------------------------------------------------------------------------------


@query
def compare(s):
    forecast = nz.normalize_forecast(nz.scan_forecast(s, CONFIG), CONFIG)
    return cmp.compare(run.prepared_usage(s, CONFIG), forecast, CONFIG, s.unique_grain)


@query
def variance_percent_rows(s):
    joined = run.joined_sides(s, NO_EXCLUSIONS)
    filled = joined.select(
        *[F.col(k) for k in ("company", "location", "part_num", "period")],
        F.coalesce("actual_usage", F.lit(0.0)).alias("actual_usage"),
        F.coalesce("forecast_usage", F.lit(0.0)).alias("forecast_usage"),
    )
    return filled.withColumn(
        "variance_percent", variance_percent(F.col("actual_usage"), F.col("forecast_usage"))
    )


QUERIES["variance_percent"] = QUERIES.pop("variance_percent_rows")


@query
def categorize(s):
    measured = cmp.with_variance(run.joined_sides(s, NO_EXCLUSIONS), NO_EXCLUSIONS)
    return cmp.categorize(measured, CategoryLabels.snake()).select(
        "company", "location", "part_num", "period", "actual_usage", "forecast_usage", "variance_category"
    )


@query
def category_flags(s):
    return cmp.add_flags(run.reconcile(s, CONFIG), CONFIG.labels).select(
        "company",
        "location",
        "part_num",
        "period",
        "variance_category",
        "is_critical_issue",
        "is_perfect_match",
        "has_variance",
    )


@query
def match_presence(s):
    return cmp.match_presence(run.joined_sides(s, CONFIG))


@query
def reconcile(s):
    return run.reconcile(s, CONFIG)


@query
def reconcile_no_exclusions(s):
    return run.reconcile(s, NO_EXCLUSIONS)


@query
def reconcile_stepwise(s):
    return run.reconcile_stepwise(s, CONFIG)


@query
def reconcile_pre_aggregated(s):
    return run.reconcile(s, replace(CONFIG, pre_aggregate=True))


def _reconcile_hot_keys(spark: SparkSession, directory: str) -> DataFrame:
    return run.reconcile(_UndeclaredGrain(spark, directory), CONFIG)


QUERIES["reconcile_hot_keys"] = _reconcile_hot_keys


# --- reports -----------------------------------------------------------------------------------------------------


def _cube(s: DerivedSource) -> DataFrame:
    return report.result_cube(run.reconcile(s, CONFIG))


def _chart(s: DerivedSource) -> DataFrame:
    return report.chart_cube(_cube(s))


@query
def chart_cube(s):
    return _chart(s)


@query
def chart_json(s):
    return report.chart_json(_chart(s))


@query
def breakdowns(s):
    return report.breakdowns(_cube(s))


@query
def summary_counts(s):
    return report.summary_counts(_cube(s), CONFIG.labels)


@query
def variance_stats(s):
    return report.variance_stats(run.reconcile(s, CONFIG))


@query
def period_range(s):
    return report.period_range(_cube(s))


@query
def slicer_values(s):
    return report.slicer_values(_cube(s))


@query
def slice_cube(s):
    sliced = report.slice_cube(
        _chart(s), locations=["East", "North HQ"], years=["2000"], months=["03", "04", "05", "12"]
    )
    return report.month_category_totals(sliced)


@query
def slice_cube_range(s):
    sliced = report.slice_cube(_chart(s), locations=["South"], first_day="2000-04-01", last_day="2000-09-15")
    return report.month_category_totals(sliced)


@query
def crosstab(s):
    return report.crosstab(_chart(s), CONFIG.labels)


@query
def stack_max(s):
    return report.stack_max(_chart(s))


@query
def segment_share(s):
    return report.segment_share(_chart(s), CONFIG.labels)


# --- detail view -------------------------------------------------------------------------------------------------


@query
def low_usage_parts(s):
    return md.low_usage_parts(view.parsed_usage(s, VIEW), md.last_forecast_period(s), VIEW)


@query
def exclusion_reasons(s):
    return view.reasons(s, VIEW)


@query
def view_anti_exclusions(s):
    return view.listed_usage_dropped(s, VIEW, view.reasons(s, VIEW))


@query
def view_compare(s):
    return view.comparison(s, CONFIG)


@query
def view_full(s):
    return view.view_full(s, CONFIG)


def _view_hot_keys(spark: SparkSession, directory: str) -> DataFrame:
    return view.view_full(_UndeclaredGrain(spark, directory), CONFIG)


QUERIES["view_hot_keys"] = _view_hot_keys


@query
def view_single_period(s):
    return view.view_single_period(s, CONFIG, SINGLE_PERIOD)


# --- investigation -----------------------------------------------------------------------------------------------


def _investigation(s: DerivedSource, keys: DataFrame | None = None) -> Investigation:
    return Investigation.of(s, run.reconcile(s, CONFIG, keep_plant=True), CONFIG, keys)


@query
def investigate_verify(s):
    # against the whole tables: a run that starts within a month sees only part of them
    cases = _investigation(s).cases
    return inv.verify(cases, s.usage_among(cases), s.forecast_among(cases), CONFIG, s.reduces)


@query
def investigate_chosen(s):
    """Rows of chosen parts, at every location and month they were forecast for."""
    parts = s.read("part").where("p_size = 7").selectExpr("p_partkey")
    names = parts.selectExpr("concat('P_', cast(p_partkey as string), if(p_partkey % 97 = 0, '?', '')) as part_num")
    sent = s.forecast_among(s.part_master().join(names, "part_num", "left_semi")).select(
        "company", "location", F.col("product").alias("part_num"), cal.month_end(F.col("period")).alias("period")
    )
    return _investigation(s, sent.join(names, "part_num", "left_semi")).root_cause()


@query
def investigate_history(s):
    return _investigation(s).history


@query
def investigate_presence(s):
    return _investigation(s).presence


@query
def investigate_criteria(s):
    return _investigation(s).checked


@query
def root_cause(s):
    return _investigation(s).root_cause()


@query
def root_cause_exclusions_off(s):
    return _investigation(s).root_cause(exclusions_on=False)


@query
def root_cause_priority(s):
    return inv.root_cause_priority(_investigation(s).root_cause())


@query
def quick_patterns(s):
    return inv.quick_patterns(_investigation(s).root_cause(), CONFIG)


@query
def part_forecast_lookup(s):
    return inv.part_forecast_lookup(s.forecast(), LOOKUP_PART)


@query
def part_usage_lookup(s):
    return inv.part_usage_lookup(s.usage(), LOOKUP_PART)


@query
def part_exemption_lookup(s):
    return inv.part_exemption_lookup(s, LOOKUP_PART, CONFIG)


@query
def part_card_lookup(s):
    return inv.part_card_lookup(s.part_master(), "NORTH", LOOKUP_PART)


# --- files and run log -------------------------------------------------------------------------------------------


def _round_trip(s: DerivedSource, file_format: str) -> DataFrame:
    result = run.reconcile(s, CONFIG)
    path = shared_dir(result.sparkSession)
    write_result(result, path, file_format)
    return read_result(result.sparkSession, path, result.schema, file_format)


@query
def csv_roundtrip(s):
    return _round_trip(s, "csv")


@query
def parquet_roundtrip(s):
    return _round_trip(s, "parquet")


def run_events(s: DerivedSource) -> DataFrame:
    """The event table read as a run log: user = run, type = state, value = seconds."""
    kind = F.col("event_type")
    state = (
        F.when(kind == "error", runlog.FAILED)
        .when(kind == "click", runlog.RUNNING)
        .when(kind == "view", runlog.PENDING)
        .otherwise(runlog.COMPLETED)
    )
    return s.read("events").select(
        F.col("user_id").alias("run_id"),
        "ts",
        "event_id",
        state.alias("state"),
        F.col("value").alias("execution_seconds"),
    )


@query
def run_log_roundtrip(s):
    """Events of many runs, appended to a log and read back: latest state, counts and error of each run."""
    events = run_events(s).select(
        F.col("run_id").cast("string").alias("run_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        F.col("event_id").cast("int").alias("event_seq"),
        "state",
        F.lit("events").alias("triggered_by"),
        F.lit(None).cast("struct<start:date,end:date>").alias("date_range"),
        F.array(F.lit("NORTH")).alias("companies"),
        *[
            F.when(F.col("state") == runlog.COMPLETED, value).alias(name)
            for name, value in {
                "total_records": F.col("event_id"),
                "critical_issues": F.col("event_id") % 7,
                "execution_seconds": F.col("execution_seconds"),
            }.items()
        ],
        F.when(F.col("state") == runlog.FAILED, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("error"),
        F.lit(None).cast(schema.FILTER_COUNTS).alias("filters"),
    )
    log = RunLog(events.sparkSession, shared_dir(events.sparkSession))
    log.append_all(events)
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")]
    return log.latest().select(
        "run_id", *times, "triggered_by", "state", "total_records", "critical_issues", "execution_seconds", "error"
    )


RERUN = replace(NO_EXCLUSIONS, start=date(2000, 6, 1), end=date(2000, 8, 31), result_layout="months", output_format="parquet")


def _job(s: DerivedSource, cfg: ReconConfig, root: str, log: RunLog) -> str:
    spark = log.spark
    run_id = log.create(cfg)
    run_job(s, cfg, log, spark, root, run_id)
    return run_id


@query
def rerun_months(s):
    """All months of a run, then a rerun of three of them with other rules: the result has the new rows of these."""
    spark = s.spark
    root = shared_dir(spark)
    log = RunLog(spark, f"{root}/_runs")
    for cfg in (replace(RERUN, start=CONFIG.start, end=CONFIG.end, apply_exclusions=True), RERUN):
        _job(s, cfg, root, log)
    return MonthlyResult(spark, root, schema.RESULT).read()


def _from_file(s: DerivedSource) -> ReconConfig:
    """The sample configuration as a file gives it, written beside this package."""
    return replace(ReconConfig.from_json(CONFIG_FILE), output_format="csv")


@query
def job_result(s):
    """A logged job from a config file into a result folder, read back."""
    spark = s.spark
    root = shared_dir(spark)
    cfg = _from_file(s)
    run_id = _job(s, cfg, root, RunLog(spark, f"{root}/_runs"))
    return read_result(spark, result_path(root, run_id), schema.RESULT, cfg.output_format)


@query
def job_log(s):
    """The events of two logged jobs, one of which fails: states in order, range, companies, metrics, filter counts."""
    spark = s.spark
    root = shared_dir(spark)
    log = RunLog(spark, f"{root}/_runs")
    cfg = _from_file(s)
    runs = {_job(s, cfg, root, log): "good"}
    broken = log.create(cfg, triggered_by="scheduler")
    try:
        run_job(s, replace(cfg, output_format="excel"), log, spark, root, broken)
    except ValueError:
        runs[broken] = "broken"
    named = spark.createDataFrame(list(runs.items()), "run_id string, run string")
    states = log.events().groupBy("run_id").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("event_seq", "state"))), lambda e: e["state"])).alias("states")
    )
    pending = log.status(broken)[0] == runlog.FAILED
    return log.latest().join(states, "run_id").join(F.broadcast(named), "run_id").select(
        "run", "states", "state", "triggered_by", "date_range.start", "date_range.end", F.concat_ws(",", "companies").alias("companies"),
        "total_records", "critical_issues", "error", F.lit(pending).alias("status_found"),
        *[F.col(f"filters.{c}").alias(c) for c in schema.FILTER_COUNTS.fieldNames()],
    )


def _latest(s: DerivedSource) -> DataFrame:
    return runlog.latest_state(run_events(s), "run_id", ["ts", "event_id"], last=["state", "execution_seconds"])


@query
def run_log_latest(s):
    return _latest(s).withColumn("run_key", runlog.run_id_of(F.col("created_at")))


@query
def run_status(s):
    requested = s.read("customer").select(F.col("c_custkey").alias("run_id"))
    return runlog.run_status(requested, _latest(s), "run_id")


@query
def run_page(s):
    return runlog.run_page(_latest(s), "run_id", PAGE)
