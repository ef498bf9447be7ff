"""Reports on a finished reconciliation: cube, breakdowns, crosstab, magnitudes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymatch.config import CategoryLabels
from tallymatch.operators.quantile import exact_median, value_counts
from tallymatch.sinks import written


OTHER = "other"


def result_cube(result: DataFrame) -> DataFrame:
    """Row counts by period, company, location and category.

    The reports below read this instead of the result: one pass with partial aggregation, and a size that depends on
    months and sites, not on rows.
    """
    return result.groupBy("period", "company", "location", "variance_category").agg(F.count("*").alias("n_rows"))


def month_key(period: Column) -> Column:
    return F.date_format(period, "yyyy-MM")


def chart_cube(cube: DataFrame) -> DataFrame:
    """Counts by month, location and category; rows without a location or month are not charted."""
    month = month_key(F.col("period")).alias("month")
    return (
        cube.dropna(subset=["period", "location"])
        .groupBy(month, "location", "variance_category")
        .agg(F.sum("n_rows").alias("count"))
    )


def chart_json(chart: DataFrame) -> DataFrame:
    """One JSON object per cube row, keys in the order the chart expects."""
    record = F.struct("month", "location", "variance_category", "count")
    return chart.select(F.to_json(record).alias("record"))


def breakdowns(cube: DataFrame) -> DataFrame:
    """Counts and shares by category, company and location, by category within each, and the total.

    One grouping-sets pass over the cube. Shares inside a company or location refer to that group, others to all rows.
    Rows come by descending count, ties by label.
    """
    sets = [
        ["variance_category"],
        ["company"],
        ["location"],
        ["company", "variance_category"],
        ["location", "variance_category"],
        [],
    ]
    grouped = cube.groupingSets(
        [[F.col(c) for c in s] for s in sets],
        F.col("company"),
        F.col("location"),
        F.col("variance_category"),
    ).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.grouping(c).alias(f"no_{c}") for c in ("company", "location", "variance_category")],
    )
    by_company, by_location = F.col("no_company") == 0, F.col("no_location") == 0
    by_category = F.col("no_variance_category") == 0
    dimension = (
        F.when(by_company & by_category, "company_category")
        .when(by_location & by_category, "location_category")
        .when(by_company, "company")
        .when(by_location, "location")
        .when(by_category, "category")
        .otherwise("total")
    )
    labelled = grouped.select(dimension.alias("dimension"), "company", "location", "variance_category", "n_rows")
    # an unknown company or location is counted in the total but is no group of its own
    labelled = labelled.where(
        ~(F.col("dimension").startswith("company") & F.col("company").isNull())
        & ~(F.col("dimension").startswith("location") & F.col("location").isNull())
    ).where(F.col("n_rows").isNotNull())
    nested = F.col("dimension").isin("company_category", "location_category")
    # the nested groups hold one row per category
    within = F.sum("n_rows").over(W.partitionBy("dimension", "company", "location"))
    # the grouping sets hold the total already; what this window gathers is one row per group of the report
    all_rows = F.max(F.when(F.col("dimension") == "total", F.col("n_rows"))).over(W.partitionBy())
    return (
        labelled.withColumn("group_total", F.when(nested, within).otherwise(all_rows))
        .withColumn("share_percent", F.round(F.col("n_rows") * 100.0 / F.col("group_total"), 2))
        .orderBy("dimension", "company", "location", F.desc("n_rows"), "variance_category")
    )


def summary_counts(cube: DataFrame, labels: CategoryLabels) -> DataFrame:
    category, n = F.col("variance_category"), F.col("n_rows")

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    counts = cube.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_records"),
        rows(category != labels.match).alias("total_variances"),
        rows(category == labels.match).alias("perfect_matches"),
        rows(category.isin(labels.critical)).alias("critical_issues"),
    )
    share = F.round(F.col("total_variances") * 100.0 / F.col("total_records"), 2)
    return counts.withColumn("variance_share_percent", F.when(F.col("total_records") > 0, share).otherwise(0.0))


def variance_stats(result: DataFrame, exact: bool = True) -> DataFrame:
    """Mean, median, maximum and sum of the absolute variance, each rounded to two decimals.

    All of them are taken from one count per value, which is written first, so the result is read once. The median works
    on doubles: of decimals beyond 2**53 neighbouring values can't be told apart. ``exact=False`` replaces the exact
    median by a sketch over the rows, which saves the steps that locate the middle.
    """
    if not exact:
        value = F.when(~F.isnan(F.col("absolute_variance").cast("double")), F.col("absolute_variance"))
        return result.agg(
            F.round(F.avg(value), 2).alias("mean_variance"),
            F.round(F.percentile_approx(value, 0.5, 10_000), 2).alias("median_variance"),
            F.round(F.max(value), 2).alias("max_variance"),
            F.round(F.sum(value), 2).alias("total_variance"),
        )
    counted = written(value_counts(result, "absolute_variance"))
    return counted.agg(
        F.sum(F.col("v") * F.col("n")).alias("total"), F.sum("n").alias("n_rows"), F.max("v").alias("largest")
    ).select(
        F.when(F.col("n_rows") > 0, F.round((F.col("total") / F.col("n_rows")).cast("double"), 2)).alias(
            "mean_variance"
        ),
        F.round(exact_median(counted).scalar(), 2).alias("median_variance"),
        F.round("largest", 2).alias("max_variance"),
        F.round("total", 2).alias("total_variance"),
    )


def period_range(cube: DataFrame) -> DataFrame:
    return cube.agg(
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.count_distinct("period").alias("n_months"),
    )


def slicer_values(cube: DataFrame) -> DataFrame:
    """Values the slicers offer: distinct locations, companies and years, in one distinct pass."""
    offered = F.array(
        F.struct(F.lit("company").alias("slicer"), F.col("company").alias("value")),
        F.struct(F.lit("location").alias("slicer"), F.col("location").alias("value")),
        F.struct(F.lit("year").alias("slicer"), F.substring(month_key(F.col("period")), 1, 4).alias("value")),
    )
    return cube.select(F.inline(offered)).where(F.col("value").isNotNull()).distinct().orderBy("slicer", "value")


def slice_cube(
    chart: DataFrame,
    locations: Sequence[str] = (),
    years: Sequence[str] = (),
    months: Sequence[str] = (),
    first_day: str | None = None,
    last_day: str | None = None,
) -> DataFrame:
    """Rows of the chart cube that pass the slicers; an empty selection keeps everything.

    ``first_day`` / ``last_day`` are compared with the first of the month, as text.
    """
    month = F.col("month")
    picks = [
        (F.col("location"), locations),
        (F.substring(month, 1, 4), years),
        (F.substring(month, 6, 2), months),
    ]
    for column, selected in picks:
        if selected:
            chart = chart.where(column.isin(*selected))
    month_start = F.concat(month, F.lit("-01"))
    if first_day:
        chart = chart.where(month_start >= first_day)
    if last_day:
        chart = chart.where(month_start <= last_day)
    return chart


def month_category_totals(chart: DataFrame) -> DataFrame:
    return chart.groupBy("month", "variance_category").agg(F.sum("count").alias("count"))


def crosstab(chart: DataFrame, labels: CategoryLabels) -> DataFrame:
    """Month by category, zero-filled, columns in stacking order. Rows of any further category are counted as ``other``, so
    that a month's row adds up to its total."""
    order = labels.stacking_order
    shown = F.when(F.col("variance_category").isin(order), F.col("variance_category")).otherwise(OTHER)
    named = chart.withColumn("variance_category", shown)
    return named.groupBy("month").pivot("variance_category", [*order, OTHER]).agg(F.sum("count")).na.fill(0).orderBy("month")


def stack_max(chart: DataFrame) -> DataFrame:
    """Upper end of the chart axis: the largest month total plus 10 %, rounded up."""
    by_month = chart.groupBy("month").agg(F.sum("count").alias("month_total"))
    return by_month.agg(F.ceil(F.max("month_total") * F.lit(1.1)).alias("axis_max"))


def segment_share(chart: DataFrame, labels: CategoryLabels, label_from: float = 3.0) -> DataFrame:
    """Share of each category in its month; segments below ``label_from`` percent get no label. Further categories make
    one segment, ``other``, on top."""
    known = F.when(F.col("variance_category").isin(labels.stacking_order), F.col("variance_category")).otherwise(OTHER)
    shown = month_category_totals(chart.withColumn("variance_category", known))
    # a month holds one row per category here
    month_total = F.sum("count").over(W.partitionBy("month"))
    percent = F.when(F.col("month_total") > 0, F.col("count") / F.col("month_total") * 100).otherwise(0.0)
    label = F.format_string("%.1f%%", F.round("percent", 1))
    rank = F.coalesce(*[F.when(F.col("variance_category") == c, i) for i, c in enumerate([*labels.stacking_order, OTHER])])
    return shown.select("*", month_total.alias("month_total"), rank.alias("stack_position")).withColumn(
        "percent", percent
    ).select(
        "month",
        "variance_category",
        "stack_position",
        "count",
        "month_total",
        F.round("percent", 2).alias("share_percent"),
        F.when(F.col("percent") >= label_from, label).alias("label"),
    )
