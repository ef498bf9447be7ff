"""Reports: median, breakdowns, cube, crosstab, slicers."""

from __future__ import annotations

import random
import statistics
from datetime import date

import pytest

from tallymatch.config import CategoryLabels
from tallymatch.operators import report
from tallymatch.operators.quantile import exact_median, value_counts

LABELS = CategoryLabels()


def _median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return exact_median(value_counts(df, "x")).first().median


@pytest.mark.parametrize(
    "values",
    [
        [],
        [3.0],
        [1.0, 2.0],
        [0.0, 0.0, 0.0, 5.0],
        [0.0, 0.0, 7.0, 7.0],
        [5.0, 5.0 + 1e-9, 5.0 + 2e-9],
        [1.0, 1.0000000000000002, 1.0000000000000004, 1.0000000000000007],
        [1e-300, 1.0, 1e300, float("inf")],
        [None, float("nan"), 2.0, 4.0],
    ],
)
def test_exact_median_edges(spark, values):
    known = [v for v in values if v is not None and v == v]
    assert _median(spark, values) == (statistics.median(known) if known else None)


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_median_random(spark, seed):
    rng = random.Random(seed)
    values = [round(abs(rng.lognormvariate(0, 4)), 3) for _ in range(400 + seed)] + [0.0] * rng.randrange(300)
    assert _median(spark, values) == pytest.approx(statistics.median(values), abs=0)


RESULT = "period date, company string, location string, variance_category string, absolute_variance double"


def _result(spark, n=60):
    rng = random.Random(7)
    rows = [
        (
            date(2000, rng.choice([1, 2, 3]), 28),
            rng.choice(["N", "S", None]),
            rng.choice(["L1", "L2", "L3"]),
            rng.choice([*LABELS.stacking_order, "ERROR"]),
            float(rng.randrange(9)),
        )
        for _ in range(n)
    ]
    return rows, spark.createDataFrame(rows, RESULT)


def test_breakdowns_add_up(spark):
    rows, df = _result(spark)
    found = report.breakdowns(report.result_cube(df)).collect()
    by_dimension = {}
    for r in found:
        by_dimension.setdefault(r.dimension, []).append(r)
    assert [r.n_rows for r in by_dimension["total"]] == [len(rows)]
    assert sum(r.n_rows for r in by_dimension["category"]) == len(rows)
    assert sum(r.n_rows for r in by_dimension["location"]) == len(rows)
    assert sum(r.n_rows for r in by_dimension["company"]) == sum(r[1] is not None for r in rows)
    for r in by_dimension["location_category"]:
        matching = [x for x in rows if x[2] == r.location]
        assert r.group_total == len(matching)
        assert r.n_rows == sum(x[3] == r.variance_category for x in matching)
    for r in by_dimension["company_category"]:
        assert r.group_total == sum(x[1] == r.company for x in rows)
    counts = [r.n_rows for r in by_dimension["category"]]
    assert counts == sorted(counts, reverse=True)


def test_summary_of_rows_and_of_nothing(spark):
    rows, df = _result(spark)
    row = report.summary_counts(report.result_cube(df), LABELS).first()
    assert row.total_records == len(rows)
    assert row.perfect_matches + row.total_variances == len(rows)
    assert row.critical_issues == sum(r[3] in LABELS.critical for r in rows)
    empty = report.result_cube(df.limit(0))
    assert tuple(report.summary_counts(empty, LABELS).first()) == (0, 0, 0, 0, 0.0)
    assert report.breakdowns(empty).count() == 0
    assert report.period_range(empty).first().n_months == 0
    assert tuple(report.variance_stats(df.limit(0)).first()) == (None, None, None, None)


def test_variance_stats(spark):
    rows, df = _result(spark)
    values = [r[4] for r in rows]
    expected = (round(statistics.mean(values), 2), statistics.median(values), max(values), sum(values))
    assert tuple(report.variance_stats(df).first()) == expected
    sketched = report.variance_stats(df, exact=False).first()
    assert sketched.max_variance == max(values) and sketched.median_variance in values


def test_crosstab_fills_zeros_and_counts_further_categories_as_other(spark):
    chart = spark.createDataFrame(
        [("2000-01", "L", LABELS.match, 3), ("2000-02", "L", "ERROR", 5)],
        "month string, location string, variance_category string, count long",
    )
    table = report.crosstab(chart, LABELS)
    assert table.columns == ["month", *LABELS.stacking_order, "other"]
    assert [tuple(r) for r in table.collect()] == [("2000-01", 3, 0, 0, 0, 0, 0), ("2000-02", 0, 0, 0, 0, 0, 5)]
    shares = {r.variance_category: r for r in report.segment_share(chart, LABELS).where("month = '2000-02'").collect()}
    assert (shares["other"].stack_position, shares["other"].share_percent) == (5, 100.0)
    # the axis is scaled on everything that was counted
    assert report.stack_max(chart).first().axis_max == 6


CHART = [
    ("2000-01", "L1", LABELS.match, 97),
    ("2000-01", "L1", LABELS.more_usage, 3),
    ("2000-02", "L2", LABELS.match, 98),
    ("2000-02", "L2", LABELS.more_usage, 2),
    ("2001-01", "L2", LABELS.match, 10),
]


def _chart(spark):
    return spark.createDataFrame(CHART, "month string, location string, variance_category string, count long")


def test_segments_get_a_label_from_three_percent(spark):
    found = {(r.month, r.variance_category): r for r in report.segment_share(_chart(spark), LABELS).collect()}
    assert found[("2000-01", LABELS.more_usage)].label == "3.0%"
    assert found[("2000-02", LABELS.more_usage)].label is None
    assert found[("2001-01", LABELS.match)].label == "100.0%"
    assert found[("2000-01", LABELS.more_usage)].stack_position == 2


def test_slicers(spark):
    chart = _chart(spark)

    def left(**picks):
        return sorted({r.month for r in report.slice_cube(chart, **picks).collect()})

    assert left() == ["2000-01", "2000-02", "2001-01"]
    assert left(locations=["L2"]) == ["2000-02", "2001-01"]
    assert left(years=["2000"], months=["01"]) == ["2000-01"]
    assert left(first_day="2000-02-01", last_day="2000-12-31") == ["2000-02"]
    assert left(last_day="2000-01-31") == ["2000-01"]


def test_slicer_values_and_json(spark):
    rows, df = _result(spark)
    cube = report.result_cube(df)
    offered = [tuple(r) for r in report.slicer_values(cube).collect()]
    assert offered == sorted({("company", "N"), ("company", "S"), ("year", "2000")} | {("location", r[2]) for r in rows})
    record = report.chart_json(_chart(spark).limit(1)).first().record
    assert record == '{"month":"2000-01","location":"L1","variance_category":"Perfect Match","count":97}'


def test_rows_without_location_are_not_charted(spark):
    df = spark.createDataFrame(
        [(date(2000, 1, 31), "N", None, LABELS.match, 0.0), (date(2000, 1, 31), "N", "L", LABELS.match, 0.0)], RESULT
    )
    assert report.chart_cube(report.result_cube(df)).count() == 1
