"""Key parsing, mapping, usage rule, variance measures and calendar on hand-made edge rows."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallymatch.config import CategoryLabels
from tallymatch.functions import calendar as cal
from tallymatch.functions.variance import amount_or_zero, category_flags, variance_category, variance_percent
from tallymatch.operators import normalize as nz

KEYS = ["A_B_C_D", "A_B", "A", "", None, "A__C"]


def test_parse_key_keeps_underscores_and_leaves_missing_pieces_null(spark, rows):
    df = nz.parse_key(spark.createDataFrame([(k,) for k in KEYS], "site_part_key string"))
    assert rows(df) == sorted(
        [
            ("A_B_C_D", "A", "B", "C_D"),
            ("A_B", "A", "B", None),
            ("A", "A", None, None),
            ("", "", None, None),
            (None, None, None, None),
            ("A__C", "A", "", "C"),
        ],
        key=repr,
    )


def test_parse_key_view_fills_missing_pieces(spark, rows):
    df = nz.parse_key_view(spark.createDataFrame([(k,) for k in KEYS], "site_part_key string"))
    assert rows(df) == sorted(
        [
            ("A_B_C_D", "A", "B", "C_D"),
            ("A_B", "A", "B", ""),
            ("A", "A", "A", ""),
            ("", "", "", ""),
            (None, None, None, None),
            ("A__C", "A", "", "C"),
        ],
        key=repr,
    )


SITES = [("NORTH", "A1"), ("NORTH", "A2"), ("NORTH", "ZZ"), ("MARS", "HQ"), ("NORTH", None), (None, None)]


def test_map_location_names_the_unmapped_pair(spark, cfg, rows):
    df = nz.map_location(spark.createDataFrame(SITES, "company string, plant string"), cfg)
    assert rows(df, "location") == sorted(
        [
            ("Harbor",),
            ("Harbor",),
            ("UNMAPPED_LOCATION_NORTH_ZZ",),
            ("UNMAPPED_LOCATION_MARS_HQ",),
            ("UNMAPPED_LOCATION_NORTH_None",),
            ("UNMAPPED_LOCATION_None_None",),
        ]
    )


def test_map_location_view_falls_through_to_the_company(spark, cfg):
    df = nz.map_location_view(spark.createDataFrame(SITES, "company string, plant string"), cfg)
    found = {(r.company, r.plant): r.location for r in df.collect()}
    assert found[("NORTH", "A2")] == "Harbor"
    assert found[("NORTH", "ZZ")] == "North HQ"
    assert found[("NORTH", None)] == "North HQ"
    assert found[("MARS", "HQ")] == "UNMAPPED_LOCATION"
    assert found[(None, None)] == "UNMAPPED_LOCATION"


def test_reverse_map_takes_the_first_plant_and_defaults_to_head_office(spark, cfg):
    pairs = [("NORTH", "Harbor"), ("NORTH", "Atlantis"), ("SOUTH", "South"), (None, None)]
    df = nz.reverse_map_site(spark.createDataFrame(pairs, "company string, location string"), cfg)
    assert [r.plant for r in df.collect()] == ["A1", "HQ", "HQ", "HQ"]


def test_usage_rule(spark, cfg):
    data = [
        ("NORTH", "HQ", 1.0, 2.0, 4.0),
        ("NORTH", "HQ", 1.0, None, 4.0),
        ("NORTH", "B7", 1.0, 2.0, 4.0),
        ("SOUTH", "HQ", 1.0, 2.0, None),
        (None, None, 1.0, 2.0, 4.0),
    ]
    df = spark.createDataFrame(data, "company string, plant string, qty_a double, qty_b double, qty_c double")
    assert [r.actual_usage for r in nz.usage_rule(df, cfg).collect()] == [7.0, None, 4.0, None, 4.0]
    # a component the table does not have counts as zero
    assert [r.actual_usage for r in nz.usage_rule(df.drop("qty_b"), cfg).collect()][0] == 5.0


def test_filter_companies_keeps_null_only_in_the_run_profile(spark, cfg, rows):
    df = spark.createDataFrame([("NORTH",), ("WEST",), (None,)], "company string")
    assert rows(nz.filter_companies(df, cfg)) == [("NORTH",), (None,)]
    assert rows(nz.filter_companies(df, cfg, keep_null=False)) == [("NORTH",)]
    assert nz.filter_companies(df, replace(cfg, excluded_companies=())).count() == 3


def test_normalized_keys_are_optional(spark, cfg, rows):
    df = spark.createDataFrame([("north ", "p_1")], "company string, part_num string")
    assert rows(nz.normalize_key_text(df, ["company", "part_num"], cfg)) == [("north ", "p_1")]
    on = replace(cfg, normalize_keys=True)
    assert rows(nz.normalize_key_text(df, ["company", "part_num"], on)) == [("NORTH", "P_1")]


def test_month_end(spark):
    days = [datetime(2024, 2, 10), datetime(2025, 2, 28), datetime(2025, 12, 31), datetime(2025, 5, 10, 13)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp").select(cal.month_end(F.col("t")).alias("p"))
    assert [r.p for r in df.collect()] == [
        date(2024, 2, 29),
        date(2025, 2, 28),
        date(2025, 12, 31),
        date(2025, 5, 31),
    ]


NAN, INF = float("nan"), float("inf")


def test_variance_percent(spark):
    data = [(0.0, 0.0), (0.0, 5.0), (5.0, 0.0), (8.0, 7.0), (-4.0, 4.0), (None, 3.0), (NAN, 3.0), (3.0, NAN)]
    df = spark.createDataFrame(data, "a double, f double").select(
        variance_percent(amount_or_zero(F.col("a")), amount_or_zero(F.col("f"))).alias("p")
    )
    assert [r.p for r in df.collect()] == [0.0, 999.99, -999.99, 12.5, -200.0, 999.99, 999.99, -999.99]


def test_variance_category(spark):
    data = [(2.0, 2.0), (0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 2.0), (2.0, 1.0), (INF, INF)]
    for labels in (CategoryLabels(), CategoryLabels.snake()):
        df = spark.createDataFrame(data, "a double, f double").select(
            variance_category(F.col("a"), F.col("f"), labels).alias("c")
        )
        assert [r.c for r in df.collect()] == [
            labels.match,
            labels.match,
            labels.missing_usage,
            labels.missing_forecast,
            labels.more_forecast,
            labels.more_usage,
            "ERROR",
        ]


def test_category_flags(spark):
    labels = CategoryLabels()
    names = [labels.match, labels.missing_usage, labels.missing_forecast, labels.more_usage, "ERROR"]
    df = spark.createDataFrame([(n,) for n in names], "c string").select(*category_flags(F.col("c"), labels))
    assert [tuple(r) for r in df.collect()] == [(0, 1, 0), (1, 0, 1), (1, 0, 1), (0, 0, 1), (0, 0, 0)]


def test_amounts_as_decimal(spark):
    df = spark.createDataFrame([(1.25,), (None,), (NAN,)], "a double").select(
        amount_or_zero(F.col("a"), "decimal(18,4)").alias("v")
    )
    assert [str(r.v) for r in df.collect()] == ["1.2500", "0.0000", "0.0000"]


@pytest.mark.parametrize(
    ("as_of", "period", "expected"),
    [
        (date(2025, 3, 31), date(2025, 2, 28), {"is_previous_month": 1, "is_current_quarter": 1}),
        (date(2025, 1, 15), date(2024, 12, 31), {"is_previous_quarter": 1, "is_current_year": 0}),
        (date(2025, 2, 28), date(2025, 1, 31), {"months_from_current": 1, "quarters_from_current": 0}),
        (date(2025, 2, 10), date(2025, 2, 28), {"is_current_month": 1, "is_month_complete": 0}),
        (date(2025, 4, 1), date(2024, 2, 29), {"days_in_month": 29, "quarters_from_current": 5}),
    ],
)
def test_relative_dates(spark, as_of, period, expected):
    p, a = F.lit(period), cal.as_of_date(as_of)
    row = (
        spark.range(1)
        .select(*cal.relative_dates(p, a), *cal.completeness(p, a, F.lit(date(2020, 1, 31))))
        .first()
        .asDict()
    )
    assert {k: row[k] for k in expected} == expected


def test_calendar_text(spark):
    p = F.lit(date(2025, 9, 30))
    row = spark.range(1).select(*cal.calendar_parts(p), *cal.period_keys(p)).first()
    assert tuple(row) == (2025, 9, 3, 30, "September", "Sep", "202509", "2025-09", "2025Q3")
