"""Exclusion rules, metadata lookup and the frequency rule."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest
from conftest import usage_row
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallymatch.operators import metadata as md
from tallymatch.operators import normalize as nz
from tallymatch.plans import detail_view as view
from tallymatch.plans import reconcile as run

META = "company string, plant string, part_num string, class_id string, inactive boolean, runout boolean, " \
    "non_stock boolean, method_code {}"


def _meta(spark, rows, method="int"):
    return spark.createDataFrame(rows, META.format(method))


def test_each_criterion_excludes_alone(spark, cfg, rows):
    data = [
        ("NORTH", "HQ", "inactive", "PUR", True, False, False, 5),
        ("NORTH", "HQ", "runout", "PUR", False, True, False, 5),
        ("NORTH", "HQ", "non_stock", "PUR", False, False, True, 5),
        ("NORTH", "HQ", "raw", "RAW", False, False, False, 5),
        ("NORTH", "HQ", "method", "PUR", False, False, False, 3),
        ("NORTH", "HQ", "fine", "PUR", False, False, False, 4),
        ("NORTH", "HQ", "unknown", None, None, None, None, None),
        ("NORTH", "HQ", "null_and_true", None, None, True, None, None),
    ]
    found = {r[2] for r in rows(md.exclusion_keys(_meta(spark, data), cfg))}
    assert found == {"inactive", "runout", "non_stock", "raw", "method", "null_and_true"}


def test_method_codes_are_compared_as_stored(spark, cfg, rows):
    def excluded(kind, codes):
        data = [("NORTH", "HQ", str(c), "PUR", False, False, False, c) for c in codes]
        return {r[2] for r in rows(md.exclusion_keys(_meta(spark, data, kind), cfg))}

    assert excluded("double", [1.0, 2.5, 4.0]) == {"1.0"}
    assert excluded("string", ["1", "1.0", "x", "3"]) == {"1", "3"}


def test_enrichment_keeps_rows_and_leaves_unknown_keys_null(spark, rows):
    usage = spark.createDataFrame(
        [("NORTH", "HQ", "P"), ("NORTH", "HQ", "P"), ("NORTH", "HQ", "Q"), ("NORTH", None, None)],
        "company string, plant string, part_num string",
    )
    meta = _meta(spark, [("NORTH", "HQ", "P", "PUR", False, True, False, 7)])
    assert rows(md.enrich_metadata(usage, meta)) == sorted(
        [
            ("NORTH", "HQ", "P", False, 7, False, True),
            ("NORTH", "HQ", "P", False, 7, False, True),
            ("NORTH", "HQ", "Q", None, None, None, None),
            ("NORTH", None, None, None, None, None, None),
        ],
        key=repr,
    )


def test_duplicate_metadata_fails_instead_of_fanning_out(spark):
    usage = spark.createDataFrame([("NORTH", "HQ", "P")], "company string, plant string, part_num string")
    meta = _meta(spark, [("NORTH", "HQ", "P", "PUR", False, False, False, c) for c in (4, 5)])
    with pytest.raises(PySparkException, match="duplicate part metadata for NORTH/HQ/P"):
        md.enrich_metadata(usage, meta).collect()


def test_metadata_needs_plant_and_method_rows(make_source, cfg, rows):
    source = make_source(
        part_master=[(c, p, "PUR", False, False, "x") for c in ("NORTH", "WEST") for p in ("P", "Q", "R")],
        part_site=[("NORTH", "P", "HQ", False, 1), ("NORTH", "Q", "HQ", False, 2), ("WEST", "P", "HQ", False, 3)],
        part_site_ud=[(1, 5), (3, 5)],
    )
    assert rows(md.scan_part_metadata(source, cfg), "company", "part_num") == [("NORTH", "P")]


def _frequency_source(make_source):
    edge, before, after = date(1999, 12, 31), date(1999, 12, 30), date(2001, 1, 31)
    return make_source(
        usage=[
            usage_row("NORTH_B7_two", date(2000, 5, 31), counts=(1, 1, 0, 0)),
            usage_row("NORTH_B7_three", date(2000, 5, 31), counts=(1, 1, 0, 1)),
            usage_row("NORTH_B7_edges", edge, counts=(1, 0, None, 0)),
            usage_row("NORTH_B7_edges", date(2000, 12, 31), counts=(0, 2, 0, 0)),
            usage_row("NORTH_B7_edges", before, counts=(9, 9, 9, 9)),
            usage_row("NORTH_B7_edges", after, counts=(9, 9, 9, 9)),
            usage_row("NORTH_HQ_none", date(2000, 5, 31)),
            usage_row("NORTH", date(2000, 5, 31), counts=(5, 5, 5, 5)),
        ]
    )


def test_frequency_window_is_inclusive_on_both_ends(make_source, cfg):
    source = _frequency_source(make_source)
    full = replace(cfg, frequency_source="full_history")
    counts = {r.part_num: r.transaction_count_12mo for r in md.frequency_counts(md.frequency_usage(source, full), full).collect()}
    assert counts == {"two": 2, "three": 3, "edges": 3, "none": 0}
    # the default counts only the run's own months
    own = {r.part_num: r.transaction_count_12mo for r in md.frequency_counts(md.frequency_usage(source, cfg), cfg).collect()}
    assert own["edges"] == 2


def test_frequency_filter_exempts_head_office_only(make_source, cfg):
    source = _frequency_source(make_source)
    usage = nz.normalize_usage(nz.scan_usage(source, cfg), cfg)
    counts = md.frequency_counts(md.frequency_usage(source, cfg), cfg)
    assert {r.part_num for r in md.frequency_filter(usage, counts, cfg).collect()} == {"three", "none"}


def test_units_can_replace_transactions(make_source, cfg):
    units = replace(cfg, frequency_measure="units")
    source = make_source(usage=[usage_row("NORTH_B7_p", date(2000, 5, 31), 1.0, 2.0, 0.5, 9.0, counts=(7, 7, 7, 7))])
    assert md.frequency_counts(md.frequency_usage(source, units), units).first().transaction_count_12mo == 3.5


def test_key_facts_equal_the_single_operators(make_source, cfg, rows):
    source = make_source(
        usage=[
            usage_row(f"{c}_{p}_{n}", date(2000, m, 28), 1.0, 1.0, float(m), counts=(m % 3, 0, 1, 0))
            for c, p in (("NORTH", "HQ"), ("NORTH", "A1"), ("NORTH", "A2"), ("EAST", "HQ"), ("SOUTH", "S9"), ("WEST", "HQ"))
            for n in ("a", "b", "c")
            for m in (2, 5, 9)
        ]
        + [usage_row(k, date(2000, 3, 31), c=1.0) for k in ("NORTH_HQ", "NORTH", "", None)],
        forecast=[("NORTH", "Harbor", "a", date(2000, 5, 1), 5.0), (None, None, None, date(2000, 5, 1), 1.0)],
        part_master=[(c, n, "RAW" if n == "b" else "PUR", False, None, "x") for c in ("NORTH", "EAST") for n in "abc"],
        part_site=[
            ("NORTH", n, p, n == "c" and p == "A2", i)
            for i, (n, p) in enumerate([(n, p) for n in "abc" for p in ("HQ", "A1", "A2")])
        ],
        part_site_ud=[(i, i) for i in range(9)],
    )
    assert rows(run.reconcile(source, cfg)) == rows(run.reconcile_stepwise(source, cfg))
    impact = run.impact(source, cfg).first()
    usage = nz.normalize_usage(nz.scan_usage(source, cfg), cfg)
    kept = md.apply_exclusions(usage, md.scan_part_metadata(source, cfg), cfg)
    assert (impact.initial_rows, impact.rows_after_exclusion) == (usage.count(), kept.count())
    assert impact.initial_rows == impact.excluded_rows + impact.infrequent_rows + impact.remaining_rows


def test_exclusion_impact_of_nothing(make_source, cfg):
    row = run.impact(make_source(), cfg).first()
    assert (row.initial_rows, row.remaining_rows, row.excluded_percent) == (0, 0, 0.0)


def test_exclusion_reasons(make_source, cfg, rows):
    source = make_source(
        part_master=[
            ("NORTH", "a?", "RAW", True, True, "x"),
            ("NORTH", "ok", "PUR", False, None, "x"),
            ("WEST", "w?", "RAW", True, True, "x"),
        ],
        part_site=[("NORTH", "a?", "HQ", False, 1), ("NORTH", "ok", "HQ", None, 2), ("NORTH", "ghost", "HQ", True, 3)],
        part_site_ud=[(1, 2), (2, 4), (3, 1)],
        method_codes=[
            ("NORTH", "Methods", "1", "Exception"),
            ("NORTH", "Methods", "2.0", "Min/Max"),
            ("NORTH", "Methods", "N/A", "Exception"),
            ("NORTH", "Other", "4", "Exception"),
            ("NORTH", "Methods", "4", "Standard"),
        ],
        forecast=[("NORTH", "North HQ", "ok", date(2000, 12, 1), 1.0)],
        usage=[
            usage_row("NORTH_HQ_ghost", date(2000, 3, 31), 1.0, 1.0),
            usage_row("NORTH_HQ_ok", date(2000, 3, 31), 1.0, 1.0),
            usage_row("NORTH_B7_ok", date(2000, 3, 31), 1.0),
        ],
    )
    assert rows(view.reasons(source, cfg), "part_num", "list_no", "reason") == sorted(
        [
            ("a?", 1, "Min/Max"),
            ("ghost", 1, "Exception"),
            ("a?", 2, "InActive"),
            ("a?", 3, "ClassID: RAW"),
            ("a?", 4, "Data Quality Issue"),
            # low usage is counted over all plants and needs no part row
            ("ghost", 5, "Low Usage (≤2 units/12mo)"),
        ],
        key=repr,
    )


def test_low_usage_ignores_rows_before_the_look_back(make_source, cfg, rows):
    source = make_source(
        usage=[
            usage_row("NORTH_HQ_old", date(2000, 1, 31), 50.0),
            usage_row("NORTH_HQ_low", date(2000, 3, 31), 2.0),
            usage_row("NORTH_HQ_low", date(2000, 1, 31), 50.0),
            usage_row("NORTH_HQ_null", date(2000, 3, 31), None, 1.0, 1.0),
        ],
        forecast=[("NORTH", "North HQ", "x", date(2001, 3, 1), 1.0)],
    )
    low = md.low_usage_parts(view.parsed_usage(source, cfg), md.last_forecast_period(source), cfg)
    assert rows(low) == [("NORTH", "low", 2.0)]


def test_anti_join_never_adds_rows(spark, cfg):
    usage = spark.createDataFrame(
        [("NORTH", "HQ", p) for p in "aabbc"], "company string, plant string, part_num string"
    )
    reasons = usage.where(F.col("part_num") == "a").withColumn("reason", F.lit("x"))
    assert sorted(r.part_num for r in md.exclude_listed(usage, reasons).collect()) == ["b", "b", "c"]
