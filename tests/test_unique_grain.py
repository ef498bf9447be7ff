"""Runs over usage that holds a handful of rows per key: read and shuffled once, same rows as from the single operators."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest
from conftest import usage_row
from pyspark.errors import PySparkException

from tallymatch.catalog import CONFIG, NO_EXCLUSIONS
from tallymatch.operators import metadata as md
from tallymatch.plans import reconcile as run
from tallymatch.sources import DerivedSource

SAMPLE = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hand_made(make_source, unique_grain, more_sites=()):
    return make_source(
        unique_grain=unique_grain,
        usage=[
            usage_row(f"{c}_{p}_{n}", date(2000, m, 28), 1.0, None if n == "b" else 1.0, float(m), counts=(m % 3, 0, None, 0))
            for c, p in (("NORTH", "HQ"), ("NORTH", "A1"), ("NORTH", "A2"), ("SOUTH", "S9"), ("WEST", "HQ"))
            for n in ("a", "b", "c_?")
            for m in (2, 5, 9, 11)
        ]
        + [usage_row(k, date(2000, 11, 30), c=1.0, counts=(9, 9, 9, 9)) for k in ("NORTH_HQ", "NORTH", "", None, "_A1_a", "NORTH__a")],
        forecast=[("NORTH", "Harbor", "a", date(2000, 5, 1), 5.0), (None, None, None, date(2000, 5, 1), 1.0)],
        part_master=[("NORTH", n, "RAW" if n == "b" else "PUR", False, None, "x") for n in ("a", "b", "c_?")]
        + [(None, "a", "RAW", True, True, "x"), ("NORTH", None, "RAW", True, True, "x")],
        part_site=[
            ("NORTH", n, p, n == "c_?" and p == "A2", i)
            for i, (n, p) in enumerate([(n, p) for n in ("a", "b", "c_?") for p in ("HQ", "A1", "A2", "")])
        ]
        + [("NORTH", "a", None, True, 12), *more_sites],
        part_site_ud=[(i, i) for i in range(20)],
    )


@pytest.mark.parametrize("lookback", [1, 2, 12])
@pytest.mark.parametrize("measure", ["transactions", "units"])
def test_the_run_equals_the_single_operators(make_source, cfg, rows, lookback, measure):
    cfg = replace(cfg, lookback_months=lookback, frequency_measure=measure)
    source = hand_made(make_source, True)
    found = rows(run.reconcile(source, cfg))
    assert found and found == rows(run.reconcile_stepwise(source, cfg)) == rows(run.reconcile(hand_made(make_source, False), cfg))
    plain = replace(cfg, apply_exclusions=False)
    assert rows(run.reconcile(source, plain)) == rows(run.reconcile(hand_made(make_source, False), plain))


@pytest.mark.parametrize("exclusions", [True, False])
def test_a_duplicate_fails_though_no_usage_looks_it_up(make_source, cfg, exclusions):
    twice = [("NORTH", "b", "unused", False, i) for i in (13, 14)]
    with pytest.raises(PySparkException, match="duplicate part metadata for NORTH/unused/b"):
        run.reconcile(hand_made(make_source, True, twice), replace(cfg, apply_exclusions=exclusions)).collect()


def test_usage_is_read_once(spark):
    plan = physical(run.reconcile(DerivedSource(spark, SAMPLE), CONFIG))
    # usage and forecast; the look-back count is taken from the run's own usage
    assert plan.count("FileScan parquet [l_partkey") == 2


def test_metadata_is_grouped_where_it_was_joined(spark, cfg):
    source = DerivedSource(spark, SAMPLE)
    # both sides of the join by part, nothing for the grouping
    plan = physical(md.unique_metadata(md.scan_part_metadata(source, cfg), md.METADATA_FLAGS))
    assert plan.count("Exchange hashpartitioning(part_num") == 2
    assert "coalesce(part_num" not in physical(run.prepared_usage(source, NO_EXCLUSIONS))


def test_part_rows_are_dealt_out_before_they_are_multiplied(spark):
    source = DerivedSource(spark, SAMPLE)
    for table in (source.part_master(), source.part_site(), source.part_site_ud()):
        plan = physical(table)
        assert plan.index("Generate") < plan.index("Exchange hashpartitioning(p") < plan.index("FileScan")
