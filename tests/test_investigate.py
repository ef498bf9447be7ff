"""Root-cause investigation on one hand-made part per class."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest
from conftest import usage_row

from tallymatch.catalog import CONFIG
from tallymatch.operators import investigate as inv
from tallymatch.plans import reconcile as run
from tallymatch.plans.investigation import Investigation
from tallymatch.sources import DerivedSource

P = date(2000, 8, 31)
RESULT = (
    "company string, location string, part_num string, period date, actual_usage double, forecast_usage double, "
    "variance_category string"
)


@pytest.fixture()
def found(make_source, spark, cfg):
    source = make_source(
        usage=[
            usage_row("NORTH_HQ_missing", P, 60.0),
            usage_row("NORTH_HQ_missing", date(1999, 8, 31), 5.0),
            usage_row("NORTH_HQ_missing", date(1999, 7, 31), 100.0),
            usage_row("NORTH_HQ_missing", date(2000, 11, 30), 1.0),
            usage_row("NORTH_HQ_sync", P, 9.0),
            usage_row("NORTH_HQ_close", P, 9.0),
            usage_row("NORTH_HQ_bad", P, 9.0),
            usage_row("NORTH_HQ_rare", P, 1.0),
            usage_row("NORTH_HQ_nometa", P, 1.0),
            usage_row("NORTH_HQ_nometa", P, None),
        ],
        forecast=[
            ("NORTH", "North HQ", "sync", date(2000, 1, 1), 4.0),
            ("NORTH", "Quarry", "close", date(2000, 8, 1), 7.0),
            ("NORTH", "North HQ", "close", date(2000, 8, 1), 8.0),
            ("NORTH", "North HQ", "ghost", date(2000, 8, 1), 3.0),
        ],
        part_master=[
            ("NORTH", p, "RAW" if p == "bad" else "PUR", False, None, "x")
            for p in ("missing", "sync", "close", "bad", "rare", "ghost")
        ],
        part_site=[
            ("NORTH", p, "HQ", False, i) for i, p in enumerate(["missing", "sync", "close", "bad", "rare", "ghost"])
        ],
    )
    result = spark.createDataFrame(
        [
            ("NORTH", "North HQ", "missing", P, 60.0, 0.0, cfg.labels.missing_forecast),
            ("NORTH", "North HQ", "missing", P, 60.0, 0.0, cfg.labels.missing_forecast),
            ("NORTH", "North HQ", "sync", P, 9.0, 0.0, cfg.labels.missing_forecast),
            ("NORTH", "North HQ", "close", P, 9.0, 8.0, cfg.labels.more_usage),
            ("NORTH", "North HQ", "bad", P, 9.0, 0.0, cfg.labels.missing_forecast),
            ("NORTH", "North HQ", "rare", P, 1.0, 0.0, cfg.labels.missing_forecast),
            ("NORTH", "North HQ", "nometa", P, 1.0, 0.0, cfg.labels.missing_forecast),
            ("NORTH", "North HQ", "ghost", P, 0.0, 3.0, cfg.labels.missing_usage),
            ("NORTH", "North HQ", "fine", P, 2.0, 2.0, cfg.labels.match),
            (None, "North HQ", None, P, 2.0, 0.0, cfg.labels.missing_forecast),
        ],
        RESULT,
    )
    return source, Investigation.of(source, result, cfg)


def test_history_has_a_lower_bound_only(found):
    history = {r.part_num: r for r in found[1].history.collect()}
    missing = history["missing"]
    # 31 August 1999 is on the edge and counts, so does the later month
    assert (missing.total_12mo, missing.active_periods, missing.mean_12mo) == (66.0, 3, 22.0)
    assert (missing.total_ever, missing.periods_ever) == (166.0, 4)
    assert (missing.first_usage, missing.last_usage) == (date(1999, 7, 31), date(2000, 11, 30))
    ghost = history["ghost"]
    assert (ghost.total_12mo, ghost.active_periods, ghost.mean_12mo, ghost.total_ever) == (0.0, 0, None, None)
    # two rows in one month, one without units: both are counted, the mean is over the known one
    assert (history["nometa"].active_periods, history["nometa"].mean_12mo) == (2, 1.0)


def test_flags_stay_unset_without_evidence(found):
    checked = {r.part_num: r for r in found[1].checked.collect()}
    assert (checked["missing"].any_failed, checked["missing"].fails_low_usage) == (False, False)
    assert (checked["bad"].fails_class, checked["bad"].any_failed) == (True, True)
    assert (checked["rare"].fails_low_usage, checked["rare"].any_failed) == (True, True)
    assert (checked["ghost"].fails_low_usage, checked["ghost"].any_failed) == (None, False)
    nometa = checked["nometa"]
    assert (nometa.fails_non_stock, nometa.fails_low_usage, nometa.any_failed) == (None, True, None)
    assert nometa.should_be_excluded is False


def test_root_causes(found):
    cases = found[1].root_cause().collect()
    assert len(cases) == 9
    causes = {r.part_num: r.root_cause for r in cases}
    assert causes == {
        "missing": "LEGITIMATE_MISSING_PART",
        "sync": "DATA_SYNC_ISSUE",
        "close": "FORECASTING_ACCURACY",
        "bad": "UNKNOWN",
        "rare": "UNKNOWN",
        "nometa": "LEGITIMATE_MISSING_PART",
        "ghost": "UNKNOWN",
        None: "LEGITIMATE_MISSING_PART",
    }
    off = {r.part_num: r.root_cause for r in found[1].root_cause(exclusions_on=False).collect()}
    assert (off["bad"], off["rare"]) == ("CONFIGURATION_ISSUE", "CONFIGURATION_ISSUE")


def test_priorities(found):
    ranked = {r.part_num: (r.priority, r.severity) for r in inv.root_cause_priority(found[1].root_cause()).collect()}
    assert ranked["missing"] == ("High", "Medium-High")
    assert ranked["nometa"] == ("Low", "Medium-High")
    assert ranked["sync"] == ("High", "High")
    assert ranked["close"] == ("Medium", "Low-Medium")
    assert ranked["bad"] == ("Medium", None)


def test_quick_patterns(found, cfg):
    rows = {r.part_num: r for r in inv.quick_patterns(found[1].root_cause(), cfg).collect()}
    assert rows["missing"].stocked_never_forecast and not rows["missing"].stopped_in_forecast
    assert rows["sync"].stopped_in_forecast
    assert rows["close"].forecast_variance
    assert not rows["ghost"].stopped_in_forecast


def test_verification(found, cfg):
    source, investigation = found
    checked = {
        r.part_num: r
        for r in inv.verify(investigation.cases, source.usage(), source.forecast(), cfg).collect()
        if r.part_num
    }
    assert checked["missing"].data_verified
    # the location is ignored: the first row by location is the one of the head office
    assert (checked["close"].found_forecast, checked["close"].data_verified) == (8.0, True)
    assert (checked["ghost"].found_actual, checked["ghost"].data_verified) == (0.0, True)


def test_lookups(found, cfg):
    source, _ = found
    assert [r.period for r in inv.part_forecast_lookup(source.forecast(), "sync").collect()] == [date(2000, 1, 1)]
    totals = inv.part_usage_lookup(source.usage(), "missing").collect()
    assert [r.total_usage for r in totals] == [1.0, 60.0, 5.0, 100.0]
    assert len(inv.part_usage_lookup(source.usage(), "HQ", newest=2).collect()) == 2
    card = inv.part_card_lookup(source.part_master(), "NORTH", "bad").first()
    assert (card.class_id, card.runout) == ("RAW", None)


def test_verification_reads_the_whole_tables(make_source, spark, cfg):
    """A run from mid-month on: the forecast of the first month starts before the run and still counts."""
    source = make_source(
        usage=[usage_row("NORTH_HQ_early", date(2000, 7, 31), 5.0)],
        forecast=[("NORTH", "North HQ", "early", date(2000, 7, 1), 4.0)],
    )
    late = replace(cfg, start=date(2000, 7, 15), apply_exclusions=False)
    cases = Investigation.of(source, run.reconcile(source, late, keep_plant=True), late).cases
    assert [(r.actual_usage, r.forecast_usage) for r in cases.collect()] == [(5.0, 0.0)]
    whole = inv.verify(cases, source.usage(), source.forecast(), late).first()
    cut = inv.verify(cases, source.usage(late.start, late.end), source.forecast(late.start, late.end), late).first()
    assert (whole.found_forecast, whole.data_verified) == (4.0, False)
    assert (cut.found_forecast, cut.data_verified) == (0.0, True)


def test_rows_with_usage_are_looked_up_at_their_own_plant(spark):
    source = DerivedSource(spark, "/root/testdata/sf0.001")
    found = Investigation.of(source, run.reconcile(source, CONFIG, keep_plant=True), CONFIG)
    checked = inv.verify(found.cases, source.usage(), source.forecast(), CONFIG)
    assert checked.where("actual_usage <> 0 and not actual_matches").count() == 0
    assert checked.where("plant = 'A2' and actual_usage <> 0").count() > 0


def test_chosen_rows_need_not_be_flagged(found, cfg, spark):
    source, _ = found
    result = spark.createDataFrame([("NORTH", "North HQ", "sync", P, 9.0, 9.0, cfg.labels.match)], RESULT)
    keys = spark.createDataFrame([("NORTH", "North HQ", p, P) for p in ("sync", "sync", "other")], result.schema[:4])
    chosen = Investigation.of(source, result, cfg, keys).root_cause().collect()
    assert [(r.part_num, r.variance_category) for r in chosen] == [("sync", cfg.labels.match)]


def test_doubled_metadata_fails_as_in_the_run(make_source, spark, cfg):
    source = make_source(
        usage=[usage_row("NORTH_HQ_p", P, 9.0)],
        part_master=[("NORTH", "p", "PUR", False, None, "x")] * 2,
        part_site=[("NORTH", "p", "HQ", False, 1)],
    )
    result = spark.createDataFrame([("NORTH", "North HQ", "p", P, 9.0, 0.0, cfg.labels.missing_forecast)], RESULT)
    with pytest.raises(Exception, match="duplicate part metadata"):
        Investigation.of(source, result, cfg).root_cause().collect()


def test_whole_tables_are_reduced_before_their_first_shuffle(found):
    plan = found[1].history._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    grouping = next(i for i, line in enumerate(lines) if "Aggregate" in line and "units" in line)
    assert any("LeftSemi" in line for line in lines[grouping:])
