"""The full outer comparison: null keys, duplicate keys, hot keys, empty sides."""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallymatch.catalog import QUERIES
from tallymatch.operators import compare as cmp
from tallymatch.operators.hotkeys import HotKeyConfig, heavy_keys
from tallymatch.operators.lookup import lookup
from tallymatch.schema import COMPARE_KEY

JAN = date(2000, 1, 31)
U = "company string, location string, part_num string, period date, plant string, actual_usage double"
F_ = "company string, location string, part_num string, period date, forecast_usage double"


def _sides(spark, usage, forecast):
    return spark.createDataFrame(usage, U), spark.createDataFrame(forecast, F_)


USAGE = [
    ("N", "L", "one", JAN, "HQ", 1.0),
    ("N", "L", "both", JAN, "HQ", 2.0),
    ("N", "L", "dup", JAN, "A1", 3.0),
    ("N", "L", "dup", JAN, "A2", 4.0),
    ("N", "L", None, JAN, "HQ", 5.0),
    (None, "L", "x", None, "HQ", 6.0),
]
FORECAST = [
    ("N", "L", "two", JAN, 1.0),
    ("N", "L", "both", JAN, 2.0),
    ("N", "L", "dup", JAN, 4.0),
    ("N", "L", None, JAN, 5.0),
]


def _brute(usage, forecast, null_safe):
    def matches(a, b):
        return all((x == y) if null_safe else (x is not None and x == y) for x, y in zip(a, b))

    out, seen = [], set()
    for u in usage:
        hits = [i for i, f in enumerate(forecast) if matches(u[:4], f[:4])]
        seen |= set(hits)
        out += [(*u[:4], u[5], forecast[i][4]) for i in hits] or [(*u[:4], u[5], None)]
    out += [(*f[:4], None, f[4]) for i, f in enumerate(forecast) if i not in seen]
    return Counter(out)


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("unique_grain", [True, False])
def test_full_outer_matches_brute_force(spark, null_safe, unique_grain):
    usage, forecast = _sides(spark, USAGE, FORECAST)
    joined = cmp.full_outer(usage.drop("plant"), forecast, COMPARE_KEY, null_safe, unique_grain)
    columns = ["company", "location", "part_num", "period", "actual_usage", "forecast_usage"]
    found = Counter(tuple(r) for r in joined.select(*columns).collect())
    assert found == _brute(USAGE, FORECAST, null_safe)


@pytest.mark.parametrize("unique_grain", [True, False])
def test_empty_sides(spark, cfg, unique_grain):
    for usage, forecast, n in (([], FORECAST, 4), (USAGE, [], 6), ([], [], 0)):
        result = cmp.compare(*_sides(spark, usage, forecast), cfg, unique_grain)
        assert result.count() == n


def test_measures(spark, cfg):
    result = cmp.categorize(cmp.compare(*_sides(spark, USAGE, FORECAST), cfg), cfg.labels)
    for r in result.collect():
        assert r.variance == r.forecast_usage - r.actual_usage
        assert r.absolute_variance == abs(r.variance)
    assert Counter(r.variance_category for r in result.collect()) == {
        "Perfect Match": 3,
        "Missing From Forecast": 2,
        "Missing From Usage": 1,
        "More In Forecast": 1,
    }


def test_pre_aggregation_matches_a_forecast_row_once(spark, cfg):
    once = replace(cfg, pre_aggregate=True)
    result = cmp.compare(*_sides(spark, USAGE, FORECAST), once).where("part_num = 'dup'").collect()
    assert [(r.actual_usage, r.forecast_usage) for r in result] == [(7.0, 4.0)]


def test_presence(spark, cfg):
    joined = cmp.join_sides(*_sides(spark, USAGE, FORECAST), cfg, unique_grain=False)
    found = {r.presence: (r.n_rows, r.positive_rows) for r in cmp.match_presence(joined).collect()}
    assert found == {"both": (4, 4), "usage_only": (2, 0), "forecast_only": (1, 0)}


def test_decimal_amounts(spark, cfg):
    decimal = replace(cfg, amount_type="decimal(18,4)")
    result = cmp.categorize(cmp.compare(*_sides(spark, USAGE, FORECAST), decimal), cfg.labels)
    assert result.schema["variance"].dataType.simpleString().startswith("decimal")
    assert result.where("part_num = 'both'").first().variance_category == "Perfect Match"


def test_view_rows_repeat_per_reason(spark, cfg):
    usage, forecast = _sides(spark, USAGE[:2], FORECAST)
    for c in ("qty_a", "qty_b", "qty_c", "qty_d", "cnt_a", "cnt_b", "cnt_c", "cnt_d"):
        usage = usage.withColumn(c, usage.actual_usage)
    forecast = forecast.selectExpr("*", "period as original_period", "'HQ' as plant")
    reasons = spark.createDataFrame(
        [("N", "HQ", "two", 1, "r1"), ("N", "HQ", "two", 2, "r2")],
        "company string, plant string, part_num string, list_no int, reason string",
    )
    parts = spark.createDataFrame([("N", "two", "code")], "company string, part_num string, prod_code string")
    found = Counter(
        (r.part_num, r.exclusion_reason, r.prod_code)
        for r in cmp.compare_view(usage, forecast, reasons, parts, cfg).collect()
    )
    assert found == {
        ("one", "Not_Excluded", None): 1,
        ("both", "Not_Excluded", None): 1,
        ("two", "r1", "code"): 1,
        ("two", "r2", "code"): 1,
        ("dup", "Not_Excluded", None): 1,
        (None, "Not_Excluded", None): 1,
    }


@pytest.fixture()
def tight_skew(spark):
    """Thresholds so low that a small sample counts as skewed, and no broadcast."""
    tight = {
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in tight}
    for k, v in tight.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture()
def hot(spark, tmp_path):
    """A third of the usage rows have a malformed key, so they share one compare key."""
    usage = spark.range(200_000).selectExpr(
        "'NORTH' as company",
        "'UNMAPPED_LOCATION_NORTH_None' as location",
        "if(id % 3 = 0, null, concat('P_', id)) as part_num",
        "date'2000-01-31' as period",
        "cast(id as double) as actual_usage",
    )
    some = usage.where("part_num is null").limit(2)
    some = some.unionByName(usage.where("part_num is not null and actual_usage % 5 = 1"))
    forecast = some.selectExpr("company", "location", "part_num", "period", "1.0D as forecast_usage")
    # several files, so that the shuffle has map outputs to split by
    usage.write.parquet(str(tmp_path / "u"))
    forecast.write.parquet(str(tmp_path / "f"))
    return spark.read.parquet(str(tmp_path / "u")), spark.read.parquet(str(tmp_path / "f"))


def _skew_joins(df) -> list[str]:
    df.toArrow()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in plan.splitlines() if "skew=true" in line]


SMALL_CELLS = HotKeyConfig(cell_rows=1000)


@pytest.mark.parametrize("null_safe", [True, False])
def test_a_hot_compare_key_is_split(spark, hot, tight_skew, null_safe):
    usage, forecast = hot
    plain = cmp.full_outer(usage, forecast, COMPARE_KEY, null_safe, unique_grain=True)
    split = cmp.full_outer(usage, forecast, COMPARE_KEY, null_safe, unique_grain=False, hot=SMALL_CELLS)

    def digest(df):
        sums = "sum(hash(part_num, actual_usage, in_forecast))"
        return tuple(df.selectExpr("count(*)", "count_if(in_usage)", "count_if(in_forecast)", sums).first())

    def largest_task(df):
        return df.where("part_num is null").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]

    assert digest(split) == digest(plain)
    assert largest_task(split) < largest_task(plain) / 3


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_salted_join_equals_brute_force(spark, null_safe, seed):
    """Keys that are hot on the left, on the right, on both sides or on one side alone, with nulls and equal rows."""
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e", None]

    def drawn(weights, n):
        return [(rng.choice(["x", None]) if rng.random() < 0.3 else "x", "L", k, JAN, "HQ", float(rng.randint(0, 3))) for k in rng.choices(names, weights, k=n)]

    left, right = drawn([40, 1, 20, 0, 5, 9], 90), [(*r[:4], r[5]) for r in drawn([1, 30, 20, 12, 0, 7], 70)]
    usage, forecast = _sides(spark, left, right)
    config = HotKeyConfig(cell_rows=4)
    joined = cmp.full_outer(usage.drop("plant"), forecast, COMPARE_KEY, null_safe, unique_grain=False, hot=config)
    columns = ["company", "location", "part_num", "period", "actual_usage", "forecast_usage"]
    assert Counter(tuple(r) for r in joined.select(*columns).collect()) == _brute(left, right, null_safe)
    found = {r.in_usage is not None and r.in_forecast is not None for r in joined.collect()}
    assert found == {True}
    assert heavy_keys(usage, COMPARE_KEY, config).count() >= 3 and heavy_keys(usage.limit(0), COMPARE_KEY, config).count() == 0


def test_undeclared_grain_computes_each_side_once(spark, monkeypatch):
    written, seen = cmp.written, []
    monkeypatch.setattr(cmp, "written", lambda df: seen.append(df) or written(df))
    result = QUERIES["reconcile_hot_keys"](spark, "/root/testdata/sf0.001")
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 2 and "l_shipdate" not in plan and "site_part_key" not in plan
    assert plan.count("Join FullOuter") == 1


def test_a_hot_part_is_split_in_lookups(hot, tight_skew, cfg):
    usage, _ = hot
    usage = usage.selectExpr("company", "'B7' as plant", "coalesce(part_num, 'hot') as part_num", "location")
    facts = usage.groupBy("company", "plant", "part_num").agg({"location": "max"}).withColumnsRenamed(
        {"max(location)": "non_stock"}
    )
    for how in ("left", "left_anti"):
        some = facts.where("part_num like '%7' or part_num = 'hot'") if how == "left" else facts.where("part_num like '%7'")
        joined = lookup(usage, some, ["company", "plant", "part_num"], how)
        assert _skew_joins(joined)
