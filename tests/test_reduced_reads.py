"""Tables that the investigation reads only for its cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymatch import schema
from tallymatch.catalog import CONFIG, NO_EXCLUSIONS
from tallymatch.operators import investigate as inv
from tallymatch.operators.lookup import lookup, possible
from tallymatch.operators.normalize import parse_key
from tallymatch.plans import reconcile as run
from tallymatch.plans.investigation import Investigation
from tallymatch.sources import DerivedSource

SAMPLE = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_possible_loses_no_row_and_leaves_out_most(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("a"), (F.col("id") % 7).alias("b"))
    keys = rows.where("a is null or hash(a) % 100 = 0").select(F.col("b").alias("y"), F.col("a").alias("x"))
    kept = possible(rows, keys, {"x": F.col("a"), "y": F.col("b")})
    wanted = {tuple(r) for r in keys.select("x", "y").collect()}
    found = {tuple(r) for r in kept.collect()}
    assert (None, 0) in wanted and wanted <= found and len(found) < len(wanted) + 50
    assert possible(rows, keys.where("false"), {"x": F.col("a"), "y": F.col("b")}).count() == 0


def test_keyed_reads_hold_every_row_of_the_keys(spark, rows):
    source = DerivedSource(spark, SAMPLE)
    keys = parse_key(source.usage()).where("part_num like '%7' or part_num like '%?'").select("company", "plant", "part_num").distinct()
    for whole, among, by in (
        (parse_key(source.usage()), parse_key(source.usage_among(keys)), schema.USAGE_KEY),
        (
            source.forecast().withColumnRenamed("product", "part_num"),
            source.forecast_among(keys).withColumnRenamed("product", "part_num"),
            schema.PART_KEY,
        ),
    ):
        only = keys.select(*by).distinct()
        exact = rows(lookup(whole, only, by, "left_semi"))
        assert exact and rows(lookup(among, only, by, "left_semi")) == exact
        assert len(exact) <= among.count() < whole.count() / 2


def test_reduced_tables_give_the_same_evidence(spark, rows):
    source = DerivedSource(spark, SAMPLE)
    found = Investigation.of(source, run.reconcile(source, CONFIG, keep_plant=True), CONFIG)
    assert rows(found.history) == rows(inv.usage_history(found.cases, source.usage(), CONFIG))
    assert rows(found.presence) == rows(inv.forecast_presence(found.cases, source.forecast(), CONFIG))
    whole = inv.verify(found.cases, source.usage(), source.forecast(), CONFIG)
    reduced = inv.verify(found.cases, source.usage_among(found.cases), source.forecast_among(found.cases), CONFIG, True)
    assert rows(whole) == rows(reduced)


def test_lines_are_left_out_before_they_are_shuffled(spark):
    source = DerivedSource(spark, SAMPLE)
    found = Investigation.of(source, run.reconcile(source, NO_EXCLUSIONS, keep_plant=True), NO_EXCLUSIONS)
    # cases are stored: no branch computes them again
    assert "Join" not in physical(found.cases) and "Exchange" not in physical(found.cases)
    for evidence in (found.history, found.presence):
        plan = physical(evidence)
        assert "LeftSemi" not in plan
        below = plan[plan.rindex("Exchange hashpartitioning(pk") :]
        assert below.index("xxhash64") < below.index("FileScan parquet [l_partkey")
