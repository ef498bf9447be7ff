"""Sources, sinks, run log, logged job and command line."""

from __future__ import annotations

import json
import os
from dataclasses import replace
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch import cli, schema
from tallymatch.catalog import CONFIG
from tallymatch.config import ReconConfig
from tallymatch.operators import report, runlog
from tallymatch.plans import reconcile as run
from tallymatch.plans.job import RunLog, new_run_id, result_path, run_job
from tallymatch.sinks import MonthlyResult, month_ends, read_result, shared_dir, write_result, written
from tallymatch.sinks import results as files
from tallymatch.sources import DerivedSource, FileSource, FrameSource
from tallymatch.sources.tables import JdbcSource, hash_predicates, jdbc_options, month_predicates

SAMPLE = "/root/testdata/sf0.001"
EXAMPLE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "conf", "example.json")


def _formatted(df, capsys) -> str:
    df.explain("formatted")
    return capsys.readouterr().out


def test_columns_are_checked_without_a_job(spark):
    bad = FrameSource({"usage": spark.range(1), "forecast": spark.range(1)})
    with pytest.raises(ValueError, match="table 'usage' lacks columns: site_part_key"):
        bad.usage()
    wrong = spark.range(1).selectExpr("1 as company", "'' as location", "'' as product", "'' as period", "1 as qty")
    with pytest.raises(ValueError, match="company is int, expected string; period is string, expected date"):
        FrameSource({"forecast": wrong}).forecast()


def test_range_filter_reaches_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "usage")
    DerivedSource(spark, SAMPLE).usage().write.parquet(path)
    usage = FileSource(spark, {"usage": path}).usage(date(2000, 1, 1), date(2000, 12, 31)).select("qty_a")
    plan = _formatted(usage, capsys)
    assert "GreaterThanOrEqual(period_end,2000-01-01)" in plan and "LessThanOrEqual(period_end,2000-12-31)" in plan
    assert "ReadSchema: struct<period_end:date,qty_a:double>" in plan


def test_derived_range_prunes_by_the_stored_date(spark, capsys):
    usage = DerivedSource(spark, SAMPLE).usage(date(2000, 1, 1), date(2000, 12, 31))
    plan = _formatted(usage, capsys)
    assert "GreaterThanOrEqual(l_shipdate,2000-01-01T00:00)" in plan
    assert "LessThan(l_shipdate,2001-01-01T00:00)" in plan


@pytest.mark.parametrize("start", [date(2000, 1, 1), date(2000, 1, 31), date(2000, 2, 10)])
@pytest.mark.parametrize("end", [date(2000, 6, 30), date(2000, 6, 29)])
def test_bounded_tables_equal_a_filter_on_the_whole(spark, start, end):
    source = DerivedSource(spark, SAMPLE)
    for table, column in ((source.usage, "period_end"), (source.forecast, "period")):
        whole = table().where(F.col(column).between(F.lit(start), F.lit(end)))
        bounded = table(start, end)
        assert bounded.exceptAll(whole).count() == 0 and whole.exceptAll(bounded).count() == 0


def test_renamed_columns_and_csv(spark, tmp_path):
    forecast = DerivedSource(spark, SAMPLE).forecast()
    path = str(tmp_path / "f")
    forecast.withColumnRenamed("product", "item").write.option("header", True).csv(path)
    source = FileSource(spark, {"forecast": path}, "csv", renames={"forecast": {"item": "product"}})
    assert source.forecast().exceptAll(forecast).count() == 0
    assert source.forecast().schema == schema.FORECAST


def test_jdbc_options_and_partitions(spark):
    database = {"server": "db", "database": "erp"}
    options = jdbc_options(database, {"DB_USERNAME": "u", "DB_PASSWORD": "p"})
    assert options["url"].startswith("jdbc:sqlserver://db:1433;databaseName=erp")
    assert (options["user"], options["password"]) == ("u", "p")
    with pytest.raises(ValueError, match="DB_PASSWORD"):
        jdbc_options(database, {"DB_USERNAME": "u"})
    assert month_predicates("p", date(2000, 11, 15), date(2001, 1, 1)) == [
        "p >= '2000-11-15' AND p < '2000-12-01'",
        "p >= '2000-12-01' AND p < '2001-01-01'",
        "p >= '2001-01-01' AND p < '2001-01-02'",
    ]
    assert month_predicates("p", date(2000, 1, 1), date(2000, 1, 31), "k", 2) == [
        f"p >= '2000-01-01' AND p < '2000-02-01' AND ABS(CAST(CHECKSUM(k) AS BIGINT)) % 2 = {i}" for i in (0, 1)
    ]
    tables = {name: f"dbo.{name}" for name in schema.TABLES}
    source = JdbcSource(spark, options, tables)
    for read in (source.usage, source.forecast, source.part_master, source.part_site, source.part_site_ud):
        with pytest.raises(ValueError, match="partitioning"):
            read()


class _Reads:
    """Stands in for the database: remembers what would be read and answers with empty tables."""

    def __init__(self, spark, monkeypatch, renames=None):
        self.calls = []
        names = {f"dbo.{n}": n for n in schema.TABLES}
        back = {n: {new: old for old, new in m.items()} for n, m in (renames or {}).items()}

        def empty(table):
            name = names[max((t for t in names if t in table), key=len)]
            return spark.createDataFrame([], schema.TABLES[name]).withColumnsRenamed(back.get(name, {}))

        def jdbc(reader, url, table, predicates=None, properties=None):
            self.calls.append((table, predicates, {}))
            assert url.startswith("jdbc:") and "url" not in properties and properties["user"] == "u"
            return empty(table)

        def load(reader):
            options = dict(reader.__dict__.get("_seen", {}))
            self.calls.append((options["dbtable"], None, options))
            return spark.createDataFrame([], "last date") if "MAX(" in options["dbtable"] else empty(options["dbtable"])

        def options(reader, **given):
            reader._seen = given
            return reader

        for name, f in (("jdbc", jdbc), ("load", load), ("options", options)):
            monkeypatch.setattr(DataFrameReader, name, f)


def test_every_table_of_a_database_is_read_by_many_tasks(spark, monkeypatch):
    options = jdbc_options({"server": "db", "database": "erp"}, {"DB_USERNAME": "u", "DB_PASSWORD": "p"})
    tables = {name: f"dbo.{name}" for name in schema.TABLES}
    renames = {"part_master": {"PartNum": "part_num"}, "forecast": {"Month": "period", "Item": "product"}}
    reads = _Reads(spark, monkeypatch, renames)
    source = JdbcSource(spark, options, tables, renames=renames, splits={n: 4 for n in JdbcSource.LARGE})
    keys = {
        "usage": "site_part_key", "forecast": "Item", "part_master": "company, PartNum",
        "part_site": "company, part_num, plant", "part_site_ud": "foreign_row_id",
    }
    for name in schema.TABLES:
        frame = getattr(source, name)()
        assert frame.columns[: len(schema.TABLES[name])] == schema.TABLES[name].fieldNames()
        table, predicates, given = reads.calls.pop()
        if name in keys:
            assert (table, predicates) == (f"dbo.{name}", [f"ABS(CAST(CHECKSUM({keys[name]}) AS BIGINT)) % 4 = {i}" for i in range(4)])
        else:
            assert predicates is None and given["dbtable"] == "dbo.method_codes"
    # a range is read by month, each month by hash
    source.usage(date(2000, 1, 1), date(2000, 3, 31))
    assert len(reads.calls.pop()[1]) == 12
    # the newest period is found by the database
    assert source.last_forecast().columns == ["last"]
    assert reads.calls.pop()[0] == "(SELECT MAX(Month) AS last FROM dbo.forecast) newest"
    # a numeric column takes precedence where one is named; a subquery keeps its own name or gets one
    split = {"partitionColumn": "row_id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}
    named = JdbcSource(spark, options, tables | {"forecast": "(SELECT * FROM dbo.forecast)"}, {"part_site": split}, splits=2)
    named.part_site()
    assert reads.calls.pop()[2]["numPartitions"] == "3"
    named.last_forecast()
    assert reads.calls.pop()[0] == "(SELECT MAX(period) AS last FROM (SELECT * FROM dbo.forecast) whole) newest"


def test_hash_predicates_meet_each_row_once():
    made = hash_predicates(["a", "b"], 3)
    assert made == [f"ABS(CAST(CHECKSUM(a, b) AS BIGINT)) % 3 = {i}" for i in range(3)]


def test_database_of_the_config(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("DB_USERNAME", "u")
    monkeypatch.setenv("DB_PASSWORD", "p")
    tables = {name: f"dbo.{name}" for name in schema.TABLES}
    path = tmp_path / "run.json"
    path.write_text(json.dumps({"database": {"server": "db", "database": "erp", "tables": tables, "splits": 8}}))
    source = cli.open_source(spark, str(path), None)
    assert isinstance(source, JdbcSource) and source._splits == 8 and source._tables == tables
    assert isinstance(cli.open_source(spark, str(path), "/somewhere"), FileSource)
    path.write_text(json.dumps({"database": {"server": "db", "database": "erp", "tables": {}}}))
    with pytest.raises(ValueError, match="names no table for usage"):
        cli.open_source(spark, str(path), None)
    path.write_text("{}")
    with pytest.raises(ValueError, match="--tables"):
        cli.open_source(spark, str(path), None)


def test_result_files(spark, tmp_path):
    result = run.reconcile(DerivedSource(spark, SAMPLE), CONFIG)
    assert dict(result.dtypes) == dict(spark.createDataFrame([], schema.RESULT).dtypes)
    for kind in ("csv", "parquet"):
        path = str(tmp_path / kind)
        write_result(result, path, kind)
        back = read_result(spark, path, result.schema, kind)
        assert back.exceptAll(result).count() == 0 and back.count() == result.count()
    with pytest.raises(ValueError, match="Unsupported output format: excel"):
        write_result(result, str(tmp_path / "x"), "excel")
    assert not os.path.exists(str(tmp_path / "x"))


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_dir(spark), shared_dir(spark)
    assert first.startswith(base) and first != second
    assert written(spark.range(3)).count() == 3


class _OnCluster:
    """A session's settings as a cluster without a shared folder has them."""

    def __init__(self, spark, warehouse):
        self.conf, self._jvm, self._jsc = self, spark._jvm, spark._jsc
        self._settings = {"spark.sql.warehouse.dir": warehouse, "spark.master": "yarn"}

    def get(self, key, default=None):
        return self._settings.get(key, default)


def test_a_local_warehouse_is_refused_on_a_cluster(spark, tmp_path):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.shared_dir(_OnCluster(spark, f"file://{tmp_path}"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.shared_dir(_OnCluster(spark, str(tmp_path)))


# --- results by month --------------------------------------------------------------------------------------------

KINDS = T.StructType([T.StructField("part_num", T.StringType()), T.StructField("period", T.DateType()), T.StructField("amount", T.DoubleType())])
JAN, FEB, MAR = date(2000, 1, 31), date(2000, 2, 29), date(2000, 3, 31)


def test_months_of_a_range():
    assert month_ends(date(2000, 1, 15), date(2000, 3, 1)) == [JAN, FEB, MAR]
    assert month_ends(date(1999, 12, 31), date(2000, 1, 1)) == [date(1999, 12, 31), JAN]
    assert month_ends(date(2000, 2, 1), date(2000, 1, 1)) == []


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_a_rerun_replaces_its_months_only(spark, tmp_path, kind):
    kept = MonthlyResult(spark, str(tmp_path), KINDS, kind)
    assert kept.read().count() == 0 and kept.valid().count() == 0 and kept.superseded().count() == 0

    def rows(*given):
        return spark.createDataFrame(given, KINDS)

    def now():
        return sorted((tuple(r) for r in kept.read().collect()), key=repr)

    kept.replace(rows(("a", JAN, 1.0), ("a", FEB, 2.0), ("a", MAR, 3.0), ("n", None, 9.0)), "one", [JAN, FEB, MAR])
    assert now() == sorted([("a", JAN, 1.0), ("a", FEB, 2.0), ("a", MAR, 3.0), ("n", None, 9.0)], key=repr)
    # two months again; one of them has no rows any more
    kept.replace(rows(("b", FEB, 5.0)), "two", [FEB, MAR])
    assert now() == sorted([("a", JAN, 1.0), ("b", FEB, 5.0), ("n", None, 9.0)], key=repr)
    assert sorted((r.version[:3], r.period) for r in kept.superseded().collect()) == [("one", FEB), ("one", MAR)]
    assert sorted(tuple(r) for r in kept.read_run("two").collect()) == [("b", FEB, 5.0)]
    # the same run again replaces itself
    kept.replace(rows(("c", FEB, 6.0), ("c", FEB, 6.0)), "two", [FEB, MAR])
    assert now() == sorted([("a", JAN, 1.0), ("c", FEB, 6.0), ("c", FEB, 6.0), ("n", None, 9.0)], key=repr)
    assert {(r.period, r.run_id, r.n_rows) for r in kept.valid().collect()} == {(JAN, "one", 1), (FEB, "two", 2), (MAR, "two", 0), (None, "one", 1)}


def test_a_failed_write_is_never_seen(spark, tmp_path, monkeypatch):
    kept = MonthlyResult(spark, str(tmp_path), KINDS)
    kept.replace(spark.createDataFrame([("a", JAN, 1.0), ("a", FEB, 2.0)], KINDS), "one", [JAN, FEB])
    # fails while rows are written
    broken = spark.createDataFrame([("b", JAN, 7.0), ("b", FEB, 8.0)], KINDS).withColumn(
        "amount", F.when(F.col("period") == F.lit(FEB), F.raise_error("lost").cast("double")).otherwise(F.col("amount"))
    )
    with pytest.raises(Exception, match="lost"):
        kept.replace(broken, "two", [JAN, FEB])
    assert sorted(tuple(r) for r in kept.read().collect()) == [("a", JAN, 1.0), ("a", FEB, 2.0)]
    # fails after the rows, before the manifest
    with monkeypatch.context() as patched:
        patched.setattr(MonthlyResult, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            kept.replace(spark.createDataFrame([("c", JAN, 9.0), ("c", FEB, 9.0)], KINDS), "three", [JAN, FEB])
    assert sorted(tuple(r) for r in kept.read().collect()) == [("a", JAN, 1.0), ("a", FEB, 2.0)]
    assert {r.version.partition("-")[0] for r in kept.superseded().collect()} == {"three"}
    # the run starts again and succeeds
    kept.replace(spark.createDataFrame([("c", JAN, 9.0)], KINDS), "three", [JAN, FEB])
    assert [tuple(r) for r in kept.read().collect()] == [("c", JAN, 9.0)]


# --- run log -----------------------------------------------------------------------------------------------------


def test_missing_log_is_empty(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "none"))
    assert log.events().count() == 0
    assert log.status("x") == (runlog.NOT_FOUND, None)
    assert log.page().count() == 0


def test_states_and_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    log = RunLog(spark, path)
    done, failed = log.create(CONFIG), log.create(CONFIG, triggered_by="scheduler")
    assert done != failed
    assert log.status(done) == (runlog.PENDING, None)
    log.append(done, runlog.RUNNING)
    log.append(failed, runlog.FAILED, error="boom")
    assert log.status(done) == (runlog.RUNNING, None)
    assert log.status(failed) == (runlog.FAILED, "boom")
    assert log.unreadable() == 0
    with open(os.path.join(path, f"run_day={done[:8]}", "part-broken.json"), "w") as f:
        f.write('{not json\n{"run_id":"' + done + '","state":"comp')
    # torn lines are no events, but they are counted
    assert log.unreadable() == 2
    assert log.status(done) == (runlog.RUNNING, None)
    entries = {r.run_id: r for r in log.latest().collect()}
    assert set(entries) == {done, failed}
    assert entries[failed].triggered_by == "scheduler"
    assert entries[done].date_range.start == CONFIG.start
    assert entries[done].companies == list(CONFIG.companies)


def test_run_id_format():
    run_id = new_run_id(datetime(2025, 1, 2, 3, 4, 5, tzinfo=timezone.utc))
    assert run_id.startswith("20250102_030405_") and run_id != new_run_id(datetime(2025, 1, 2, 3, 4, 5))


@pytest.mark.parametrize(("runs", "pages", "last"), [(0, 0, 0), (20, 1, 20), (21, 2, 1), (41, 3, 1)])
def test_pages(spark, runs, pages, last):
    events = spark.range(runs).selectExpr(
        "id as run_id", "timestamp_seconds(id div 2) as ts", "id as event_id", "'pending' as state"
    )
    latest = runlog.latest_state(events, "run_id", ["ts", "event_id"], last=["state"])
    shown = runlog.run_page(latest, "run_id", max(pages, 1)).collect()
    assert len(shown) == last
    if shown:
        assert shown[-1].run_id == 0 and shown[0].total_pages == pages


def test_latest_event_wins_and_ties_go_by_event_number(spark):
    events = spark.createDataFrame(
        [(1, 5, 1, "pending"), (1, 5, 2, "running"), (1, 4, 9, "failed"), (2, 1, 1, "completed")],
        "run_id int, ts int, event_id int, state string",
    )
    latest = runlog.latest_state(events, "run_id", ["ts", "event_id"], last=["state"])
    asked = spark.createDataFrame([(1,), (3,)], "run_id int")
    assert {r.run_id: r.state for r in runlog.run_status(asked, latest, "run_id").collect()} == {
        1: "running",
        3: "not_found",
    }


def test_logged_job(spark, tmp_path):
    log, out = RunLog(spark, str(tmp_path / "log")), str(tmp_path / "out")
    source = DerivedSource(spark, SAMPLE)
    run_id = log.create(CONFIG)
    saved = run_job(source, replace(CONFIG, output_format="parquet"), log, spark, out, run_id)
    entry = log.latest().first()
    assert (entry.state, entry.total_records) == ("completed", saved.count())
    assert entry.critical_issues == report.summary_counts(report.result_cube(saved), CONFIG.labels).first().critical_issues
    assert entry.execution_seconds > 0
    # the filters were counted by the run itself
    impact = run.impact(source, CONFIG).first()
    assert entry.filters.asDict() == {c: impact[c] for c in schema.FILTER_COUNTS.fieldNames()}
    # all runs together are one table, partitioned by run
    assert {r.run_id for r in spark.read.parquet(out).select("run_id").distinct().collect()} == {run_id}
    assert os.path.isdir(result_path(out, run_id))

    broken = log.create(CONFIG)
    with pytest.raises(ValueError, match="Unsupported output format"):
        run_job(source, replace(CONFIG, output_format="excel"), log, spark, out, broken)
    assert log.status(broken) == (runlog.FAILED, "Unsupported output format: excel")
    with pytest.raises(ValueError, match="no pending entry"):
        run_job(source, CONFIG, log, spark, out, "unknown")


def test_config_file_equals_the_sample_config():
    assert ReconConfig.from_json(EXAMPLE) == CONFIG
    with open(EXAMPLE) as f:
        raw = json.load(f)
    raw["rules"]["exclusions"] = {"excluded_classes": ["ZZ"], "lookback_months": 6}
    raw["labels"] = {"match": "Same"}
    own = ReconConfig.from_dict(raw)
    assert (own.excluded_classes, own.lookback_months, own.labels.match) == (("ZZ",), 6, "Same")
    raw["options"]["frequency_source"] = "guess"
    with pytest.raises(ValueError, match="frequency_source"):
        ReconConfig.from_dict(raw)


def test_command_line(spark, tmp_path):
    source = DerivedSource(spark, SAMPLE)
    tables = tmp_path / "tables"
    for name in schema.TABLES:
        getattr(source, name)().write.parquet(str(tables / name))
    out = str(tmp_path / "out")
    cli.main(["--config", EXAMPLE, "--tables", str(tables), "--out", out])
    log = RunLog(spark, f"{out}/_runs")
    entry = log.latest().first()
    # other storage, no promise about the grain: same result through the split join
    assert (entry.state, entry.total_records) == ("completed", run.reconcile(source, CONFIG).count())
    # the report tables lie next to the result, whole
    groups = spark.read.option("header", True).csv(f"{out}/_reports/run_id={entry.run_id}/breakdowns")
    assert groups.count() == report.breakdowns(report.result_cube(run.reconcile(source, CONFIG))).count()
