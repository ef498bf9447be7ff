"""A logged run: pending, running, then completed with metrics or failed with the error."""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch import schema
from tallymatch.config import ReconConfig
from tallymatch.operators import report, runlog
from tallymatch.plans.reconcile import reconcile
from tallymatch.sinks import MonthlyResult, month_ends, read_result, write_result


def new_run_id(now: datetime | None = None) -> str:
    """``yyyyMMdd_HHmmss`` and a suffix, because two runs may start in the same second."""
    now = now or datetime.now(timezone.utc)
    return f"{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:6]}"


class RunLog:
    """Events as JSON lines under one path, one folder per day of the run ids. Appending never rewrites, so concurrent
    runs cannot lose updates; the state of one run is read from its own day's folder."""

    _day = "run_day"
    _torn = "_unreadable"
    _times = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    _sequence = {runlog.PENDING: 0, runlog.RUNNING: 1, runlog.COMPLETED: 2, runlog.FAILED: 2}

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._path = path

    def append(self, run_id: str, state: str, **values) -> None:
        event = {f.name: None for f in schema.RUN_EVENT.fields} | values
        event |= {
            "run_id": run_id,
            "state": state,
            "event_ts": datetime.now(timezone.utc),
            "event_seq": self._sequence[state],
        }
        row = tuple(event[f.name] for f in schema.RUN_EVENT.fields)
        self.append_all(self.spark.createDataFrame([row], schema.RUN_EVENT).coalesce(1))

    def append_all(self, events: DataFrame) -> None:
        """Append many events at once, as columns of ``schema.RUN_EVENT``."""
        rows = events.select(*schema.RUN_EVENT.fieldNames(), self._day_of(F.col("run_id")).alias(self._day))
        rows.write.mode("append").partitionBy(self._day).options(**self._times).json(self._path)

    @staticmethod
    def _day_of(run_id: Column) -> Column:
        day = F.substring(run_id, 1, 8)
        return F.when(day.rlike("^[0-9]{8}$"), day).otherwise("other")

    def create(self, cfg: ReconConfig, triggered_by: str = "manual", run_id: str | None = None) -> str:
        run_id = run_id or new_run_id()
        self.append(
            run_id,
            runlog.PENDING,
            triggered_by=triggered_by,
            date_range=(cfg.start, cfg.end),
            companies=list(cfg.companies),
        )
        return run_id

    def _lines(self) -> DataFrame:
        """All lines, good or not; a missing log is empty."""
        more = T.StructType([T.StructField(self._torn, T.StringType()), T.StructField(self._day, T.StringType())])
        kinds = T.StructType([*schema.RUN_EVENT.fields, *more.fields])
        reader = self.spark.read.schema(kinds).options(**self._times, columnNameOfCorruptRecord=self._torn)
        try:
            return reader.json(self._path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], kinds)

    def _is_good(self) -> Column:
        return F.col(self._torn).isNull() & F.col("run_id").isNotNull()

    def events(self) -> DataFrame:
        """All readable events; ``unreadable`` counts the other lines."""
        return self._lines().where(self._is_good()).drop(self._torn)

    def unreadable(self) -> int:
        """Number of lines that are no events. A run whose last event is among them shows an older state."""
        return self._lines().where(~self._is_good()).count()

    def latest(self, events: DataFrame | None = None) -> DataFrame:
        return runlog.latest_state(
            self.events() if events is None else events,
            "run_id",
            ["event_ts", "event_seq"],
            first=["triggered_by", "date_range", "companies"],
            last=["state", "total_records", "critical_issues", "execution_seconds", "error", "filters"],
        )

    def status(self, run_id: str) -> tuple[str, str | None]:
        """State and error text of one run; only the events of that run are looked at."""
        own = self.events().where((F.col(self._day) == self._day_of(F.lit(run_id))) & (F.col("run_id") == run_id))
        found = self.latest(own).select("state", "error").take(1)
        return (found[0]["state"], found[0]["error"]) if found else (runlog.NOT_FOUND, None)

    def page(self, number: int = 1) -> DataFrame:
        return runlog.run_page(self.latest(), "run_id", number)


def result_path(results_root: str, run_id: str) -> str:
    return f"{results_root.rstrip('/')}/run_id={run_id}"


def run_job(source, cfg: ReconConfig, log: RunLog, spark: SparkSession, results_root: str, run_id: str) -> DataFrame:
    """Run, write the result and log every state; returns the written result.

    The metrics are counted on the written result and the counts of the filters while it is made, so the reconciliation
    runs once. With ``result_layout="run"`` the result is a folder ``run_id=...``, and writing again after a failure
    replaces this folder only. With ``"months"`` all runs are one result, of which a run replaces its own months.
    """
    if log.status(run_id)[0] == runlog.NOT_FOUND:
        raise ValueError(f"no pending entry for run {run_id}")
    log.append(run_id, runlog.RUNNING)
    try:
        started = time.monotonic()
        observed = Observation() if cfg.apply_exclusions else None
        result = reconcile(source, cfg, observed=observed)
        if cfg.result_layout == "months":
            monthly = MonthlyResult(spark, results_root, schema.RESULT, cfg.output_format)
            whole = result if cfg.apply_exclusions else result.withColumn("transaction_count_12mo", F.lit(None).cast("long"))
            monthly.replace(whole, run_id, month_ends(cfg.start, cfg.end))
            saved = monthly.read_run(run_id)
        else:
            path = result_path(results_root, run_id)
            write_result(result, path, cfg.output_format, mode="overwrite")
            saved = read_result(spark, path, result.schema, cfg.output_format)
        seconds = time.monotonic() - started
        counts = report.summary_counts(report.result_cube(saved), cfg.labels).first()
        log.append(
            run_id,
            runlog.COMPLETED,
            total_records=counts["total_records"],
            critical_issues=counts["critical_issues"],
            execution_seconds=seconds,
            filters=tuple(observed.get[c] for c in schema.FILTER_COUNTS.fieldNames()) if observed else None,
        )
        return saved
    except Exception as error:
        log.append(run_id, runlog.FAILED, error=str(error))
        raise
