"""A result kept by month: a rerun replaces its own months, and readers see whole runs only.

Each attempt to write is a version of its own: rows go below ``data/version=.../period=...`` and change nothing that is
already there. What counts is the manifest: one small file per attempt, written last, that names the run, its version and
its months. Of each month the newest version in the manifest is read. An attempt that fails before its manifest has left
files that no reader looks at, whatever a later attempt of the same run writes. Overwriting partitions in place would not
do: a reader could meet months of two runs, and a month that has no rows any more would keep its old ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch.sinks.results import FORMATS

MANIFEST = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("period", T.DateType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("written_at", T.TimestampType()),
    ]
)
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def month_ends(start: date, end: date) -> list[date]:
    """The last days of all months that a range touches."""
    out, first = [], start.replace(day=1)
    while first <= end:
        following = (first + timedelta(days=32)).replace(day=1)
        out.append(following - timedelta(days=1))
        first = following
    return out


class MonthlyResult:
    """``columns`` are those of the result, ``period`` among them; their types are declared, never inferred."""

    def __init__(self, spark: SparkSession, path: str, columns: T.StructType, file_format: str = "parquet"):
        if file_format not in FORMATS:
            raise ValueError(f"Unsupported output format: {file_format}")
        self._spark = spark
        self._data = f"{path.rstrip('/')}/data"
        self._manifest = f"{path.rstrip('/')}/manifest"
        self._format = file_format
        self._columns = columns

    def replace(self, result: DataFrame, run_id: str, months: Sequence[date]) -> DataFrame:
        """Write a run's rows, then make them the valid ones of all ``months`` and of those the rows have; returns its
        manifest. A month without rows is replaced by none."""
        kept = result.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self._columns])
        version = f"{run_id}-{uuid.uuid4().hex[:8]}"
        rows = kept.withColumn("version", F.lit(version))
        self._options(rows.write.mode("append").partitionBy("version", "period")).save(self._data)
        self._publish(run_id, version, months)
        return self.entries().where(F.col("version") == version)

    def _publish(self, run_id: str, version: str, months: Sequence[date]) -> None:
        written = self._rows().where(F.col("version") == version).groupBy("period").agg(F.count("*").alias("n_rows"))
        wanted = self._spark.createDataFrame([(m,) for m in months], T.StructType([T.StructField("period", T.DateType())]))
        counts = wanted.select("period", F.lit(0).cast("long").alias("n_rows")).unionByName(written)
        entry = counts.groupBy("period").agg(F.max("n_rows").alias("n_rows")).select(
            F.lit(run_id).alias("run_id"), F.lit(version).alias("version"), "period", "n_rows", F.lit(datetime.now(timezone.utc)).alias("written_at")
        )
        # one file: it appears whole or not at all
        entry.coalesce(1).write.mode("append").options(**_TIMES).json(self._manifest)

    def _options(self, io):
        io = io.format(self._format)
        return io.option("header", True) if self._format == "csv" else io

    def _rows(self) -> DataFrame:
        """All rows of all runs, valid or not; partitions are listed, so a filter on them is not read past."""
        stored = T.StructType([f for f in self._columns if f.name != "period"])
        stored = stored.add("version", T.StringType()).add("period", T.DateType())
        try:
            return self._options(self._spark.read).schema(stored).load(self._data)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], stored)

    def entries(self) -> DataFrame:
        """The manifest: months of runs, newest or not."""
        try:
            return self._spark.read.schema(MANIFEST).options(**_TIMES).json(self._manifest)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], MANIFEST)

    def valid(self, entries: DataFrame | None = None) -> DataFrame:
        """(period, run_id, version, n_rows): what counts for each month."""
        newest = F.max_by(F.struct("run_id", "version", "n_rows"), F.struct("written_at", "version"))
        found = self.entries() if entries is None else entries
        return found.groupBy("period").agg(newest.alias("newest")).select("period", "newest.*")

    def _matching(self, valid: DataFrame, how: str) -> DataFrame:
        """Rows by their version and month; of ``valid`` there is a row a month, and its versions prune the partitions."""
        rows, chosen = self._rows().alias("r"), valid.select("period", "version").alias("v")
        same = (F.col("r.version") == F.col("v.version")) & F.col("r.period").eqNullSafe(F.col("v.period"))
        return rows.join(F.broadcast(chosen), same, how).select("r.*")

    def read(self) -> DataFrame:
        """The valid rows of all months."""
        return self._matching(self.valid(), "left_semi").select(*self._columns.fieldNames())

    def read_run(self, run_id: str) -> DataFrame:
        """What one run wrote last, whether later runs have replaced it or not."""
        own = self.valid(self.entries().where(F.col("run_id") == run_id))
        return self._matching(own, "left_semi").select(*self._columns.fieldNames())

    def superseded(self) -> DataFrame:
        """(version, period) of stored partitions that no reader looks at, also those of attempts that failed."""
        return self._matching(self.valid(), "left_anti").select("version", "period").distinct()
