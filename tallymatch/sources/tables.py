"""Sources: one object per storage, all handing out the same six lazy tables.

``usage`` and ``forecast`` take the run range as arguments. The filter is put on the raw column, before any
month-end shift, so it reaches parquet row groups, partitions and the JDBC statement.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch import schema


def bounded(df: DataFrame, column: str, start: date | None, end: date | None) -> DataFrame:
    """Rows with ``start <= column <= end``; an open side is not filtered."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end))
    return df


class Source:
    """Base: subclasses deliver ``table(name)``; everything else is checking and range filters."""

    # True if the storage guarantees at most one usage row per (company, plant, part, month) and a handful of
    # forecast rows per compare key. Only then may the full outer join run unprotected against hot keys.
    unique_grain = False

    def table(self, name: str) -> DataFrame:
        raise NotImplementedError

    def _checked(self, name: str) -> DataFrame:
        return schema.check_columns(self.table(name), schema.TABLES[name], name)

    def usage(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return bounded(self._checked("usage"), "period_end", start, end)

    def forecast(self, start: date | None = None, end: date | None = None) -> DataFrame:
        return bounded(self._checked("forecast"), "period", start, end)

    # True if ``usage_among`` and ``forecast_among`` hand out hardly more than what is asked for.
    reduces = False

    def usage_among(self, keys: DataFrame) -> DataFrame:
        """All usage of the given (company, plant, part_num), and maybe other rows."""
        return self.usage()

    def forecast_among(self, keys: DataFrame) -> DataFrame:
        """All forecast rows of the given (company, part_num), and maybe other rows."""
        return self.forecast()

    def last_forecast(self) -> DataFrame:
        """One row, column ``last``: the newest forecast period."""
        return self.forecast().agg(F.max("period").alias("last"))

    def part_master(self) -> DataFrame:
        return self._checked("part_master")

    def part_site(self) -> DataFrame:
        return self._checked("part_site")

    def part_site_ud(self) -> DataFrame:
        return self._checked("part_site_ud")

    def method_codes(self) -> DataFrame:
        return self._checked("method_codes")


class FrameSource(Source):
    """Tables that already are DataFrames."""

    def __init__(self, frames: Mapping[str, DataFrame], unique_grain: bool = False):
        self._frames = dict(frames)
        self.unique_grain = unique_grain

    def table(self, name: str) -> DataFrame:
        return self._frames[name]


class FileSource(Source):
    """Parquet, ORC or CSV datasets, one path per table.

    ``renames`` maps a table to ``{stored column: column used here}`` for data kept under other names.
    CSV is read with the declared schema, never inferred.
    """

    def __init__(
        self,
        spark: SparkSession,
        paths: Mapping[str, str],
        file_format: str = "parquet",
        renames: Mapping[str, Mapping[str, str]] | None = None,
        unique_grain: bool = False,
    ):
        self._spark = spark
        self._paths = dict(paths)
        self._format = file_format
        self._renames = renames or {}
        self.unique_grain = unique_grain

    def table(self, name: str) -> DataFrame:
        reader = self._spark.read.format(self._format)
        renames = self._renames.get(name, {})
        if self._format == "csv":
            stored = {new: old for old, new in renames.items()}
            fields = [(stored.get(f.name, f.name), f.dataType) for f in schema.TABLES[name].fields]
            reader = reader.schema(", ".join(f"`{n}` {t.simpleString()}" for n, t in fields)).option("header", True)
        return reader.load(self._paths[name]).withColumnsRenamed(dict(renames))


def jdbc_options(database: Mapping[str, str], env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Reader options for SQL Server; user and password come from the environment, never from the config file."""
    env = os.environ if env is None else env
    missing = [name for name in ("DB_USERNAME", "DB_PASSWORD") if not env.get(name)]
    if missing:
        raise ValueError(f"set {' and '.join(missing)} in the environment")
    return {
        "url": f"jdbc:sqlserver://{database['server']}:{database.get('port', 1433)};"
        f"databaseName={database['database']};encrypt=true",
        "driver": database.get("driver", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
        "user": env["DB_USERNAME"],
        "password": env["DB_PASSWORD"],
        "fetchsize": str(database.get("fetchsize", 10_000)),
    }


def month_predicates(column: str, start: date, end: date, key: str | None = None, splits: int = 1) -> list[str]:
    """One half-open SQL range per month, each split by a hash of ``key``, so that a JDBC fact table is read by as many
    tasks as it has months times ``splits``. A null key hashes like any other."""
    ranges, lower = [], start
    while lower <= end:
        following = (lower.replace(day=1) + timedelta(days=32)).replace(day=1)
        upper = min(following, end + timedelta(days=1))
        month = f"{column} >= '{lower.isoformat()}' AND {column} < '{upper.isoformat()}'"
        hashed = [f" AND ABS(CAST(CHECKSUM({key}) AS BIGINT)) % {splits} = {i}" for i in range(splits)]
        ranges += [month + h for h in hashed] if key and splits > 1 else [month]
        lower = upper
    return ranges


def hash_predicates(columns: Sequence[str], splits: int) -> list[str]:
    """SQL conditions that divide a table by a hash of text or number columns; every row meets exactly one of them.

    The database's own hash gives an integer for any row, null columns included.
    """
    hashed = f"ABS(CAST(CHECKSUM({', '.join(columns)}) AS BIGINT)) % {splits}"
    return [f"{hashed} = {i}" for i in range(splits)]


class JdbcSource(Source):
    """Tables behind JDBC. ``tables`` maps a table here to the table or subquery there.

    ``splits`` says by how many tasks a table is read, for all tables or by name. A bounded fact table is read with so
    many partitions per month, any other read of a table that grows with the business by a hash of its key, which needs no
    numeric column; ``partitioning[name]`` (partitionColumn, lowerBound, upperBound, numPartitions) takes precedence. One
    open connection for a whole table would be one task, so that case is refused. The code table is short.
    """

    LARGE = ("usage", "forecast", "part_master", "part_site", "part_site_ud")
    SPLIT_BY = {
        "usage": ("site_part_key",),
        "forecast": ("product",),
        "part_master": ("company", "part_num"),
        "part_site": ("company", "part_num", "plant"),
        "part_site_ud": ("foreign_row_id",),
        "method_codes": ("code_id",),
    }

    def __init__(
        self,
        spark: SparkSession,
        options: Mapping[str, str],
        tables: Mapping[str, str],
        partitioning: Mapping[str, Mapping[str, str]] | None = None,
        renames: Mapping[str, Mapping[str, str]] | None = None,
        unique_grain: bool = False,
        splits: int | Mapping[str, int] = 1,
    ):
        self._splits = splits
        self._spark = spark
        self._options = dict(options)
        self._tables = dict(tables)
        self._partitioning = partitioning or {}
        self._renames = renames or {}
        self.unique_grain = unique_grain

    @classmethod
    def from_config(cls, spark: SparkSession, database: Mapping, env: Mapping[str, str] | None = None) -> JdbcSource:
        """From the ``database`` block of a config file: server, database, tables, partitioning, renames, splits."""
        missing = [n for n in schema.TABLES if n not in database.get("tables", {})]
        if missing:
            raise ValueError(f"the database block names no table for {', '.join(missing)}")
        return cls(
            spark,
            jdbc_options(database, env),
            database["tables"],
            database.get("partitioning"),
            database.get("renames"),
            database.get("unique_grain", False),
            database.get("splits", 1),
        )

    def splits(self, name: str) -> int:
        return self._splits if isinstance(self._splits, int) else self._splits.get(name, 1)

    def _stored(self, name: str, columns: Sequence[str]) -> list[str]:
        """Names that columns have in the database."""
        there = {new: old for old, new in self._renames.get(name, {}).items()}
        return [there.get(c, c) for c in columns]

    def _by_predicates(self, name: str, predicates: list[str]) -> DataFrame:
        plain = {k: v for k, v in self._options.items() if k != "url"}
        read = self._spark.read.jdbc(self._options["url"], self._tables[name], predicates=predicates, properties=plain)
        return read.withColumnsRenamed(dict(self._renames.get(name, {})))

    def table(self, name: str) -> DataFrame:
        split = self._partitioning.get(name)
        if split is None and self.splits(name) > 1:
            return self._by_predicates(name, hash_predicates(self._stored(name, self.SPLIT_BY[name]), self.splits(name)))
        if split is None and name in self.LARGE:
            raise ValueError(f"reading all of '{name}' over JDBC needs splits or partitioning options")
        reader = self._spark.read.format("jdbc").options(**self._options, dbtable=self._tables[name], **(split or {}))
        return reader.load().withColumnsRenamed(dict(self._renames.get(name, {})))

    def _months(self, name: str, column: str, start: date, end: date) -> DataFrame:
        stored, key = self._stored(name, [column])[0], ", ".join(self._stored(name, self.SPLIT_BY[name]))
        df = self._by_predicates(name, month_predicates(stored, start, end, key, self.splits(name)))
        return bounded(schema.check_columns(df, schema.TABLES[name], name), column, start, end)

    def last_forecast(self) -> DataFrame:
        """The database finds the newest period; one row is read."""
        period = self._stored("forecast", ["period"])[0]
        newest = f"(SELECT MAX({period}) AS last FROM {self._from('forecast')}) newest"
        return self._spark.read.format("jdbc").options(**self._options, dbtable=newest).load().select("last")

    def _from(self, name: str) -> str:
        """The table or subquery as it stands in a FROM clause, where a subquery needs a name."""
        table = self._tables[name].strip()
        return f"{table} whole" if table.startswith("(") and table.endswith(")") else table

    def usage(self, start: date | None = None, end: date | None = None) -> DataFrame:
        if start is not None and end is not None:
            return self._months("usage", "period_end", start, end)
        return super().usage(start, end)

    def forecast(self, start: date | None = None, end: date | None = None) -> DataFrame:
        if start is not None and end is not None:
            return self._months("forecast", "period", start, end)
        return super().forecast(start, end)
