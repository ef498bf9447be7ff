"""Result files and intermediate tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("csv", "parquet")
_folders: list[str] = []


def write_result(df: DataFrame, path: str, file_format: str = "csv", mode: str = "errorifexists") -> None:
    """Write as CSV with header, or parquet, one directory of part files. The format is checked before any job."""
    if file_format not in FORMATS:
        raise ValueError(f"Unsupported output format: {file_format}")
    writer = df.write.mode(mode)
    if file_format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def read_result(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "csv") -> DataFrame:
    """Read a written result with its declared schema; nothing is inferred."""
    if file_format not in FORMATS:
        raise ValueError(f"Unsupported input format: {file_format}")
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if file_format == "csv" else reader.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder the cluster names for checkpoints, or else in the session's warehouse.

    A warehouse on the driver's own disk is refused on a cluster, where executors would write to theirs. The path is
    removed when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _warehouse(spark)
    path = f"{base.rstrip('/')}/tallymatch-{uuid.uuid4().hex}"
    if not _folders:
        atexit.register(_remove_folders, spark)
    _folders.append(path)
    return path


def _warehouse(spark: SparkSession) -> str:
    base = spark.conf.get("spark.sql.warehouse.dir")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        place = spark._jvm.org.apache.hadoop.fs.Path(base)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base


def _remove_folders(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None:
        return  # the session was stopped before
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _folders:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written table, for frames that several later branches read."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
