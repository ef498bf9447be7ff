"""Reading the corpus tables and cutting lineage with written tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def on_executors(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = f"{tempfile.mkdtemp(prefix='tallymatch-')}/{package.name}"
        context.addPyFile(shutil.make_archive(archive, "zip", root_dir=package.parent, base_dir=package.name))
        _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is set only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = LOCAL_CHECKPOINTS
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as a table into the shared folder and read back.

    Later branches and iterations read the table instead of planning and running everything before it again, and a
    lost executor costs no more than the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    frame = spark.read.schema(df.schema).parquet(path)
    frame.stored_at = path
    return frame


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` returned, once nothing that is still to run reads it."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(vars(df)["stored_at"])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
