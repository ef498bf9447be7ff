from __future__ import annotations

import os
import sys
from dataclasses import replace
from datetime import date

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from tallymatch import schema  # noqa: E402
from tallymatch.catalog import CONFIG  # noqa: E402
from tallymatch.sources import FrameSource  # noqa: E402
from tallymatch.sources.literal import small_frame  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cfg():
    return CONFIG


@pytest.fixture()
def rows():
    """All rows of a frame as plain tuples, in a stable order."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect


def usage_row(key, day, a=0.0, b=0.0, c=0.0, d=0.0, counts=(0, 0, 0, 0)):
    return (key, day, a, b, c, d, *counts)


@pytest.fixture()
def make_source(spark):
    """A source of hand-made rows; tables not given are empty."""

    def build(unique_grain=False, **tables):
        frames = {name: small_frame(spark, kind, tables.get(name, [])) for name, kind in schema.TABLES.items()}
        return FrameSource(frames, unique_grain)

    return build


@pytest.fixture()
def without_exclusions(cfg):
    return replace(cfg, apply_exclusions=False)


D = date
