"""spark-submit entry point: reconcile, print the summary, save.

    spark-submit --py-files tallymatch.zip tallymatch/cli.py --config conf/example.json --tables hdfs:///recon/tables --out hdfs:///recon/out
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession

from tallymatch import schema
from tallymatch.config import ReconConfig
from tallymatch.operators import report
from tallymatch.plans.job import RunLog, run_job
from tallymatch.sinks import write_result
from tallymatch.sources import FileSource, Source
from tallymatch.sources.tables import JdbcSource


def open_source(spark: SparkSession, config: str, tables: str | None, table_format: str = "parquet") -> Source:
    """Files below ``tables``, or else what the ``database`` block of the config file names.

    ``unique_grain`` in the block ``files`` says that no compare key holds more than a handful of rows.
    """
    with open(config, encoding="utf-8") as f:
        given = json.load(f)
    if tables:
        paths = {name: f"{tables.rstrip('/')}/{name}" for name in schema.TABLES}
        return FileSource(spark, paths, table_format, unique_grain=given.get("files", {}).get("unique_grain", False))
    database = given.get("database")
    if not database:
        raise ValueError("give --tables, or a database in the config file")
    return JdbcSource.from_config(spark, database)


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--config", required=True)
    args.add_argument("--tables", help="folder with one dataset per table; default: the database of the config")
    args.add_argument("--table-format", default="parquet", choices=["parquet", "orc", "csv"])
    args.add_argument("--out", help="results folder; default: output_path of the config")
    args.add_argument("--log", help="run log folder; default: _runs below the results folder")
    given = args.parse_args(argv)

    cfg = ReconConfig.from_json(given.config)
    out = given.out or cfg.output_path
    spark = SparkSession.builder.appName("tallymatch").getOrCreate()
    source = open_source(spark, given.config, given.tables, given.table_format)
    log = RunLog(spark, given.log or f"{out.rstrip('/')}/_runs")
    run_id = log.create(cfg)
    saved = run_job(source, replace(cfg, output_path=out), log, spark, out, run_id)

    # report tables are files next to the result; only the summary, one row, is printed
    cube = report.result_cube(saved)
    tables = {
        "summary": report.summary_counts(cube, cfg.labels),
        "breakdowns": report.breakdowns(cube),
        "period_range": report.period_range(cube),
        "variance_stats": report.variance_stats(saved),
    }
    for name, table in tables.items():
        write_result(table, f"{out.rstrip('/')}/_reports/run_id={run_id}/{name}", cfg.output_format, mode="overwrite")
    tables["summary"].show(truncate=False)


if __name__ == "__main__":
    main()
