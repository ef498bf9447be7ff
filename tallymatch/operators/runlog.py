"""Run history as an append-only event table; the state of a run is its last event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of a run, and the answer for an unknown run.
PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"
NOT_FOUND = "not_found"
PAGE_SIZE = 20


def run_id_of(ts: Column) -> Column:
    """``yyyyMMdd_HHmmss`` from the text of the timestamp, so that a zoneless one is not shifted by a zone."""
    return F.translate(F.substring(ts.cast("string"), 1, 19), " -:", "_")


def latest_state(
    events: DataFrame, run: str, order: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = ()
) -> DataFrame:
    """One row per run: columns ``last`` of its newest event and ``first`` of its oldest.

    ``max_by`` combines on the map side, so a run with very many events costs one row per task; a window would put
    all of them into one task.
    """
    at = F.struct(*order)
    return events.groupBy(run).agg(
        F.min_by(F.struct(order[0], *first), at).alias("o"),
        F.max_by(F.struct(order[0], *last), at).alias("n"),
    ).select(
        run,
        F.col(f"o.{order[0]}").alias("created_at"),
        F.col(f"n.{order[0]}").alias("updated_at"),
        *[F.col(f"o.{c}").alias(c) for c in first],
        *[F.col(f"n.{c}").alias(c) for c in last],
    )


def run_status(requested: DataFrame, latest: DataFrame, run: str, extra: Sequence[str] = ()) -> DataFrame:
    """State of every requested run; an unknown id answers ``not_found``."""
    return requested.select(run).join(latest.select(run, "state", *extra), run, "left").withColumn(
        "state", F.coalesce("state", F.lit(NOT_FOUND))
    )


def run_page(latest: DataFrame, run: str, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of the history, newest run first, with the number of pages."""
    pages = F.ceil(latest.agg(F.count("*").alias("n")).scalar() / size)
    shown = latest.orderBy(F.desc("created_at"), F.desc(run)).offset(size * (page - 1)).limit(size)
    return shown.select("*", F.lit(page).alias("page"), pages.alias("total_pages"))
