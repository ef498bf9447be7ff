"""Exact median without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Level 0 splits by magnitude: doubles span about 2100 powers of two, each cut into 16 buckets, so there are at most some
# 34,000. A bucket holds at most 2**48 doubles; two levels of 100,000 equal steps leave some 28,000 of them. So no running
# total, and not the last step, sees more than 100,000 rows.
MAGNITUDE_STEPS = 16
EQUAL_STEPS = 100_000
EQUAL_LEVELS = 2


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Columns ``v`` and ``n``: every value with its number of rows; null and NaN are not counted.

    A hot value shrinks to one row per task before anything is shuffled.
    """
    value = F.col(column)
    known = df.where(value.isNotNull() & ~F.isnan(value.cast("double")))
    return known.groupBy(value.alias("v")).agg(F.count("*").alias("n"))


def exact_median(counted: DataFrame) -> DataFrame:
    """One row with the interpolated median of non-negative ``value_counts``; null if there are none.

    The built-in ``median`` merges every distinct value into one task. Here the middle rank is located by histogram
    descent: counts per bucket, a running total over the buckets, and only the bucket holding the rank goes on. All
    bucket functions are monotone, so the result is exact.
    """
    start = counted.select(
        F.col("v").cast("double").alias("v"),
        "n",
        F.lit(0).cast("bigint").alias("below"),
        F.lit(None).cast("double").alias("beyond"),
        F.lit(None).cast("bigint").alias("total"),
    )
    level = _descend(start, _magnitude_bucket())
    for _ in range(EQUAL_LEVELS):
        level = _descend(level, _equal_bucket())
    last = _located(level, F.col("v")).where(F.col("upto") >= _lower_rank())
    return last.agg(F.min_by(F.struct("lo", "upto", "beyond", "total"), "bucket").alias("m")).select(
        F.when(F.col("m.upto") * 2 > F.col("m.total"), F.col("m.lo"))
        .otherwise((F.col("m.lo") + F.col("m.beyond")) / 2)
        .alias("median")
    )


def _lower_rank() -> Column:
    return F.floor((F.col("total") + 1) / 2)


def _magnitude_bucket() -> Column:
    v = F.col("v")
    return (
        F.when(v <= 0, F.lit(-10_000_000))
        .when(v == float("inf"), F.lit(10_000_000))
        .otherwise(F.floor(F.log2(v) * MAGNITUDE_STEPS))
    )


def _equal_bucket() -> Column:
    low, high = F.col("lo"), F.col("hi")
    return F.when(high > low, F.floor((F.col("v") - low) / (high - low) * EQUAL_STEPS)).otherwise(F.lit(0))


def _located(values: DataFrame, bucket: Column) -> DataFrame:
    """Per bucket: smallest and largest value, number of values up to it, and the next value after it."""
    totals = values.groupBy(bucket.alias("bucket")).agg(
        F.sum("n").alias("in_bucket"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        *[F.any_value(c).alias(c) for c in ("below", "beyond", "total")],
    )
    ordered = W.orderBy("bucket")
    return totals.select(
        "bucket",
        "lo",
        "hi",
        "in_bucket",
        (F.col("below") + F.sum("in_bucket").over(ordered.rowsBetween(W.unboundedPreceding, 0))).alias("upto"),
        F.coalesce(F.lead("lo").over(ordered), "beyond").alias("beyond"),
        F.coalesce(
            "total", F.sum("in_bucket").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        ).alias("total"),
    )


def _descend(values: DataFrame, bucket: Column) -> DataFrame:
    """The values of the bucket that holds the lower middle rank, with what lies below and beyond it."""
    carried = F.struct(
        "bucket", "lo", "hi", (F.col("upto") - F.col("in_bucket")).alias("below"), "beyond", "total"
    )
    chosen = (
        _located(values, bucket)
        .where(F.col("upto") >= _lower_rank())
        .agg(F.min_by(carried, "bucket").alias("c"))
        .select("c.*")
    )
    # one row by construction
    return values.select("v", "n", bucket.alias("bucket")).join(F.broadcast(chosen), "bucket")
