"""Leaving out most rows of a large table before it is shuffled for a join with far fewer keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26  # 8 MB in all, whatever the number of keys
_BUCKET = 32_768  # bits of one of Spark's bitmaps


def _slot(columns: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << BITS))


def maybe_in(rows: DataFrame, keys: DataFrame, on: dict[str, Column]) -> DataFrame:
    """``rows`` with a boolean ``maybe``: false only where no row of ``keys`` can equal the expressions ``on``.

    ``on`` maps the columns of ``keys`` to expressions over ``rows``. Keys set bits of a bitmap of fixed size, which is
    broadcast; null equals null. With many keys more rows pass without need, none is ever lost: an exact join follows.
    """
    bits = (
        keys.select(_slot([F.col(c) for c in on]).alias("slot"))
        .select(F.expr(f"slot div {_BUCKET}").alias("bucket"), F.col("slot").alias("slot"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg(F.col("slot") % _BUCKET).alias("bitmap"))
    )
    slot = _slot(list(on.values()))
    marked = rows.select(F.struct("*").alias("row"), slot.alias("slot")).withColumn("bucket", F.expr(f"slot div {_BUCKET}"))
    joined = marked.join(F.broadcast(bits), "bucket", "left")
    byte = F.conv(F.hex(F.expr(f"substring(bitmap, cast(slot % {_BUCKET} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = F.expr("shiftright(byte, cast(slot % 8 as int))").bitwiseAND(1) == 1
    return joined.withColumn("byte", byte).select("row.*", F.coalesce(found, F.lit(False)).alias("maybe"))
