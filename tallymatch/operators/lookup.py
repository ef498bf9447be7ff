"""Joining many rows to a table with one row per key, and leaving out most rows that have no such key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26  # 8 MB or so in all, whatever the number of keys
_BUCKET = 32_768  # bits of one of Spark's bitmaps
_PIECE = 64  # bytes of a bitmap that a look at one bit copies


def lookup(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` with the other columns of ``facts`` (``left``), only those with facts (``left_semi``), or without them
    (``left_anti``).

    The comparison is null-safe on purpose, also where no key is null. Facts usually come out of an aggregation by the
    same keys. With plain equality the join would take that partitioning over, and adaptive execution splits a hot key
    only if both inputs of the join are fresh shuffles. The null-safe form shuffles the facts once more, which is
    little next to the rows, and a key holding a third of all rows is then spread over many tasks.
    """
    same_key = reduce(lambda a, b: a & b, [F.col(f"rows.{k}").eqNullSafe(F.col(f"facts.{k}")) for k in keys])
    joined = rows.alias("rows").join(facts.alias("facts"), same_key, how)
    own = [F.col(f"rows.{c}").alias(c) for c in rows.columns]
    if how in ("left_semi", "left_anti"):
        return joined.select(*own)
    return joined.select(*own, *[F.col(f"facts.{c}").alias(c) for c in facts.columns if c not in keys])


def possible(rows: DataFrame, keys: DataFrame, on: dict[str, Column]) -> DataFrame:
    """``rows`` without most of those whose expressions ``on`` equal no row of ``keys``; null equals null.

    ``on`` maps the columns of ``keys`` to expressions over ``rows``. Keys set bits of a bitmap of fixed size. With many
    keys more rows pass without need, none is ever lost, so something exact must follow. It is a predicate and no join:
    the planner moves it to where the expressions come from, and nothing is shuffled for it.
    """

    def slot(columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(1 << BITS))

    # seven bits of each byte are used, so that a byte is an ASCII character, whose number is cheap to tell
    place = F.expr("slot div 8 * 8 + slot % 7")
    slots = keys.select(slot([F.col(c) for c in on]).alias("slot")).select(place.alias("slot"))
    set_bits = slots.groupBy(F.expr(f"slot div {_BUCKET}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("slot") % _BUCKET).alias("bits")
    )
    buckets = rows.sparkSession.range((1 << BITS) // _BUCKET).select(F.col("id").alias("bucket"))
    listed = buckets.join(set_bits, "bucket", "left").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("b"))
    starts = F.sequence(F.lit(1), F.lit(_BUCKET // 8), F.lit(_PIECE))
    pieces = F.transform("b", lambda b: F.transform(starts, lambda start: F.substring(b["bits"], start, _PIECE)))
    bitmap = listed.select(F.flatten(pieces).alias("pieces")).scalar()
    own = slot(list(on.values()))
    byte = F.shiftright(own, 3)
    piece = F.element_at(bitmap, F.shiftright(byte, _PIECE.bit_length() - 1).cast("int") + 1)
    number = F.ascii(F.substring(piece, byte.bitwiseAND(_PIECE - 1).cast("int") + 1, 1).cast("string"))
    return rows.where(F.getbit(number, (own % 7).cast("int")) == 1)
