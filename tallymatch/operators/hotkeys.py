"""Full outer joins whose keys may be hot: a heavy-hitter sketch, then one shuffle with salted keys.

Adaptive execution cannot split a full outer join, so all rows of a key would meet in one task. A sketch of fixed size
finds the keys that hold many rows, on either side. Such a key gets a grid of cells: each row of the left side draws a
line and is copied to all columns, each row of the right side draws a column and is copied to all lines, so every pair
meets in exactly one cell. A side that holds few rows of a key has one line (or column) only. All other keys keep a
single cell, and each side is computed and shuffled once.

A row whose copies find no partner in some cells is not unmatched: lines are drawn only for a key that the left side does
hold, so a row of the right side has a partner in another cell, and the copy is dropped; and the other way round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch.sinks.results import written


@dataclass(frozen=True)
class HotKeyConfig:
    """``cell_rows`` rows of a key are no load for a task. The sketch tracks ``tracked`` keys and reports ``listed`` of them
    at most, which bounds what is broadcast; a key that holds over a thousandth of all rows is among them."""

    cell_rows: int = 500_000
    listed: int = 2_000
    tracked: int = 20_000
    most_lines: int = 1_000


def _complete(keys: Sequence[str], null_safe: bool) -> Column:
    """Whether a row can have a partner at all."""
    return F.lit(True) if null_safe else reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def heavy_keys(rows: DataFrame, keys: Sequence[str], config: HotKeyConfig) -> DataFrame:
    """(key_hash, lines): keys with more rows than one cell takes. Two keys of one hash are both spread, which is harmless."""
    hashed = rows.select(F.xxhash64(*keys).alias("key_hash"))
    top = hashed.agg(F.expr(f"approx_top_k(key_hash, {config.listed}, {config.tracked})").alias("top"))
    lines = F.least(F.ceil(F.col("count") / config.cell_rows), F.lit(config.most_lines)).cast("int")
    return top.select(F.inline("top")).select(F.col("item").alias("key_hash"), lines.alias("lines")).where("lines > 1")


def _dealt(rows: DataFrame, grid: DataFrame, keys: Sequence[str], own: str, other: str, null_safe: bool) -> DataFrame:
    """Rows with their cell: one of the key's ``own`` lines, and a copy for each of the other side's."""
    marked = rows.withColumn("key_hash", F.xxhash64(*keys)).join(F.broadcast(grid), "key_hash", "left").drop("key_hash")
    can_match = _complete(keys, null_safe)
    # rows without a partner may lie anywhere; equal rows must not lie together, so the number of the row decides
    mine = F.pmod(F.monotonically_increasing_id(), F.coalesce(own, F.lit(1)).cast("long")).cast("int")
    copies = F.when(can_match & (F.col(other) > 1), F.sequence(F.lit(0), F.col(other) - 1)).otherwise(F.array(F.lit(0)))
    spread = marked.withColumn("__own", mine).withColumn("__other", F.explode(copies))
    copied = can_match & (F.coalesce(other, F.lit(1)) > 1)
    return spread.withColumns({f"__{own}": F.col("__own"), f"__{other}": F.col("__other"), "__copied": copied}).drop("__own", "__other", own, other)


def salted_full_outer(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool, markers: tuple[str, str], config: HotKeyConfig = HotKeyConfig()
) -> DataFrame:
    """Full outer join with resolved key columns and a boolean marker for each side; rows that share a key multiply.

    Both sides should be written tables, since each is read for the sketch and for the join.
    """
    sketches = heavy_keys(left, keys, config).unionByName(
        heavy_keys(right, keys, config).withColumnRenamed("lines", "columns"), allowMissingColumns=True
    )
    grid = written(sketches.groupBy("key_hash").agg(F.max("lines").alias("line"), F.max("columns").alias("column")))
    a = _dealt(left, grid, keys, "line", "column", null_safe).withColumn(markers[0], F.lit(True)).alias("a")
    b = _dealt(right, grid, keys, "column", "line", null_safe).withColumn(markers[1], F.lit(True)).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if null_safe else F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    same += [F.col(f"a.__{c}") == F.col(f"b.__{c}") for c in ("line", "column")]
    joined = a.join(b, reduce(lambda x, y: x & y, same), "full_outer")
    # a copy without a partner stands for nothing: the row has one in another cell
    lone = F.col(f"a.{markers[0]}").isNull() | F.col(f"b.{markers[1]}").isNull()
    spare = lone & F.coalesce("a.__copied", "b.__copied")
    return joined.where(~spare).select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        *[F.col(f"a.{c}").alias(c) for c in left.columns if c not in keys],
        *[F.col(f"b.{c}").alias(c) for c in right.columns if c not in keys],
        F.coalesce(f"a.{markers[0]}", F.lit(False)).alias(markers[0]),
        F.coalesce(f"b.{markers[1]}", F.lit(False)).alias(markers[1]),
    )
