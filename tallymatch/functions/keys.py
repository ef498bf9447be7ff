"""Splitting and cleaning the composite company_plant_part key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_parts(key: Column) -> tuple[Column, Column, Column]:
    """Company, plant and part number; at most two splits, so a part number keeps its own underscores.

    A missing piece is null. ``get`` is used because indexing past the end raises under ANSI mode.
    """
    pieces = F.split(key, "_", 3)
    return F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1)), F.get(pieces, F.lit(2))


def view_key_parts(key: Column) -> tuple[Column, Column, Column]:
    """The detail-view reading of short keys: a key without underscore is its own plant, a missing part is ''."""
    company, plant, part = key_parts(key)
    return company, F.coalesce(plant, company), F.when(key.isNotNull(), F.coalesce(part, F.lit("")))


def normalized_text(text: Column) -> Column:
    """Key text as a case-insensitive, blank-padded collation would compare it."""
    return F.upper(F.rtrim(text))
