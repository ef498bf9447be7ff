"""Bounded samples of labelled documents for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, allowed: Column | None = None) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, chosen by a hash of doc_id and in that order.

    Rows whose label is neither 0 nor 1, whose doc_id is null or has both labels, are left out. The chosen ids are at
    most ``rows`` short rows, which bounds what is broadcast. Of a doc_id with several texts the smallest counts.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if allowed is not None:
        usable = usable.where(allowed)
    agreed = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("most")).where("label = most")
    order = F.xxhash64("doc_id")
    chosen = agreed.orderBy(order, "doc_id").limit(rows).select("doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.orderBy(order, "doc_id").select("text", F.col("label").cast("int").alias("label"))
