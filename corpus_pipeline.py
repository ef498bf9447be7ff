"""The corpus pipeline: documents in, encoded clean documents out, one written table between the stages.

Each stage works on the rows its predecessor kept. All but the last return the columns they were given. Nulls, empty
texts, repeated rows and empty tables have the results that the operators define; empty texts pass through all filters.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallymatch.llm import decontamination, near_dedup, piece_coding, secret_scan, toxicity
from tallymatch.llm.storage import on_executors, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, trained on ``labels`` of these documents, rejects go."""
    on_executors(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies stays."""
    on_executors(spark)
    return near_dedup.keep_one_per_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    on_executors(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with secret values masked in ``text``."""
    on_executors(spark)
    return secret_scan.mask_secrets(docs, secret_scan.ScanConfig(vocabulary=public_tokenizers.path("piece_bpe_32k.model")))


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, round_trip and ids of every document."""
    on_executors(spark)
    return piece_coding.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("piece_coding", as_pieces),
]

#: Trained models and signatures have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
