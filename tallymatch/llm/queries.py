"""The numbered operators as queries over the corpus tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallymatch.llm import (
    alignment,
    decontamination,
    embedding_dedup,
    license_scan,
    near_dedup,
    piece_coding,
    quality,
    secret_scan,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
    whitening,
)
from tallymatch.llm.storage import on_executors, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(run: Query) -> Query:
    """Register a query under its own name; it sends the package to the executors first."""

    @wraps(run)
    def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
        on_executors(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = sent
    return sent


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))



@query
def op1_lattice_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = secret_scan.ScanConfig(vocabulary=public_tokenizers.path("piece_bpe_32k.model"))
    return secret_scan.span_digest(secret_scan.secret_spans(table(spark, sf_dir, "documents"), config))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))



@query
def op5_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_coding.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_statements(table(spark, sf_dir, "documents"))


@query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(table(spark, sf_dir, "documents"))


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignment_digest(table(spark, sf_dir, "documents"), *paths)


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


SQL |= {"op1_lattice_embedding_dedup": embedding_dedup.SQL, "op2_benchmark_decontamination": decontamination.SQL}
