"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import public_tokenizers
import pytest

import corpus_pipeline
from tallymatch.llm import decontamination, near_dedup, secret_scan, storage, toxicity
from .conftest import SAMPLE

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_are_in_order():
    assert list(STAGES) == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "piece_coding"]


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(spark, messy, empty, name):
    out = STAGES[name](spark, messy, SAMPLE)
    rows = out.collect()
    if name == "piece_coding":
        assert len(rows) == messy.count()
    else:
        assert out.columns == messy.columns
        # clean documents stay; of exact copies and repeated rows one does
        left = {"minhash_near_dedup": ["1", "2", "3", "4", "5", "7", "8", "None", "None"]}
        assert sorted(str(r.doc_id) for r in rows) == sorted(left.get(name, [str(r.doc_id) for r in messy.collect()]))
    assert STAGES[name](spark, empty, SAMPLE).count() == 0


def test_decisions_take_effect(spark):
    docs = storage.table(spark, SAMPLE, "documents")
    labels, benchmark = storage.table(spark, SAMPLE, "labels"), storage.table(spark, SAMPLE, "benchmark")
    rejected = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("toxic").collect()}
    calm = storage.stored(STAGES["toxicity"](spark, docs, SAMPLE))
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in calm.collect()} == rejected
    kept = {r.doc_id for r in near_dedup.near_duplicates(calm).where("kept").collect()}
    single = storage.stored(STAGES["minhash_near_dedup"](spark, calm, SAMPLE))
    assert sorted(r.doc_id for r in single.collect()) == sorted(kept)
    leaks = {r.doc_id for r in decontamination.contaminated(single, benchmark).collect()}
    clean = storage.stored(STAGES["benchmark_decontamination"](spark, single, SAMPLE))
    assert leaks and {r.doc_id for r in clean.collect()} == kept - leaks
    masked = storage.stored(STAGES["secret_scan"](spark, clean, SAMPLE))
    assert masked.count() == clean.count()
    config = secret_scan.ScanConfig(vocabulary=public_tokenizers.path("piece_bpe_32k.model"))
    assert secret_scan.span_digest(secret_scan.secret_spans(masked, config)).where("spans <> ''").count() == 0
    assert masked.where(f"text like '%{secret_scan.MASK}%'").count() > 0
    coded = STAGES["piece_coding"](spark, masked, SAMPLE)
    assert coded.count() == len(kept - leaks) and coded.where("not round_trip").count() == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, SAMPLE).select("doc_id", "n_pieces").collect())) == sorted(
        map(tuple, coded.select("doc_id", "n_pieces").collect())
    )
