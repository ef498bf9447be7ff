"""Held-out accuracy and odd rows of the trained operators."""

from __future__ import annotations

import zlib
from dataclasses import replace

import numpy as np
import pytest

from tallymatch.llm import license_scan as ls
from tallymatch.llm import quality, toxicity


def area(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_quality_on_held_out_rows(documents, labels):
    rows = quality.score_quality(documents, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert ((rows.doc_id.map(lambda i: zlib.crc32(str(i).encode())) % 5 == 0) == rows.held_out).all()
    held = rows[rows.held_out]
    assert len(held) > 40 and area(held.quality.to_numpy(), held.score.to_numpy()) > 0.95
    assert ((held.score >= 0.3) == held.predicted).all() and (held.predicted == held.quality).mean() > 0.9


def test_quality_never_learns_from_held_out_labels(documents, labels):
    flipped = labels.selectExpr("doc_id", f"if({quality.HELD_OUT}, 1 - quality, quality) as quality", "toxic")
    small = replace(quality.QualityConfig(), epochs=1, train_rows=60)
    assert (quality.train(documents, labels, small).weight == quality.train(documents, flipped, small).weight).all()


def test_quality_of_odd_rows(messy, empty, labels, no_labels):
    small = replace(quality.QualityConfig(), epochs=1)
    rows = quality.score_quality(messy, labels, small).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.score for r in quality.score_quality(messy, no_labels, small).collect()} == {0.5}
    assert quality.score_quality(empty, labels, small).count() == 0


def test_toxicity_on_texts_not_trained_on(documents, labels):
    rest = labels.where("doc_id % 4 <> 0")
    rows = toxicity.score_toxicity(documents, rest).toPandas().merge(labels.toPandas(), on="doc_id", suffixes=("", "_label"))
    unseen = rows[rows.doc_id % 4 == 0]
    assert unseen.toxic[unseen.toxic_label == 0].mean() < 0.02
    assert rows.toxic[rows.toxic_label == 1].mean() > 0.9
    assert area(unseen.toxic_label.to_numpy(), unseen.p_toxic.to_numpy()) > 0.85


def test_each_link_gets_the_earlier_ones():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 200, 30)).astype(np.uint64) for _ in range(300)]
    marked = np.array([(s < 5).any() for s in sets])
    model = toxicity.fit(sets, marked.astype(float), toxicity.ToxicityConfig())
    assert [len(w) for w, _ in model.links] == [len(model.vocabulary) + i for i in range(len(toxicity.ToxicityConfig().categories))]
    present = np.stack([np.isin(model.vocabulary, s) for s in sets]).astype(np.float32)
    assert ((model.probabilities(present)[:, -1] > 0.5) == marked).mean() > 0.98


def test_groups_are_found_again_without_lists():
    rng = np.random.default_rng(5)
    kind = rng.choice([-1, 0, 1, 2], 600, p=[0.7, 0.15, 0.1, 0.05])
    present = (rng.random((600, 60)) < 0.1).astype(np.float32)
    for k in range(3):
        present[kind == k, 40 + 6 * k : 46 + 6 * k] = (rng.random(((kind == k).sum(), 6)) < 0.7).astype(np.float32)
        present[kind != k, 40 + 6 * k : 46 + 6 * k] = 0
    group = toxicity.toxic_groups(present, kind >= 0, replace(toxicity.ToxicityConfig(), groups=3))
    assert (group[kind < 0] == -1).all() and (group[kind >= 0] == kind[kind >= 0]).mean() > 0.9
    assert (toxicity.toxic_groups(present.copy(), kind >= 0, replace(toxicity.ToxicityConfig(), groups=3)) == group).all()


def test_groups_of_few_texts():
    config = toxicity.ToxicityConfig()
    present = np.eye(4, dtype=np.float32)
    assert toxicity.toxic_groups(present, np.array([1, 0, 0, 0], bool), config).tolist() == [0, -1, -1, -1]
    assert toxicity.toxic_groups(present, np.zeros(4, bool), config).tolist() == [-1] * 4
    assert toxicity.toxic_groups(np.zeros((4, 0), np.float32), np.ones(4, bool), config).tolist() == [-1] * 4
    assert set(toxicity.toxic_groups(np.ones((4, 2), np.float32), np.array([1, 1, 1, 0], bool), config)) == {-1}
    # equal texts are one group
    same = toxicity.toxic_groups(np.array([[1, 0], [1, 0], [0, 1]], np.float32), np.array([1, 1, 0], bool), config)
    assert same.tolist() == [0, 0, -1]


def test_toxicity_by_language_on_texts_not_trained_on(spark):
    tables = {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")}
    rows = toxicity.score_toxicity(tables["documents"], tables["labels"].where("doc_id % 3 <> 0"))
    rows = rows.where("doc_id % 3 = 0").toPandas().merge(tables["labels"].toPandas(), on="doc_id", suffixes=("", "_label"))
    rows = rows.merge(tables["documents"].select("doc_id", "lang").toPandas(), on="doc_id")
    for lang, part in rows.groupby("lang"):
        toxic = part.toxic_label == 1
        assert part.toxic[~toxic].mean() < 0.02, lang
        if toxic.sum() >= 5:
            assert area(part.toxic_label.to_numpy(), part.p_toxic.to_numpy()) > 0.85, lang


def test_toxicity_of_odd_rows(messy, empty, labels, no_labels, documents):
    rows = toxicity.score_toxicity(messy, labels).collect()
    assert len(rows) == messy.count() and all(0 <= r.p_toxic <= 1 for r in rows)
    assert {r.toxic for r in toxicity.score_toxicity(messy, no_labels).collect()} == {False}
    assert toxicity.drop_toxic(messy, no_labels).exceptAll(messy).count() == 0
    assert toxicity.drop_toxic(messy, no_labels).count() == messy.count()
    assert toxicity.score_toxicity(empty, labels).count() == 0 and toxicity.drop_toxic(empty, labels).count() == 0


STATEMENTS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Copyright 2021 Somebody. Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "(c) 2020 The Press. All rights reserved.",
}


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_licences(spark, sample, messy, empty):
    rows = [(i, f"Some words first.\n{t}\nand the version of this was in general provided.") for i, t in enumerate(STATEMENTS.values())]
    rows += [(50, "Distributed under the terms of a license of our own."), (51, None), (52, "The general public met at the release.")]
    docs = sample.select("doc_id", "text").where("doc_id >= 100").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = ls.license_statements(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    got = {(r.doc_id, r.paragraph): r for r in found.collect()}
    for i, (family, text) in enumerate(STATEMENTS.items()):
        r = got.pop((i, 1))
        assert (r.family, r.confirmed) == (family, True) and rows[i][1][r.begin : r.stop] == text
    assert got.pop((50, 0)).family == ls.UNKNOWN
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id >= 100}
    marks = ("Apache License, Version", "MIT License", "General Public License", "CC BY-NC", "All rights reserved")
    expected = {(i, k) for i, t in texts.items() for k, line in enumerate((t or "").split("\n")) if any(m in line for m in marks)}
    assert set(got) == expected and len(expected) > 10


def test_licences_of_odd_rows(messy, empty):
    assert ls.license_statements(messy).count() == 0
    assert ls.license_statements(empty).count() == 0
