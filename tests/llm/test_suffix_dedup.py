"""Removal of repeated strings against a plain count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallymatch.llm import suffix_dedup as sd
from tallymatch.llm import text as tx

SMALL = sd.SuffixConfig(length=20, seed=6, branch=3)


def brute(texts, length):
    """n_bytes, n_removed, n_spans, kept_sha256 of each text from all its windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        covered = np.cumsum(gone)[:-1] > 0 if len(d) else np.zeros(0, bool)
        kept = bytes(b for b, g in zip(d, covered, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], covered.view(np.int8)])) == 1).sum())
        out.append((len(d), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def found(docs, config):
    rows = sd.removal_digest(docs, config).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)


def expected(rows, length):
    texts = [t for _, t in rows]
    return sorted((i if i is not None else -1, *b) for (i, _), b in zip(rows, brute(texts, length), strict=True))


@pytest.mark.parametrize(("seed", "config"), [(1, SMALL), (2, sd.SuffixConfig(12, 12, 2)), (3, sd.SuffixConfig(31, 4, 7))])
def test_random_repeats_equal_brute_force(spark, seed, config):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcdé", k=rng.randint(5, 70))) for _ in range(12)]
    rows = []
    for i in range(120):
        kind = rng.random()
        if kind < 0.5:
            text = "".join(rng.choice([rng.choice(passages), "".join(rng.choices("abé漢", k=rng.randint(0, 30)))]) for _ in range(rng.randint(0, 6)))
        elif kind < 0.7:
            text = "".join(rng.choices("xyzuvw", k=rng.randint(0, 200)))
        elif kind < 0.8:
            text = rng.choice(["a", "ab", "abc", "é"]) * rng.randint(0, 60)
        else:
            base = list(passages[0] * 3 + passages[1])
            base[rng.randrange(len(base))] = "#"
            text = "".join(base)
        rows.append((rng.choice([None, i, i, i, 7]), text))
    rows += [(500, rows[3][1]), (500, rows[3][1]), (501, None), (502, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, config) == expected(rows, config.length)


def test_stretches_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(sd, "_STRETCH", 256)
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=k)) for k in (3, 100, 3000, 19, 0, 20, 513, 1200)]
    data, offsets = tx.utf8(pa.array(texts), lower=False)
    windows = []
    for first, last, low, high in sd._stretches(offsets, SMALL):
        inside = np.clip(offsets[first : last + 1] - low, 0, high - low)
        of, place, near, far, _ = sd.anchors(data[low:high], inside, SMALL)
        windows += [(first + o, p + low - d - offsets[first + o]) for o, p, a, b in zip(of, place, near, far) for d in range(a, b + 1)]
    assert sorted(windows) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - SMALL.length + 1)]


def test_spans_of_long_texts_across_stretches(spark):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh ", k=1_300_000))
    part = long[700_000:701_000]
    rows = [(1, long), (2, "x" * 50 + part + "y" * 50), (3, "unrelated " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sd.removal_digest(docs).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (1000, 1) and (got[2].n_removed, got[2].n_spans) == (1000, 1)
    assert got[1].kept_sha256 == hashlib.sha256((long[:700_000] + long[701_000:]).encode()).hexdigest()
    assert got[3].n_removed == 0


def test_one_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(7)
    passage = "".join(rng.choices("abcdefgh ", k=90))
    rows = [(i, "".join(rng.choices("mnopqrst", k=60)) + (passage if i % 3 == 0 else "") + "".join(rng.choices("mnopqrst", k=60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, SMALL) == expected(rows, 20)


def test_odd_rows(messy, empty):
    got = sd.removal_digest(messy).collect()
    assert len(got) == messy.count()
    clean = sd.drop_repeats(messy)
    assert clean.columns == messy.columns and clean.count() == messy.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].n_removed > by[5].n_bytes - 400 and by[5].n_spans == 1 and by[1].n_removed == 0
    assert sd.removal_digest(empty).count() == 0 and sd.drop_repeats(empty).count() == 0


def test_query_equals_brute_force_on_whole_table(spark):
    import __spark_entry__ as entry

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = entry.queries()["op11_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    ours = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert ours == expected(rows, 400)
