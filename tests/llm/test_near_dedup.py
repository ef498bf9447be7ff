"""DartMinHash near-dedup against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
import regex

from tallymatch.llm import near_dedup as nd
from tallymatch.llm.graph import components


UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = regex.compile(rf"[{UNSPACED}]|(?:[a-z0-9_]|[^\x00-\x7f\p{{P}}\p{{Z}}\p{{Cc}}{UNSPACED}])+")


def shingles(text, size=5):
    words = WORD.findall((text or "").lower())
    return Counter(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1 if words else 0)))


def brute_force(rows, threshold=0.8):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for a, b in {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}:
        common = sum((sets[a] & sets[b]).values())
        if common >= threshold * (sum(sets[a].values()) + sum(sets[b].values()) - common):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def found(df):
    return {r.doc_id: r.component_id for r in df.collect()}


def test_estimates_are_those_of_weighted_sets():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(30):
        a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
        b = np.concatenate([rng.integers(0, 1 << 62, 60).astype(np.uint64), a[60:]])
        weight = rng.uniform(0.2, 4, 400)
        signature = nd.dart_minhash(np.repeat([0, 1], 400), np.r_[a, b], np.r_[weight, weight], 2, 128)
        off.append((signature[0] == signature[1]).mean() - weight[60:].sum() / (weight.sum() + weight[:60].sum()))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06
    assert (nd.dart_minhash(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0), 1, 8) == nd.EMPTY).all()


@pytest.mark.parametrize("block_rows", [256, 16])
def test_components_equal_brute_force(spark, block_rows):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(120):  # one large group whose members are alike to very different degrees
        text = list(base)
        for _ in range(rng.randint(0, 8)):
            text[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(rng.choices(words, k=80))) for i in range(40)] + [(2000 + i, rows[0][1].upper() + " !") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(docs, replace(nd.NearConfig(), block_rows=block_rows))) == brute_force(rows)


def test_sample_equals_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert found(nd.near_duplicates(documents)) == brute_force(rows)


def test_odd_rows(messy, empty):
    rows = nd.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[6].component_id == 1 and not by[6].kept and by[1].kept
    assert all(by[i].kept and by[i].component_id == i for i in (2, 3, 4, 5, 7, 8))
    assert [r.kept for r in rows if r.doc_id is None] == [True, True]
    kept = nd.keep_one_per_group(messy)
    assert kept.columns == messy.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8]
    assert nd.near_duplicates(empty).count() == 0 and nd.keep_one_per_group(empty).count() == 0


def test_each_text_of_a_doc_id_counts(spark):
    rng = random.Random(8)
    one, two, three, four = (" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(4))
    rows = [(1, one), (2, two), (2, three), (2, three.upper()), (3, one + " more"), (4, two + " more"), (5, three + " more"), (6, four), (6, one + " and"), (7, four)]
    rows += [(8, "alone " + four[::-1]), (8, "alone " + four[::-1] + " more"), (9, None), (9, "words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted({(r.doc_id, r.component_id) for r in nd.near_duplicates(docs).collect()})
    assert got == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 2), (6, 1), (6, 6), (7, 6), (8, 8), (9, 9)]
    kept = [(r.doc_id, r.text) for r in nd.keep_one_per_group(docs).collect()]
    assert sorted(i for i, _ in kept) == [1, 2, 2, 6, 8, 9, 9] and set(kept) <= set(rows)
    texts = {(t or "").lower() for _, t in kept}
    assert {one, two, three, four, "", "words"} <= texts


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    made = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in made.collect()} == {i: root(i) for a, b in edges if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unspaced_scripts(spark):
    rng = random.Random(12)
    first = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(2000))
    thai = "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(300))
    rows = [
        (1, first),
        (2, first[:700] + "。" + first[701:]),
        (3, "".join(rng.sample(first, len(first)))),
        (4, thai),
        (5, thai[:150] + "ก" + thai[150:]),
        (6, "‘Une phrase’ — où les guillemets «changent», rien d’autre…"),
        (7, "Une phrase où les guillemets changent rien d autre"),
    ]
    got = found(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_force(rows) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6}
