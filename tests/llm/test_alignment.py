"""Merge-path alignment against plain loops over whole texts and the libraries' own encodings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tallymatch.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "x", " x", "x ", "a  b", "a\n\nb c", "a \n b", "\ta b c d", "l'été c'est don't  we'll", "漢字 かな 한글",
    "▁ mark", "x▁y", "\x00 nul", "😀 😀😀  😀", "<|endoftext|> a <|endoftext|>", "<s> </s> <unk> <0x0A>", "a" * 5000, "ab " * 3000, " \n" * 50,
    "tab\tand  two\r\nlines", "1234567 89 3.14", "trailing  ", "\u0085next", "é combining", "﻿bom", "ﬁ ligature ①", "x　y z",
]


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(texts, tokenizers):
    """Rows by the definition, one token after the other."""
    known = al.coder(A, B)
    made, total = [], Counter()
    for text in texts:
        ids = [tokenizers[0].encode(" " + text, add_special_tokens=False).ids, tokenizers[1].encode(text)] if text else [[], []]
        whole = (" " + text).encode() if text else b""
        names = [known.a.bytes, known.b.bytes]
        if any(b"".join(names[k][i] for i in ids[k]) != whole for k in (0, 1)):
            ids = [[], []]
        ends = [np.cumsum([len(names[k][i]) for i in ids[k]]).tolist() for k in (0, 1)]
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(ids[0][ends[0].index(e)], ids[1][ends[1].index(e)]) for e in common] if len(common) < 400 else None
        if links is None:
            at = [dict(zip(ends[k], ids[k])) for k in (0, 1)]
            links = [(at[0][e], at[1][e]) for e in common]
        groups, start = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for i, x in zip(ids[k], ends[k]) if start < x <= e) for k in (0, 1)) if len(whole) < 3000 else None)
            start = e
        if None in groups:
            groups = list(_groups(ids, ends, common))
        total.update(links)
        made.append((len(ids[0]), len(ids[1]), links, ";".join(groups)))
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    return [
        (a, b, len(links), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links),
         hashlib.sha256(groups.encode()).hexdigest() if a else "")
        for a, b, links, groups in made
    ]


def _groups(ids, ends, common):
    at = [0, 0]
    for e in common:
        parts = []
        for k in (0, 1):
            stop = ends[k].index(e, at[k]) + 1
            parts.append(",".join(map(str, ids[k][at[k] : stop])))
            at[k] = stop
        yield "|".join(parts)


def rows_of(docs, work=al.WORK):
    got = al.alignment_digest(docs, A, B, work).collect()
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)


@pytest.mark.parametrize("work", [1, 2, 3, 7, 50, 4096])
def test_pieces_emit_each_shared_value_once(work):
    rng = random.Random(work)
    for _ in range(60):
        a = np.array(sorted(rng.sample(range(120), rng.randint(0, 60))), np.int64)
        b = np.array(sorted(rng.sample(range(120), rng.randint(0, 60))), np.int64)
        parts = list(al.pieces(a, b, work))
        assert all(p.a[1] - p.a[0] + p.b[1] - p.b[0] <= work for p in parts)
        assert sum(p.a[1] - p.a[0] for p in parts) == len(a) and sum(p.b[1] - p.b[0] for p in parts) == len(b)
        ends_a, ends_b = al.stitched(iter(parts))
        shared = np.intersect1d(a, b)
        assert a[ends_a - 1].tolist() == shared.tolist() == b[ends_b - 1].tolist()


def test_diagonals_cross_where_a_full_merge_stands():
    rng = random.Random(3)
    a, b = (np.array(sorted(rng.sample(range(400), k)), np.int64) for k in (150, 90))
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    diagonals = np.arange(241)
    expected = np.cumsum([0] + [s == 0 for _, s in merged])
    assert al.crossings(a, b, diagonals).tolist() == expected.tolist()


def test_units_are_what_both_libraries_make_of_whole_texts(tokenizers):
    known = al.coder(A, B)
    assert known.separable
    rng = random.Random(4)
    texts = [t for t in ODD if t] + ["".join(rng.choices([" ", "  ", "\n", "\t", "a", "é", "don't", "12", "漢", ".", " ", "x y"], k=30)) for _ in range(300)]
    for text in texts:
        units = known.units(text)
        known.learn([units])
        at = np.array([known.at[u] for u in units])
        assert known.ids(0, at)[0].tolist() == tokenizers[0].encode(" " + text, add_special_tokens=False).ids
        assert known.ids(1, at)[0].tolist() == tokenizers[1].encode(text)


@pytest.mark.parametrize("work", [5, 4096])
def test_rows_equal_plain_loops(spark, tokenizers, work):
    texts = [*ODD, None, ODD[10], "the same words again and the same words", "the same words again and the same words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as pairs", "1 as n")
    assert rows_of(docs, work) == [(i, *r) for i, r in enumerate(plain(texts, tokenizers))]


def test_query_equals_plain_loops_on_whole_table(spark, tokenizers):
    import __spark_entry__ as entry

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op12_tokenizer_alignment"](spark, "/root/testdata/sf0.001").collect()
    ours = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)
    assert ours == sorted((d.doc_id, *r) for d, r in zip(table, plain([d.text for d in table], tokenizers), strict=True))


def test_linked_pairs_stay_below_the_bound_of_the_vocabularies(spark):
    known = al.coder(A, B)
    aligned = al.alignments(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), A, B)
    pairs = [r.pair for r in al.pair_counts(aligned).collect()]
    assert 0 < len(pairs) == len(set(pairs)) < al.pair_bound(known.a.bytes, known.b.bytes) < 500_000
    assert all(
        known.a.bytes[p >> 32].endswith(known.b.bytes[p & 0xFFFFFFFF]) or known.b.bytes[p & 0xFFFFFFFF].endswith(known.a.bytes[p >> 32]) for p in pairs
    )


def test_units_are_forgotten_within_bounds(monkeypatch, tokenizers):
    monkeypatch.setattr(al, "REMEMBERED_UNITS", 10)
    known = al.UnitCoder(al.ByteLevelTokenizer(A), al.PieceTokenizer(B))
    for k in range(20):
        text = " ".join(f"word{k}x{i}" for i in range(8))
        found = al.align(known, [text, None, "", text])
        assert found.ids_a[: found.docs_a[1]].tolist() == tokenizers[0].encode(" " + text, add_special_tokens=False).ids
        assert len(known.at) <= 18


def test_odd_rows(messy, empty):
    got = rows_of(messy.where("doc_id is not null"))
    assert len(got) == messy.where("doc_id is not null").count()
    by = {r[0]: r for r in got}
    assert by[2][1:] == by[3][1:] == (0, 0, 0, 0, 0, 0, "") and by[1][1:] == by[6][1:] and by[5][1] > 40_000
    assert al.alignment_digest(messy, A, B).count() == messy.count()
    assert al.alignment_digest(empty, A, B).count() == 0
