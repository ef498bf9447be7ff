"""Piece coding and token counts against their libraries."""

from __future__ import annotations

import random
import time

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallymatch.llm import piece_coding as pc
from tallymatch.llm import token_counts as tc

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a ", " a", "a  b", "x\ny\n\n z \n", "é漢😀\x00", "a▁b", "<s> </s> <0x41>", "   deep\n    indent", "<|endoftext|>x<|endof"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def both(library, texts):
    encoder = pc.Encoder(pc.load(PIECES))
    encoder.learn(texts)
    ids, offsets = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library.encode(texts)
    assert pc.decode(encoder.model, ids, offsets) == [t.replace(pc.MARK, " ") for t in texts]


def test_pieces_equal_the_library(library, documents):
    rng = random.Random(7)
    known = [p.replace(pc.MARK, " ") for p in pc.load(PIECES).ids]
    mixed = ["".join(rng.choices(known, k=rng.randint(1, 20))) for _ in range(2000)]
    both(library, ODD + mixed + [r.text for r in documents.limit(150).collect()])


def test_long_units_are_coded_like_the_library_and_in_time(library):
    rng = random.Random(13)
    texts = ["".join(rng.choices("etaoinshrdlcu", k=n)) for n in (4096, 4097, 40_000)]
    both(library, [*texts, " " * 5000 + "x", "ab" * 3000, "漢字é" * 2000, "0" * 4100 + "\x00", " " * 9001])
    model = pc.load(PIECES)
    started = time.process_time()
    model.encode_units(["".join(rng.choices("etaoinshrdlcu", k=100_000))])
    assert time.process_time() - started < 10


def test_runs_of_spaces_are_coded_like_the_library(library):
    words = ["", "x", "the", "'s", "漢", "\x00", "12", "Öl", "_", "(", "[]", "#"]
    both(library, [" " * k + w for k in range(70) for w in words] + ["a" + " " * k + "b\n" + " " * (69 - k) + "c" for k in range(70)])


def test_spaces_and_long_units_don_t_leave_the_pass(monkeypatch):
    model = pc.load(PIECES)
    monkeypatch.setattr(pc.PieceModel, "merged", None)
    ids, sizes = model.encode_units([pc.MARK * 5 + "if", pc.MARK * 40, "ab" * 3000])
    assert sizes.min() > 0 and len(ids) == sizes.sum()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdehilnorst .,\né漢'<|>0", max_size=60), max_size=8))
def test_any_text_is_coded_like_the_library(texts):
    both(sentencepiece.SentencePieceProcessor(model_file=PIECES), texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", " ", "  ", "\n", "'s", "!", "<|endoftext|>", "<|", "é", "漢", "😀", "12", " the"]), max_size=300), st.integers(8, 80), st.integers(1, 40))
def test_spliced_chunks_equal_the_whole(parts, chunk, overlap):
    tokenizer, text = tc.load(BYTES), "".join(parts)
    whole = tokenizer.encode(text, add_special_tokens=False).ids
    assert tc.encode_long(tokenizer, text, tc.ResyncConfig(chunk=chunk, overlap=overlap)) == whole


def test_runs_without_a_cut_widen_the_overlap():
    tokenizer = tc.load(BYTES)
    for text in ("a" * 5000, " " * 3000 + "b", "ab " * 40 + "x" * 900 + " cd" * 40):
        assert tc.encode_long(tokenizer, text, tc.ResyncConfig(chunk=64, overlap=8)) == tokenizer.encode(text).ids


def test_counts_of_documents(documents, messy, empty):
    tokenizer = tc.load(BYTES)
    small = tc.ResyncConfig(chunk=700, overlap=64)
    rows = {r.doc_id: r for r in tc.encoded(documents, BYTES, small).collect()}
    for d in documents.limit(300).collect():
        whole = tokenizer.encode(d.text, add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert (r.ids, r.n_tokens, r.n_bytes, r.over_limit) == (whole, len(whole), len(d.text.encode()), len(whole) > 1024)
    odd = tc.token_counts(messy, BYTES).collect()
    assert len(odd) == messy.count() and {r.n_tokens for r in odd if r.doc_id in (2, 3)} == {0}
    assert next(r.over_limit for r in odd if r.doc_id == 5)
    assert tc.token_counts(empty, BYTES).count() == 0


def test_piece_rows(messy, empty):
    rows = pc.encoded(messy, PIECES)
    found = rows.collect()
    assert len(found) == messy.count() and all(r.round_trip and r.n_pieces == len(r.ids) for r in found)
    assert {r.n_pieces for r in found if r.doc_id in (2, 3)} == {0}
    back = {r.doc_id: r.text for r in pc.decoded(rows, PIECES).collect()}
    assert back[1].startswith("The quick") and back[2] == "" and back[8] == "été漢字   \x00 😀"
    assert pc.encoded(empty, PIECES).count() == 0
