"""Secret scan against plain searches, guess costs against all segmentations."""

from __future__ import annotations

import hashlib
import math
import re

import public_tokenizers
import pytest

from tallymatch.llm import secret_scan as ss


WORDS = public_tokenizers.path("piece_bpe_32k.model")


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


TEXTS = [
    'é token = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71" PassWord=short api_key:Zz81-kfiq_aPq AKIAAKIA1234 AKIA1234567890123',
    "token: secret: abcdefgh12 ſecret=abcdefgh1 toKen'='abcdefgh",
    "x" * 40 + "deadbeef" * 9 + " passphrase is kV9$xq2!Lp, pwd: qwerty123456 credential => changeme1 bearer: hunter2zQ9x",
    "",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_equal_plain_searches(text):
    found = [s for s in ss.scan(text) if s[0] != "guess"]
    assert ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in found) == base_spans(text)


def test_only_values_that_are_hard_to_guess_are_added():
    text = TEXTS[2]
    assert [text[a:b] for k, a, b, *_ in ss.scan(text) if k == "guess"] == ["kV9$xq2!Lp", "hunter2zQ9x"]
    for weak in ("password123", "qwertyuiop", "xxxxxxxxxxxx", "changeme", "Summer2024", "P@ssw0rd", "2023-11-05"):
        assert ss.segments(weak)[0] < 8, weak
    assert [k for k, *_ in ss.segments("summer2024xxxxqwerty")[1]] == ["word", "date", "repeat", "walk"]
    assert ss.segments("a" * 50_000)[0] < 8


SUBJECTS = ("The password", "Your token", "Her secret", "Das passwd", "The API key", "Our passphrase", "La credential", "This bearer", "The access key", "The pwd")
PREDICATES = (
    "is required for every account", "was incorrect, as they discovered", "is sometimes forgotten", "is generated automatically by the server",
    "was verschlüsselt gespeichert worden",
)


def test_sentences_have_no_span():
    config = ss.ScanConfig(vocabulary=WORDS)
    sentences = [f"{a} {b}." for a in SUBJECTS for b in PREDICATES]
    assert len(sentences) == 50 and [x for x in sentences if ss.scan(x, config)] == []
    for text in ("credentials: available on request", "The passphrase: unavailable", "access key: unfortunately missing"):
        assert ss.scan(text, config) == []
    # what follows "is" and no word explains is still found
    assert [text[a:b] for text in ["the password is kV9$xq2!Lp now"] for _, a, b, *_ in ss.scan(text, config)] == ["kV9$xq2!Lp"]


def test_words_of_the_vocabulary_and_repeated_blocks_are_cheap():
    assert ss.segments("correcthorsebatterystaple", WORDS)[0] < 22 < ss.segments("correcthorsebatterystaple")[0]
    assert ss.segments("unavailable", WORDS)[0] < 8
    for value in ("abcabcabcabcabc", "xkxkxkxkxk", "q7zq7zq7zq7z", "password1password1password1"):
        assert ss.segments(value)[0] < 8, value
        assert ss.segments(value)[1][-1][0] == "repeat"
    assert ss.segments("ab" * 50_000)[0] < 8


def every_cost(value, i=0, brute=False):
    """Cheapest way to make value[i:], by trying all."""
    if i == len(value):
        return 0.0
    best = ss._alphabet(value[i]) + (0 if brute else 0.3) + every_cost(value, i + 1, True)
    for j in range(i + 3, len(value) + 1):
        part = value[i:j]
        if part in ss.ranks()[0]:
            best = min(best, math.log10(ss.ranks()[0][part] + 1) + 0.3 + every_cost(value, j))
    return best


@pytest.mark.parametrize("value", ["zcatq", "lovecat", "dogtestx", "xqzjv", "adminadmi"])
def test_segmentation_is_the_cheapest(value):
    assert ss.segments(value)[0] == pytest.approx(every_cost(value))


def test_query_columns(documents, messy, empty):
    rows = {r.doc_id: r for r in ss.span_digest(ss.secret_spans(documents)).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        base = base_spans(t)
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(base.count(k) for k in ("assign:", "access:", "hex:"))
    assert sum(r.n_assign for r in rows.values()) > 0
    odd = ss.span_digest(ss.secret_spans(messy)).collect()
    assert len(odd) == messy.count() and {r.spans for r in odd} == {""}
    assert ss.secret_spans(empty).count() == 0 and ss.mask_secrets(empty).count() == 0


def test_masking(spark, messy):
    docs = spark.createDataFrame([(1, TEXTS[0], 5), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in ss.mask_secrets(docs).collect()}
    assert "abe29" not in rows[1].text and "AKIA1234567890123" not in rows[1].text and "PassWord=short" in rows[1].text
    assert rows[1].n_chars == len(rows[1].text) and rows[2].text is None and rows[3].text == "clean"
    assert ss.mask_secrets(messy).exceptAll(messy).count() == 0
