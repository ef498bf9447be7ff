"""Content-defined chunks: planted passages, shifts and odd rows."""

from __future__ import annotations

import random

import numpy as np

from tallymatch.llm import substring_dedup as sd
from tallymatch.llm import text as tx


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlué", k=rng.randint(1, 9))) for _ in range(n))


def test_chunks_make_up_the_texts_and_survive_insertions(spark, messy):
    rng = random.Random(9)
    whole = prose(rng, 3000)
    docs = spark.createDataFrame([(1, whole), (2, whole[:2000] + "INSERTED" + whole[2000:])], "doc_id long, text string")
    rows = sd.chunks(docs).toPandas().sort_values(["doc_id", "at"])
    for i, text in ((1, whole), (2, whole[:2000] + "INSERTED" + whole[2000:])):
        own = rows[rows.doc_id == i]
        assert "".join(text[a:b] for a, b in zip(own.begin, own.stop)) == text
    one, two = set(rows[rows.doc_id == 1].digest), set(rows[rows.doc_id == 2].digest)
    assert len(one - two) <= 6 and len(one & two) > 300
    odd = {r.doc_id: r.text or "" for r in messy.collect() if r.doc_id}
    chunks = sd.chunks(messy).toPandas()
    for i, text in odd.items():
        own = chunks[chunks.doc_id == i].drop_duplicates("at").sort_values("at")
        assert "".join(text[a:b] for a, b in zip(own.begin, own.stop)) == text


def test_cuts_depend_on_nearby_bytes_only():
    rng = np.random.default_rng(10)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    _, alone = sd.cuts(data, np.array([0, 5000]), sd.ChunkConfig())
    _, behind = sd.cuts(np.concatenate([data[:777], data]), np.array([0, 777, 5777]), sd.ChunkConfig())
    assert set(alone) == {e - 777 for e in behind if e > 777}


def test_passages_across_documents_are_found_and_others_not(spark):
    rng = random.Random(11)
    rows = []
    for i in range(80):
        passage = prose(rng, rng.randint(51, 90))
        rows += [(2 * i, f"{prose(rng, rng.randint(0, 300))} {passage} {prose(rng, 100)}"), (2 * i + 1, f"{prose(rng, 50)} {passage}")]
    line = prose(rng, 12)
    rows += [(1000 + i, f"{prose(rng, 200)}\n{line}\n{prose(rng, 100)}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as at", "'x' as digest")
    spans = sd.repeated_passages(docs).collect()
    assert {r.doc_id for r in spans} == set(range(160))
    clean = {r.doc_id: r.text for r in sd.drop_duplicates(docs).collect()}
    texts = dict(rows)
    assert all(clean[i] == texts[i] for i in texts if i >= 1000 or i % 2 == 0)
    assert all(len(clean[i]) < len(texts[i]) - 80 for i in range(1, 160, 2))


def test_repetitive_passages_are_found_in_any_context(spark):
    rng = random.Random(12)
    rows = []
    for phrase in ("a", "as", "of.", "enau", "thoution", "Wort ü", "in the", "x" * 30, "one two three four five", prose(rng, 7)):
        for n in (51, 60, 400):
            passage = " ".join([phrase] * -(-n // len(phrase.split())))
            for _ in range(3):
                before, after = prose(rng, rng.randint(0, 40)), prose(rng, rng.randint(0, 40))
                rows.append((len(rows), f"{before}. {passage}. {after}", len(before) + 2, len(before) + 2 + len(passage)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, first long, last long")
    spans = sd.repeated_passages(docs.select("doc_id", "text")).toPandas()
    for i, _, first, last in rows:
        own = spans[spans.doc_id == i]
        assert ((own.begin < last) & (own.stop > first)).any(), rows[i]
    chunks = sd.chunks(docs.select("doc_id", "text")).toPandas()
    assert (chunks.stop - chunks.begin).max() <= 128


def test_inner_cuts_do_not_depend_on_where_a_text_stands():
    texts = [" ".join([w] * 90).encode() for w in ("a", "of.", "thoution", "y" * 300, "漢字")]
    alone = [np.frombuffer(t, np.uint8) for t in texts]
    sizes = np.cumsum([0, *map(len, alone)])
    _, together = sd.cuts(np.concatenate(alone), sizes, sd.ChunkConfig())
    for data, at in zip(alone, sizes, strict=False):
        _, ends = sd.cuts(data, np.array([0, len(data)]), sd.ChunkConfig())
        assert set(ends) == {e - at for e in together if at < e <= at + len(data)}


def test_odd_rows(messy, empty):
    spans = sd.repeated_passages(messy).collect()
    assert {r.doc_id for r in spans} <= {1, 5, 6, None}
    assert all(r.begin < r.stop and r.n_words >= 20 for r in spans)
    assert sd.repeated_passages(empty).count() == 0
    clean = sd.drop_duplicates(messy)
    assert clean.columns == messy.columns and clean.count() == messy.count()
    assert sd.drop_duplicates(empty).count() == 0


def test_word_hashes():
    texts = ["The quick brown fox", "", "the  QUICK-brown, fox", None, "y" * 700_000 + " z", "z"]
    import pyarrow as pa

    hashes, offsets = tx.words(*tx.utf8(pa.array(texts, pa.large_string())))
    assert np.diff(offsets).tolist() == [4, 0, 4, 0, 2, 1]
    assert (hashes[:4] == hashes[4:8]).all() and hashes[9] == hashes[10]


def test_each_text_of_a_doc_id_is_a_document(spark):
    """One of two texts of a doc_id, and one of two without doc_id, holds a repeated passage: the others lose nothing."""
    rng = random.Random(13)
    passage = prose(rng, 90)
    other, alone = prose(rng, 300), prose(rng, 200)
    rows = [(1, f"{prose(rng, 60)} {passage} {prose(rng, 60)}"), (2, f"{prose(rng, 30)} {passage}"), (2, other), (None, f"{passage} {prose(rng, 9)}"), (None, alone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = sd.repeated_passages(docs).collect()
    assert sorted(str(r.doc_id) for r in spans) == ["1", "2", "None"] and len({r.content for r in spans}) == 3
    clean = [r.text for r in sd.drop_duplicates(docs).collect()]
    # whichever comes first keeps the passage; texts without it stay whole
    assert other in clean and alone in clean and sum(len(x) for x in clean) < sum(len(t) for _, t in rows) - 2 * (len(passage) - 60)


def test_passages_of_a_whole_table_equal_plain_loops(spark):
    """Chunks of each text by itself, counted in a dictionary, and runs of those that repeat."""
    import pyarrow as pa
    from collections import Counter

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    cut = {}
    for r in table.collect():
        data, offsets = tx.utf8(pa.array([r.text], pa.large_string()), lower=False)
        starts, ends = sd.cuts(data, offsets, sd.ChunkConfig())
        raw = data.tobytes()
        cut[r.doc_id] = [raw[a:b] for a, b in zip(starts, ends)]
    counts = Counter(c for chunks in cut.values() for c in chunks)
    expected = set()
    for doc, chunks in cut.items():
        at, run, begin = 0, [], 0
        for chunk in [*chunks, None]:
            if chunk is not None and counts[chunk] > 1:
                begin = at if not run else begin
                run.append(chunk)
            else:
                whole = b"".join(run)
                heads, _ = tx.word_spans(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))
                # a word that goes on across the run's first border began before it: words differ by one at most
                if run and len(heads) >= 22:
                    expected.add((doc, begin, at))
                run = []
            at += len(chunk.decode()) if chunk is not None else 0
    got = {(r.doc_id, r.begin, r.stop): r.n_words for r in sd.repeated_passages(table).collect()}
    assert expected <= set(got) and len(expected) > 5
    assert all(n <= 24 for k, n in got.items() if k not in expected)


def test_passages_without_spaces_are_found(spark):
    rng = random.Random(14)
    passage = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(200))
    docs = spark.createDataFrame([(1, prose(rng, 90) + passage), (2, passage + prose(rng, 70)), (3, prose(rng, 300))], "doc_id long, text string")
    spans = {r.doc_id: r for r in sd.repeated_passages(docs).collect()}
    assert set(spans) == {1, 2} and all(r.n_words > 150 for r in spans.values())
    assert spans[2].begin < 40 and 160 < spans[2].stop <= 200
