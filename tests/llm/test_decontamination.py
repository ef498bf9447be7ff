"""Containment search against sets of shingles."""

from __future__ import annotations

import random
from dataclasses import replace

import duckdb
import pyarrow as pa
import pytest

from tallymatch.llm import decontamination as dc
from .test_near_dedup import WORD, shingles


def brute_force(docs, items, threshold=0.8):
    lengths = [min(len(WORD.findall((t or "").lower())), 5) for _, t in items]
    held = {n: [(i, set(shingles(t, n))) for i, t in docs] for n in set(lengths) - {0}}
    out = set()
    for (item, text), n in zip(items, lengths, strict=True):
        wanted = set(shingles(text, n))
        out |= {(i, item, len(wanted), len(wanted & s)) for i, s in held.get(n, []) if len(wanted & s) >= threshold * len(wanted)}
    return out


def found(df):
    return {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in df.collect()}


@pytest.mark.parametrize("part_shingles", [4_000_000, 60])
def test_equals_brute_force(spark, part_shingles):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([5, 6, 8, 9, 13, 14, 20, 40, 70, 150, 400, 3, 20])]
    docs = []
    for i in range(300):
        text = rng.choices(words, k=rng.randint(0, 900))
        if i % 2:
            own = items[rng.randrange(len(items))][1].split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            at = rng.randint(0, len(text))
            text[at:at] = own
        docs.append((i, " ".join(text)))
    docs += [(900, items[11][1]), (901, items[7][1].upper().replace(" ", ",\n"))]
    got = dc.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        replace(dc.ContainmentConfig(), part_shingles=part_shingles),
    )
    expected = brute_force(docs, items)
    assert len(expected) > 40 and found(got) == expected


def test_odd_rows(spark, messy, empty):
    items = spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "word"), (None, "lazy dog near the old river bank"), (1, "amet lorem ipsum dolor sit")],
        "item_id long, text string",
    ).selectExpr("*", "'x' as doc_id")
    got = sorted(((r.doc_id, r.item_id) for r in dc.contaminated(messy, items).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 6, None) for i in (1, None)] + [(5, 1), (7, 4)], key=str)
    clean = dc.drop_contaminated(messy, items)
    assert clean.columns == messy.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["2", "3", "4", "8", "8", "None"]
    none = items.limit(0)
    assert dc.contaminated(messy, none).count() == 0 and dc.drop_contaminated(messy, none).count() == messy.count()
    assert dc.contaminated(empty, items).count() == 0 and dc.drop_contaminated(empty, items).count() == 0


UNSPACED_TEXT = "人工智能正在改变我们的生活方式和工作方式，未来还会更快"


def mixed():
    """Documents and items in several scripts, items of one to four words among them, inside longer texts too."""
    docs = [
        (1, f"前言。{UNSPACED_TEXT}。后记很长很长"),
        (2, "ภาษาไทยเขียนติดกันไม่มีช่องว่าง and some English after it"),
        (3, "What is the capital of France? The capital is Paris, of course; Paris—not Lyon."),
        (4, "Paris"),
        (5, "«Réponse» : l’été dernier … à Paris\u00a0!"),
        (6, "nothing of the kind"),
        (7, "the capital"),
        (8, None),
    ]
    items = [(1, UNSPACED_TEXT), (2, "capital is Paris"), (3, "Paris"), (4, "ไทยเขียน"), (5, "été — dernier"), (6, "is Paris capital"), (7, "…"), (8, "改变")]
    return docs, items


@pytest.mark.parametrize("part_shingles", [4_000_000, 8])
def test_short_items_and_scripts(spark, part_shingles):
    docs, items = mixed()
    config = replace(dc.ContainmentConfig(), part_shingles=part_shingles)
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    got = found(dc.contaminated(*frames, config))
    assert got == brute_force(docs, items)
    assert {(d, i) for d, i, *_ in got} == {(1, 1), (1, 8), (2, 4), (3, 2), (3, 3), (4, 3), (5, 3), (5, 5)}
    kept = dc.drop_contaminated(frames[0], frames[1], config)
    assert sorted(r.doc_id for r in kept.collect()) == [6, 7, 8]
    with duckdb.connect() as db:
        for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
            db.register(name, pa.table({key: [i for i, _ in rows], "text": [t for _, t in rows]}))
        assert {r[:4] for r in db.execute(dc.SQL).fetchall()} == got


def test_one_part_at_a_time(spark, monkeypatch):
    """Of an index in many parts no more than one is on the executors, and its memory is released."""
    docs, items = mixed()
    alive, most, made = set(), [0], [0]
    broadcast = spark.sparkContext.broadcast

    def counted(value):
        shared = broadcast(value)
        if isinstance(value, dc.Index):
            alive.add(shared)
            most[0], made[0] = max(most[0], len(alive)), made[0] + 1
            destroy = shared.destroy
            monkeypatch.setattr(shared, "destroy", lambda: (alive.discard(shared), destroy()))
        return shared

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    config = replace(dc.ContainmentConfig(), part_shingles=8)
    frames = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    assert dc.contaminated(*frames, config).count() == 8
    assert made[0] > 3 and most[0] == 1
    alive.clear()
    assert dc.drop_contaminated(*frames, config).count() == 3 and most[0] == 1
