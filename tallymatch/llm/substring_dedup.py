"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text; where its upper bits are zero a chunk ends. The hash depends on the last 16
bytes alone, so after an insertion the cuts fall into step again and a passage is cut in the same way wherever it
stands. Chunks are compared by digest. Runs of adjacent chunks that also occur elsewhere are repeated passages, if they
have enough words; single chunks that agree by chance are not. The first occurrence of a chunk, by doc_id and place, is
its original and all others can go.

Cuts closer than ``least`` bytes to the one before are ignored; this looks at the nearby bytes only, so it keeps in step,
too. Text that says one word or phrase over and over often has no cut in its period, or only cuts that are too close.
Stretches of more than ``most`` bytes, and shorter ones that repeat a window, are therefore cut by content as well: at the
last of the least hashes among any ``spacing`` places. In periodic text that is one place a period. Of those closer than
``least`` bytes as many are passed over as it takes, which leaves equal chunks wherever the text began.

Defined results: null and empty texts have no chunk; places are in code points, end exclusive. A document is a doc_id with
a text, told by the hash of the text (``content``): rows that repeat both repeat each other's passages and are returned as
one document; each text of a doc_id has its own passages and loses only them; so has each text without doc_id. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch.llm import text as tx
from tallymatch.llm.membership import maybe_in
from tallymatch.llm.storage import stored
from tallymatch.llm.suffix_dedup import Spans
from tallymatch.operators.lookup import lookup

WINDOW = 16
_GEAR = (tx.mix(np.arange(1, 257, dtype=np.uint64) * tx.GOLDEN) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class ChunkConfig:
    """A cut is made at one of ``spacing`` places (a power of two). Chunks of ordinary text hold some 24 bytes, so a passage of over 50
    words keeps far more than ``words`` words between its first and last cut."""

    spacing: int = 16
    least: int = 8
    most: int = 128
    words: int = 20


def cuts(data: np.ndarray, offsets: np.ndarray, config: ChunkConfig) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all chunks in bytes. A chunk never spans two texts and never splits a character."""
    n = len(data)
    hashed = _GEAR[data]
    reach = 1
    while reach < WINDOW:
        hashed[reach:] += hashed[:-reach] << np.uint32(reach)  # hash of the last 2 * reach bytes
        reach *= 2
    upper = (hashed >> np.uint32(WINDOW - config.spacing.bit_length() + 1)) & np.uint32(config.spacing - 1)
    whole = np.ones(n + 1, bool)
    whole[:n] = (data & 0xC0) != 0x80
    ends = np.flatnonzero((upper == 0) & whole[1:]) + 1
    # the window must not reach into the text before
    of = np.searchsorted(offsets, ends, "left") - 1
    ends = ends[ends - offsets[of] >= WINDOW]
    close = np.zeros(len(ends), bool)
    close[1:] = np.diff(ends) < config.least
    ends = np.union1d(ends[~close], offsets[1:])
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    ends = np.union1d(ends, _inner_cuts(hashed, whole, offsets, starts, ends, config))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keep = ends > starts
    return starts[keep], ends[keep]


def _inner_cuts(
    hashed: np.ndarray, whole: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, config: ChunkConfig
) -> np.ndarray:
    """Cuts inside the stretches that are too long or repeat a window of bytes."""
    long = np.flatnonzero(ends - starts > min(4 * config.spacing, config.most))
    starts, ends = starts[long], ends[long]
    texts = offsets[np.searchsorted(offsets, starts, "right") - 1]
    low = np.maximum(starts + 1, texts + WINDOW)
    size = np.maximum(ends - low, 0)
    of = np.repeat(np.arange(len(low)), size)
    place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]
    value = hashed[place - 1].astype(np.uint64)
    keys = np.sort(of.astype(np.uint64) << np.uint64(32) | value)
    cut = ends - starts > config.most
    cut[(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(32)).astype(np.int64)] = True
    chosen = cut[of] & whole[place]
    of, place, value = of[chosen], place[chosen], value[chosen]
    n = len(place)
    # the later of equal values is the lower one
    least = value << np.uint64(32) | np.arange(n, 0, -1).astype(np.uint64)
    reach = 1
    while reach < config.spacing:
        least[reach:] = np.minimum(least[reach:], least[:-reach])  # of the last 2 * reach places
        reach *= 2
    full = np.zeros(n, bool)
    full[config.spacing - 1 :] = of[config.spacing - 1 :] == of[: max(n - config.spacing + 1, 0)]
    at = np.unique(n - (least[full] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    of, place = of[at], place[at]
    follows = np.minimum(np.searchsorted(place, place + config.least), np.searchsorted(of, of, "right")).tolist()
    out, i = [], 0
    while i < len(follows):
        out.append(i)
        i = follows[i]
    return place[out]


#: place holds number and begin, size holds length, words and whether the digest is new in the document; the digest has two
#: halves. For every chunk of the corpus only the first half is shuffled, to be counted.
CHUNKS = "doc_id long, content long, place long, size int, digest long, second long"
_WORDS = 1 << 12
_SECOND = (0x5851F42D4C957F2D,)


def _chunk_batch(ids: pa.Array, contents: pa.Array, texts: pa.Array, config: ChunkConfig) -> pa.RecordBatch:
    data, offsets = tx.utf8(texts, lower=False)
    starts, ends = cuts(data, offsets, config)
    digests = tx.span_hashes(data, starts, ends)
    of = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets[:-1])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    heads, _ = tx.word_spans(data, offsets)
    words = np.searchsorted(heads, ends) - np.searchsorted(heads, starts)
    second = Spans(data, _SECOND)(starts, ends)[0]
    order = np.lexsort((starts, digests, of))
    new = np.ones(len(of), bool)
    new[order[1:]] = (of[order[1:]] != of[order[:-1]]) | (digests[order[1:]] != digests[order[:-1]])
    place = (np.arange(len(of)) - first[of]) << 32 | (points[starts] - points[offsets[of]])
    size = ((points[ends] - points[starts]) * _WORDS + words) * 2 + new
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(of)), contents.take(pa.array(of)), pa.array(place.astype(np.int64)), pa.array(size.astype(np.int32)),
            pa.array(digests.view(np.int64)), pa.array(second.view(np.int64)),
        ],
        ["doc_id", "content", "place", "size", "digest", "second"],
    )


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")


def packed_chunks(docs: DataFrame, config: ChunkConfig) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents, texts = batch.columns
            for a, b in tx.text_slices(texts, 1 << 20):
                yield _chunk_batch(ids.slice(a, b - a), contents.slice(a, b - a), texts.slice(a, b - a), config)

    return _identified(docs).mapInArrow(run, CHUNKS)


def _unpacked(rows: DataFrame) -> DataFrame:
    begin = F.col("place").bitwiseAND(0xFFFFFFFF)
    length = F.expr(f"size div {2 * _WORDS}")
    return rows.select(
        "doc_id",
        "content",
        F.shiftright("place", 32).cast("int").alias("at"),
        begin.cast("int").alias("begin"),
        (begin + length).cast("int").alias("stop"),
        F.expr(f"cast(size div 2 % {_WORDS} as int)").alias("words"),
        "digest",
        *[c for c in rows.columns if c not in ("doc_id", "content", "place", "size", "digest", "second")],
    )


def chunks(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """A row per chunk: doc_id, number, begin and stop in code points, words that begin in it, digest."""
    return _unpacked(packed_chunks(docs, config))


_DOCUMENT = ["doc_id", "content"]


def repeated_chunks(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks whose digest occurs at two places or more, with ``original``: whether it is the first of them.

    Halves of digests are counted alone; a bitmap of those that repeat keeps most chunks out of the second shuffle, in
    which whole digests decide.
    """
    seen = packed_chunks(docs, config).select("digest")
    common = stored(seen.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))
    # cut twice rather than written: both readers take little of it
    likely = maybe_in(packed_chunks(docs, config), common, {"digest": F.col("digest")}).where("maybe").drop("maybe")
    whole = likely.groupBy("digest", "second").agg(F.count("*").alias("n"), F.min(F.struct(*_DOCUMENT)).alias("first_doc")).where("n > 1")
    marked = lookup(likely, whole.drop("n").withColumn("known", F.lit(True)), ["digest", "second"]).where("known")
    first = F.col("doc_id").eqNullSafe(F.col("first_doc.doc_id")) & (F.col("content") == F.col("first_doc.content"))
    rows = _unpacked(marked.withColumn("original", first & (F.col("size") % 2 == 1)).drop("first_doc", "known"))
    # rows that repeat a document are one
    return rows.groupBy(*_DOCUMENT, "at", "begin", "stop", "words").agg(F.max("original").alias("original"))


def _with_runs(found: DataFrame) -> DataFrame:
    """A number that adjacent chunks of a document share; a document's chunks are all that one window holds."""
    return found.withColumn("run", F.col("at") - F.dense_rank().over(Window.partitionBy(*_DOCUMENT).orderBy("at")))


def repeated_passages(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Runs of repeated chunks with at least ``words`` words: doc_id, content (hash of the text), begin, stop, n_words, n_chunks,
    n_duplicate_chars (what can go without losing an original)."""
    found = repeated_chunks(docs, config)
    length = F.col("stop") - F.col("begin")
    spans = _with_runs(found).groupBy(*_DOCUMENT, "run").agg(
        F.min("begin").cast("long").alias("begin"),
        F.max("stop").cast("long").alias("stop"),
        F.sum("words").alias("n_words"),
        F.count("*").alias("n_chunks"),
        F.sum(F.when(~F.col("original"), length).otherwise(0)).alias("n_duplicate_chars"),
    )
    return spans.where(F.col("n_words") >= config.words).drop("run")


def drop_duplicates(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """``docs`` without the duplicate parts of repeated passages; one original of each chunk stays where it is first."""
    ranked = stored(_with_runs(repeated_chunks(docs, config)))
    long = ranked.groupBy(*_DOCUMENT, "run").agg(F.sum("words").alias("n_words")).where(F.col("n_words") >= config.words)
    gone = lookup(ranked.where(~F.col("original")), long.select(*_DOCUMENT, "run"), [*_DOCUMENT, "run"], "left_semi")
    holes = stored(gone.groupBy(*_DOCUMENT).agg(F.array_sort(F.collect_set(F.struct("begin", "stop"))).alias("holes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cut = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [t if t is None or not h else _without(t, [(x["begin"], x["stop"]) for x in h]) for t, h in zip(texts, cut, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    marked = maybe_in(rows, holes, {c: F.col(c) for c in _DOCUMENT})
    met = lookup(marked.where("maybe").drop("maybe"), holes, _DOCUMENT).select("row", "text", "holes")
    cleaned = met.mapInArrow(run, T.StructType([met.schema["row"], T.StructField("text", T.StringType())]))
    own = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cleaned.select(*own).unionByName(marked.where("not maybe").select("row.*")).select(*docs.columns)


def _without(text: str, holes: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in holes:
        out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])
