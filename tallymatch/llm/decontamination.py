"""Benchmark items inside documents: size-partitioned MinHash containment search, verified on the shingles themselves.

An item is short and a document may be long, so their Jaccard similarity says nothing. Items are therefore partitioned
by size (number of word shingles, by powers of two), and for each size documents are cut into overlapping windows of
twice that size: a passage as long as the item lies in one window whole and makes up a quarter of it at least. Items and
windows get one-permutation MinHash signatures (the least hash of each coordinate). A shared coordinate makes a
candidate, and a candidate counts if the document holds the given share of the item's distinct shingles. Items of up to
eight shingles are searched with windows of one shingle, where the signature is the shingle. An item of fewer words than
a shingle is one shingle of its own length, and is looked for among all runs of so many words.

The benchmark is shingled once, into a table. Its index is sent to the tasks in parts of some ``part_shingles`` shingles, one
at a time: what a part finds is written before the part is released and the next one made, so that the driver and the
executors never hold more than one, however large the benchmark.

Defined results: null and empty texts, and texts without words, match nothing; an item of fewer than five words is in every
text that holds these words in a row, so a benchmark of single common words marks most texts; repeated items and repeated
rows are reported each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymatch.llm import text as tx
from tallymatch.llm.storage import discard, stored

U64 = np.uint64
NONE = U64(0xFFFFFFFFFFFFFFFF)
SMALL = 8


@dataclass(frozen=True)
class ContainmentConfig:
    """With ``coordinates`` of at least the window's size, an item at the threshold is missed with less than 1e-5."""

    shingle: int = 5
    threshold: float = 0.8
    coordinates: int = 128
    part_shingles: int = 4_000_000


def size_class(n: int) -> int:
    """Shingles up to which items share windows; 1 for small items."""
    return 1 if n <= SMALL else 1 << (int(n) - 1).bit_length()


def _coordinates(size: int, config: ContainmentConfig) -> int:
    return max(config.coordinates, 2 * size)


def _values(shingles: np.ndarray, size: int) -> np.ndarray:
    """Hashes that are compared in signatures of one size."""
    return tx.mix(shingles ^ tx.golden(size)) >> U64(1)


@dataclass
class Index:
    """Signatures of a part of the benchmark: for each number of words in a shingle and each size, sorted values and the
    item of each."""

    ids: list
    lengths: list[int]
    shingles: list[np.ndarray]
    sizes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def build_index(ids: list, lengths: list[int], shingles: list[np.ndarray], config: ContainmentConfig) -> Index:
    by_size: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, (length, s) in enumerate(zip(lengths, shingles, strict=True)):
        size = size_class(len(s))
        values = _values(s, size)
        if size > 1:
            m = _coordinates(size, config)
            least = np.full(m, NONE)
            np.minimum.at(least, (values % U64(m)).astype(np.int64), values)
            values = least[least != NONE]
        by_size.setdefault((length, size), []).append((values, np.full(len(values), i)))
    sizes = {}
    for kind, found in by_size.items():
        values, items = np.concatenate([v for v, _ in found]), np.concatenate([i for _, i in found])
        order = np.argsort(values, kind="stable")
        sizes[kind] = (values[order], items[order], _filter(values))
    return Index(ids, lengths, shingles, sizes)


def _filter(values: np.ndarray) -> np.ndarray:
    """A bit map by part of the hash that rules out most values at once."""
    bits = np.zeros(1 << 20, bool)
    bits[(values >> U64(43)).astype(np.int64)] = True
    return bits


def _window_values(values: np.ndarray, offsets: np.ndarray, size: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all windows as flat values, and the text of each."""
    counts = np.diff(offsets)
    blocks = -(-counts // size)
    first = np.concatenate([[0], np.cumsum(blocks)])
    of = np.repeat(np.arange(len(counts)), counts)
    block = first[of] + (np.arange(len(values)) - offsets[of]) // size
    least = np.full((int(first[-1]), m), NONE)
    np.minimum.at(least.reshape(-1), block * m + (values % U64(m)).astype(np.int64), values)
    text = np.repeat(np.arange(len(counts)), blocks)
    # a window is a block and the next one of the same text
    for start in range(0, len(least) - 1, 4096):
        stop = min(start + 4096, len(least) - 1)
        follows = start + np.flatnonzero(text[start + 1 : stop + 1] == text[start:stop])
        least[follows] = np.minimum(least[follows], least[follows + 1])
    return least.reshape(-1), text


def search(index: Index, texts: pa.Array, config: ContainmentConfig) -> list[tuple[int, int, int]]:
    """(text, item, number of the item's shingles found) for all items contained in the texts."""
    hashes, starts = tx.words(*tx.utf8(texts))
    held = {length: tx.shingles(hashes, starts, length) for length in {length for length, _ in index.sizes}}
    pairs = []
    for (length, size), (known, items, bits) in index.sizes.items():
        shingles, offsets = held[length]
        values = _values(shingles, size)
        width = 1
        if size == 1:
            of = np.repeat(np.arange(len(texts)), np.diff(offsets))
        else:
            width = _coordinates(size, config)
            values, of = _window_values(values, offsets, size, width)
        likely = np.flatnonzero(bits[(values >> U64(43)).astype(np.int64) & 0xFFFFF])
        values, of = values[likely], of[likely // width]
        low, high = np.searchsorted(known, values, "left"), np.searchsorted(known, values, "right")
        n = high - low
        row = np.repeat(np.arange(len(values)), n)
        at = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        pairs.append(np.unique(of[row] * len(index.ids) + items[at]))
    out = []
    for pair in np.unique(np.concatenate(pairs)) if pairs else ():
        i, item = divmod(int(pair), len(index.ids))
        wanted = index.shingles[item]
        shingles, offsets = held[index.lengths[item]]
        found = int(np.isin(wanted, shingles[offsets[i] : offsets[i + 1]]).sum())
        if found >= config.threshold * len(wanted):
            out.append((i, item, found))
    return out


SCHEMA = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


def _item_shingles(benchmark: DataFrame, config: ContainmentConfig) -> DataFrame:
    """The distinct shingles of each item and the number of words in one."""
    schema = "item_id long, length int, shingles array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tx.text_slices(batch.column(1)):
                hashes, starts = tx.words(*tx.utf8(batch.column(1).slice(a, b - a)))
                lengths = np.minimum(np.diff(starts), config.shingle)
                lists: list[np.ndarray] = [np.zeros(0, np.int64)] * (b - a)
                for length in np.unique(lengths[lengths > 0]):
                    found, offsets = tx.shingles(hashes, starts, int(length))
                    for i in np.flatnonzero(lengths == length):
                        lists[i] = np.unique(found[offsets[i] : offsets[i + 1]]).view(np.int64)
                columns = [batch.column(0).slice(a, b - a), pa.array(lengths, pa.int32()), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "length", "shingles"])

    items = benchmark.selectExpr("cast(item_id as long) as item_id", "text").mapInArrow(run, schema)
    return items.where("length > 0")


def _parts(benchmark: DataFrame, config: ContainmentConfig) -> Iterator[tuple[Index, bool]]:
    """The benchmark's index in parts of bounded size, each with whether it is the last. Items are dealt by hash and weighed
    before any is collected, and a part is made only when it is asked for."""
    items = stored(_item_shingles(benchmark, config))
    total = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    n = -(-2 * total // config.part_shingles) if total > config.part_shingles // 2 else 1
    for part in range(n if total else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(n)) == part).collect()
        if part + 1 == n:
            discard(items)
        hashes = [np.array(r.shingles, np.int64).view(U64) for r in rows]
        yield build_index([r.item_id for r in rows], [r.length for r in rows], hashes, config), part + 1 == n
    if not total:
        discard(items)


@contextmanager
def _sent(spark: SparkSession, index: Index) -> Iterator[Broadcast]:
    """An index on the executors until the work on it is written."""
    shared = spark.sparkContext.broadcast(index)
    try:
        yield shared
    finally:
        shared.destroy()


def _found_in(texts: DataFrame, shared: Broadcast, config: ContainmentConfig) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b in tx.text_slices(batch.column(1)):
                found = search(known, batch.column(1).slice(a, b - a), config)
                if found:
                    sizes = [len(known.shingles[item]) for _, item, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([a + i for i, _, _ in found])),
                            pa.array([known.ids[item] for _, item, _ in found], pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.array([n for *_, n in found], pa.int64()),
                            pa.array([n / s for (*_, n), s in zip(found, sizes, strict=True)], pa.float64()),
                        ],
                        SCHEMA.replace(",", "").split()[::2],
                    )

    return texts.mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, config: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """One row per document and benchmark item in it: doc_id, item_id, n_shingles, n_found, containment.

    The last part of the index is searched when the result is read, the ones before it at once.
    """
    spark = docs.sparkSession
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    found = []
    for index, last in _parts(benchmark, config):
        if last:
            found.append(_found_in(texts, spark.sparkContext.broadcast(index), config))
        else:
            with _sent(spark, index) as shared:
                found.append(stored(_found_in(texts, shared, config)))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def _marked(texts: DataFrame, shared: Broadcast, config: ContainmentConfig) -> DataFrame:
    """Digests of the texts that hold an item of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tx.text_slices(batch.column(0)):
                rows = batch.column(0).slice(a, b - a)
                held = sorted({i for i, _, _ in search(shared.value, rows, config)})
                digests = [sha256(rows[i].as_py().encode()).hexdigest() for i in held]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string())], ["digest"])

    return texts.mapInArrow(run, "digest string")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, config: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged.

    Parts of the index before the last one write the digests of the texts they find, and these texts are left out by an
    anti join; the last part is searched in the pass that returns the rows.
    """
    spark = docs.sparkSession
    at = docs.columns.index("text")

    def without(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in tx.text_slices(batch.column(at)):
                    kept = np.ones(b - a, bool)
                    for i, _, _ in search(shared.value, batch.column(at).slice(a, b - a), config):
                        kept[i] = False
                    if kept.any():
                        yield batch.slice(a, b - a).filter(pa.array(kept))

        return rows.mapInArrow(run, docs.schema)

    rows, marks = docs, []
    for index, last in _parts(benchmark, config):
        if not last:
            with _sent(spark, index) as shared:
                marks.append(stored(_marked(docs.select("text"), shared, config)))
            continue
        if marks:
            known = reduce(DataFrame.unionByName, marks).distinct()
            rows = rows.join(known, F.sha2(docs["text"], 256) == known["digest"], "left_anti")
        rows = without(rows, spark.sparkContext.broadcast(index))
    return rows


def _class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for first, last in ranges)


_ASCII = r"\x{0}-/:-@\[-`{-\x{7F}"  # all that is no letter or digit; the underscore is let in again
_UNSPACED = _class(tx.UNSPACED)
WORD = rf"[{_UNSPACED}]|(?:_|[^{_ASCII}\p{{P}}\p{{Z}}\p{{Cc}}{_UNSPACED}])+"

#: The same by plain joins of all shingles.
SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 5) AS k
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM benchmark)),
doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM docs JOIN (SELECT DISTINCT k FROM items WHERE k > 0) ON len(w) >= k),
item_shingles AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM items WHERE k > 0),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*)::DOUBLE / n_shingles AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles
"""
