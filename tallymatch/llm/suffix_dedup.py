"""Removal of every byte that a repeated string of ``length`` bytes covers, by distributed prefix doubling.

Sorting all suffixes of a corpus would shuffle every byte many times over. What has to be told apart are windows: the
strings of exactly ``length`` bytes. They are sorted in groups, from a short common part to the whole:

1. Positions. In each window the ``seed`` bytes with the least hash (the last of equal ones) are its anchor. Equal windows
   have equal anchors at equal distances, and neighbouring windows mostly share theirs: one position stands for some 170
   windows. The hash of the seed is the first rank.
2. Doubling. What the windows of a position have in common is a string around the anchor. Spark sorts the pairs of rank
   and next longer common string; the place of a pair in that order is the new rank. Positions whose pair is unique are
   dropped: none of their windows is repeated. Then the windows of a position are divided into ``branch`` neighbouring
   groups, each of which has a longer string in common, up to single windows, whose common string is all of them.
3. Past the threshold. Where two positions agree in the whole stretch that all their windows cover, all of these windows
   are repeated, and nothing of them need be divided any more. One of such positions goes on as long as others of its rank
   are undecided, since its windows may equal theirs. So copies end in the first round, however many there are, and later
   rounds hold little more than both ends of each repeated stretch.

No position is dropped while one of its windows may be repeated, so the result is exact (up to equal 128-bit hashes of
different strings). No group of equal ranks is gathered: rounds consist of aggregations and joins that adaptive execution
can split. Texts of documents with undecided positions are read again each round, behind a bitmap of fixed size.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` lose nothing; a row that repeats doc_id
and text is a document of its own, whose strings occur in both; so is a row without doc_id. Where bytes are removed inside
a character, the kept bytes are no longer valid UTF-8; ``drop_repeats`` replaces such remnants by nothing. Other columns
are neither read nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymatch.llm import text as tx
from tallymatch.llm.membership import maybe_in
from tallymatch.llm.storage import discard, stored
from tallymatch.operators.lookup import lookup

U64 = np.uint64
_STRETCH = 1 << 19  # windows looked at at once
_PLACE = U64((1 << 24) - 1)
_BYTE = tx.mix(np.arange(1, 257, dtype=U64) * tx.GOLDEN)
_BASES = (0x100000001B3, 0x5851F42D4C957F2D)


@dataclass(frozen=True)
class SuffixConfig:
    """``length`` bytes make a repeat; ``seed`` bytes make a first rank; each round divides the windows of a position by
    ``branch``. Cost depends on the last two, the result on the first alone."""

    length: int = 400
    seed: int = 64
    branch: int = 7

    def __post_init__(self) -> None:
        if not 0 < self.seed <= self.length or self.branch < 2:
            raise ValueError("seed must lie between 1 and length, branch be 2 at least")

    @property
    def spread(self) -> int:
        """Windows that can share an anchor."""
        return self.length - self.seed + 1

    def block_sizes(self) -> list[int]:
        """How many neighbouring windows form a group, round by round, after the first."""
        sizes, size = [], self.spread
        while size > 1:
            size = -(-size // self.branch)
            sizes.append(size)
        return sizes


# --- hashes and anchors of one stretch of bytes --------------------------------------------------------------------


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes, doubled from single bytes."""
    base, out, have = _BASES[0], None, 0
    current, length = _BYTE[data], 1
    while True:
        if size & length:
            if out is None:
                out, have = current.copy(), length
            else:
                n = len(current) - have
                out = out[: max(n, 0)] * U64(pow(base, length, 1 << 64)) + current[have:]
                have += length
        if length * 2 > size:
            break
        n = max(len(current) - length, 0)
        current = current[:n] * U64(pow(base, length, 1 << 64)) + current[length:]
        length *= 2
    return tx.mix(out)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values."""
    length = 1
    while length * 2 <= size:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    rest = size - length
    return np.minimum(values[:-rest], values[rest:]) if rest else values


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    if len(_tables.get(base, ())) <= size:
        _tables[base] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(1 << size.bit_length(), base, U64))])
    return _tables[base]


class Spans:
    """Hashes of any spans of some bytes."""

    def __init__(self, data: np.ndarray, bases: tuple[int, ...] = _BASES):
        self._parts = []
        value = _BYTE[data]
        for base in bases:
            sums = np.zeros(len(data) + 1, U64)
            np.cumsum(value * _powers(base, len(data))[: len(data)], out=sums[1:])
            self._parts.append((sums, _powers(pow(base, -1, 1 << 64), len(data))))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        size = (ends - starts).astype(U64) * tx.GOLDEN
        return [tx.mix((sums[ends] - sums[starts]) * inverses[starts] + size) for sums, inverses in self._parts]


def anchors(data: np.ndarray, offsets: np.ndarray, config: SuffixConfig) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: text, place in ``data``, least and greatest distance of its windows' starts, first rank."""
    none = np.zeros(0, np.int64)
    if len(data) < config.length:
        return none, none, none, none, none.astype(U64)
    seeds = _rolling(data, config.seed)
    n = len(seeds)
    keyed = (seeds & ~_PLACE) | (U64(n - 1) - np.arange(n, dtype=U64))
    owner = n - 1 - (_least(keyed, config.spread) & _PLACE).astype(np.int64)
    # windows that lie within one text
    sizes = np.maximum(np.diff(offsets) - config.length + 1, 0)
    of = np.repeat(np.arange(len(sizes)), sizes)
    if not len(of):
        return none, none, none, none, none.astype(U64)
    start = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[of]
    owner = owner[start]
    first = np.ones(len(of), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(of)) - 1
    place = owner[at]
    return of[at], place, place - start[last], place - start[at], seeds[place]


def _stretches(offsets: np.ndarray, config: SuffixConfig) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end of texts, begin, end in bytes) of pieces of bounded size that together hold every window once."""
    for a, b in tx.slices(np.diff(offsets), _STRETCH):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= 2 * _STRETCH or b > a + 1:
            yield a, b, low, high
        else:
            for begin in range(low, max(high - config.length + 1, low + 1), _STRETCH):
                yield a, b, begin, min(high, begin + _STRETCH + config.length - 1)


POSITIONS = "doc_id long, content long, at long, near int, far int, rank long, part int, core long, whole1 long, whole2 long"


def _batch(names: str, ids: pa.Array, contents: pa.Array, of: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    taken = pa.array(of)
    kinds = {"long": np.int64, "int": np.int32}
    fields = [f.split() for f in names.split(", ")]
    rest = [pa.array(c.view(np.int64) if c.dtype == U64 else c.astype(kinds[k])) for c, (_, k) in zip(columns, fields[2:], strict=True)]
    return pa.RecordBatch.from_arrays([ids.take(taken), contents.take(taken), *rest], [f[0] for f in fields])


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")


def positions(docs: DataFrame, config: SuffixConfig) -> DataFrame:
    """A row per anchor. ``at - far`` to ``at - near`` are its windows, ``whole`` is the hash of the stretch they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents, texts = batch.columns
            for a, b in tx.text_slices(texts):
                data, offsets = tx.utf8(texts.slice(a, b - a), lower=False)
                for first, last, low, high in _stretches(offsets, config):
                    inside = np.clip(offsets[first : last + 1] - low, 0, high - low)
                    of, place, near, far, rank = anchors(data[low:high], inside, config)
                    if len(of):
                        whole = Spans(data[low:high])(place - far, place - near + config.length)
                        zero = np.zeros(len(of), np.int64)
                        at = place + low - offsets[first + of]
                        yield _batch(POSITIONS, ids, contents, of + a + first, at, near, far, zero, zero, rank, *whole)

    return _identified(docs).mapInArrow(run, POSITIONS)


# --- rounds --------------------------------------------------------------------------------------------------------

_KEY = ["rank", "part", "core"]
_WHOLE = ["near", "far", "whole1", "whole2"]


def ranked(rows: DataFrame) -> DataFrame:
    """The pairs of rank and common string that occur more than once, in sorted order, with their place in it.

    Places grow along the order but leave gaps, since each sorted part counts on its own.
    """
    pairs = rows.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1")
    return pairs.orderBy(*_KEY).select(*_KEY, F.monotonically_increasing_id().alias("new_rank"))


def settle(rows: DataFrame, prefilter: bool) -> tuple[DataFrame, DataFrame]:
    """Decided windows (doc_id, content, first, last), and positions to divide further (doc_id, content, at, near, far, rank)."""
    names = stored(ranked(rows))
    if prefilter:
        rows = maybe_in(rows, names, {k: F.col(k) for k in _KEY}).where("maybe").drop("maybe")
    kept = stored(lookup(rows, names, _KEY).where("new_rank is not null").drop(*_KEY))
    kinds = kept.groupBy("new_rank", *_WHOLE).agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "content", "at")).alias("one")
    )
    kinds = stored(kinds)
    repeated = kinds.where("n > 1").select("new_rank", *_WHOLE, F.lit(True).alias("repeated"))
    decided = lookup(kept, repeated, ["new_rank", *_WHOLE]).where("repeated").select(
        "doc_id", "content", (F.col("at") - F.col("far")).alias("first"), (F.col("at") - F.col("near")).alias("last")
    )
    decided = stored(decided)
    undecided = kinds.groupBy("new_rank").agg(F.count_if(F.col("n") == 1).alias("open")).where("open > 0")
    further = lookup(kinds, undecided, ["new_rank"], "left_semi").select("one.*", "near", "far", F.col("new_rank").alias("rank"))
    further = stored(further)
    for done in (names, kept, kinds):
        discard(done)
    return decided, further


def _joined(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts with what is wanted of them, one row per identity: most documents are left out before the shuffle."""
    keys = {"doc_id": F.col("doc_id"), "content": F.col("content")}
    near = maybe_in(_identified(docs), wanted, keys).where("maybe").drop("maybe")
    return lookup(near, wanted, ["doc_id", "content"])


def divided(docs: DataFrame, further: DataFrame, size: int, config: SuffixConfig) -> DataFrame:
    """The positions ``further`` by groups of ``size`` windows, with the longer strings that each group has in common."""
    mine = further.groupBy("doc_id", "content").agg(F.collect_list(F.struct("at", "near", "far", "rank")).alias("mine"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents, texts, lists = batch.columns
            for a, b in tx.text_slices(texts):
                data, offsets = tx.utf8(texts.slice(a, b - a), lower=False)
                own = lists.slice(a, b - a)
                counts = np.asarray(own.value_lengths())
                flat = own.flatten()
                if not len(flat):
                    continue
                at, near, far, rank = (np.asarray(flat.field(i)).astype(np.int64) for i in range(4))
                of = np.repeat(np.arange(b - a), counts)
                order = np.argsort(at + offsets[of], kind="stable")
                # pieces of text of bounded size, whole surroundings of their positions included
                place = (at + offsets[of])[order]
                start = 0
                while start < len(order):
                    stop = int(np.searchsorted(place, place[start] + _STRETCH, "right"))
                    chosen = order[start:stop]
                    low = max(int(place[start]) - config.spread, 0)
                    high = min(int(place[stop - 1]) + config.length, len(data))
                    spans = Spans(data[low:high])
                    # as many groups as the position's windows reach into
                    begin, end = near[chosen] // size, far[chosen] // size
                    groups = end - begin + 1
                    which = np.repeat(chosen, groups)
                    part = np.arange(len(which)) - np.repeat(np.cumsum(groups) - groups, groups) + np.repeat(begin, groups)
                    left, right = part * size, np.minimum(part * size + size, config.spread) - 1
                    here = at[which] + offsets[of[which]] - low
                    core = spans(here - left, here - right + config.length)[0]
                    least, most = np.maximum(near[which], left), np.minimum(far[which], right)
                    whole = spans(here - most, here - least + config.length)
                    yield _batch(POSITIONS, ids, contents, of[which] + a, at[which], least, most, rank[which], part, core, *whole)
                    start = stop

    return _joined(docs, mine).where("mine is not null").mapInArrow(run, POSITIONS)


def _merged(windows: DataFrame, config: SuffixConfig) -> DataFrame:
    """(doc_id, content, begins, ends): maximal runs of covered bytes, one row per identity.

    Rows stream through in order; of a document no more is held than its runs.
    """
    keys = ["doc_id", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begins, ends = None, [], []
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            lists = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], lists), pa.array(columns[3], lists)],
                ["doc_id", "content", "begins", "ends"],
            )

        for batch in batches:
            for doc, content, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (doc, content):
                    if key is not None:
                        out.append((*key, begins, ends))
                    key, begins, ends = (doc, content), [first], [last + config.length]
                elif first <= ends[-1]:
                    ends[-1] = max(ends[-1], last + config.length)
                else:
                    begins.append(first)
                    ends.append(last + config.length)
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if key is not None:
            out.append((*key, begins, ends))
        if out:
            yield batch_of(out)

    dealt = windows.repartition(*keys).sortWithinPartitions(*keys, "first")
    return dealt.mapInArrow(run, "doc_id long, content long, begins array<long>, ends array<long>")


def repeated_spans(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """(doc_id, content, begins, ends): the maximal runs of bytes that repeated strings cover; ``content`` is the hash of
    the text. Texts without any have no row, repeated rows have one."""
    rows = stored(positions(docs, config))
    decided, further = settle(rows, prefilter=True)
    discard(rows)
    windows = [decided]
    for size in config.block_sizes():
        decided, further = settle(divided(docs, further, size, config), prefilter=False)
        windows.append(decided)
    return stored(_merged(reduce(DataFrame.unionByName, windows), config))


def _with_spans(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, content, text, begins, ends) of rows that may have spans, after the join, and of those that can't."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text")
    marked = maybe_in(rows, spans, {"doc_id": F.col("doc_id"), "content": F.col("content")})
    return lookup(marked.where("maybe").drop("maybe"), spans, ["doc_id", "content"]), marked.where("not maybe").drop("maybe")


def _kept(text: bytes, begins: list[int] | None, ends: list[int] | None) -> bytes:
    if not begins:
        return text
    return b"".join(text[a:b] for a, b in zip([0, *ends], [*begins, len(text)], strict=True))


def removal_digest(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    spans = repeated_spans(docs, config)
    some, none = _with_spans(docs, spans)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, begins, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text or b""
                kept = _kept(data, begins, ends)
                out.append((doc, len(data), len(data) - len(kept), len(begins or ()), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in schema.split(", ")])

    whole = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    untouched = none.select(
        "doc_id",
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(whole, 256).alias("kept_sha256"),
    )
    read = some.select("doc_id", F.col("text").cast("binary").alias("text"), "begins", "ends")
    return read.mapInArrow(run, schema).unionByName(untouched)


def drop_repeats(docs: DataFrame, config: SuffixConfig = SuffixConfig()) -> DataFrame:
    """``docs`` without the covered bytes; a character that loses a byte goes as a whole."""
    some, none = _with_spans(docs, repeated_spans(docs, config))
    columns = [f"row.{c}" if c != "text" else "text" for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, begins, ends = (batch.column(names.index(c)).to_pylist() for c in ("text", "begins", "ends"))
            out = [
                t if not b else _kept(t.encode(), b, e).decode(errors="ignore")
                for t, b, e in zip(texts, begins, ends, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "text"])

    schema = T.StructType([some.schema["row"], T.StructField("text", T.StringType())])
    cut = some.select("row", "text", "begins", "ends").mapInArrow(run, schema)
    return cut.select(*columns).unionByName(none.select("row.*")).select(*docs.columns)
