"""Alignment of two tokenizers by merge-path partitioning.

Both tokenizers spell the same bytes (a space and the text), each with its own sequence of token ends. Merging the two
sorted sequences shows where both have an end: there the text falls into groups that neither tokenizer reaches across.
The merge is a path through a grid, and a diagonal of the grid crosses it at one point, found by binary search. Diagonals
at equal distances therefore cut the merge into pieces of equal work that don't need each other, however long a text is
and however unevenly the two tokenizers cut it. A piece merges its stretch of both sequences and emits the ends they share;
its last group is open and is stitched to the first one of the next piece.

Steps:

1. ``alignments``: texts are encoded, merged and written once, as ids, groups and counted links of each document.
2. ``pair_counts``: how often each pair of ids is linked in the corpus. Of two tokens that end at the same byte, the shorter
   is a suffix of the longer, so there are fewer pairs than bytes in both vocabularies together (``pair_bound``), however
   large the corpus: that is what makes the counts small enough to broadcast.
3. ``alignment_digest``: each document's links, weighed by these counts.

Texts are encoded by units between single spaces, which neither kind of tokenizer reaches across; each task remembers a
bounded number of units. A tokenizer that could reach across gets whole texts.

Defined results: null and empty texts, and texts that one tokenizer doesn't spell back byte by byte, have no tokens; rows
that repeat a document are documents of their own and count as such; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import text as tx
from tallymatch.llm.storage import stored

SPACE_MARK = "▁"
SLICE_BYTES = 1 << 20
REMEMBERED_UNITS = 400_000
WORK = 4096
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"\s | \s|^\s|\s$")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


# --- the merge -----------------------------------------------------------------------------------------------------


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of ``a`` lie before the merge path's crossing of each diagonal; the rest of the diagonal is of ``b``.

    Of equal values that of ``a`` comes first. All diagonals are searched at once, in the logarithm of a search.
    """
    low = np.maximum(diagonals - len(b), 0)
    high = np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        other = diagonals - 1 - middle
        # a[middle] is before the crossing if it is not above b[other]
        before = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(other, 0, len(b) - 1)])
        low = np.where(before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low


@dataclass
class Piece:
    """A stretch of the merge: the shared ends inside it, as places in ``a`` and ``b``, in order."""

    a: tuple[int, int]
    b: tuple[int, int]
    shared_a: np.ndarray
    shared_b: np.ndarray


def pieces(a: np.ndarray, b: np.ndarray, work: int = WORK) -> Iterator[Piece]:
    """The merge of two ascending sequences in pieces of ``work`` values each.

    A value of ``a`` comes first among equals, so a piece may hold the ``b`` of a pair whose ``a`` ended the piece before;
    such a pair is emitted by the piece that holds the ``b``, which looks back by one value.
    """
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, work), total)
    in_a = crossings(a, b, diagonals)
    in_b = diagonals - in_a
    for k in range(len(diagonals) - 1):
        a0, a1, b0, b1 = int(in_a[k]), int(in_a[k + 1]), int(in_b[k]), int(in_b[k + 1])
        own_a, own_b = a[max(a0 - 1, 0) : a1], b[b0:b1]
        at = np.searchsorted(own_a, own_b)
        hit = np.flatnonzero((at < len(own_a)) & (own_a[np.minimum(at, max(len(own_a) - 1, 0))] == own_b)) if len(own_a) else np.zeros(0, np.int64)
        yield Piece((a0, a1), (b0, b1), at[hit] + max(a0 - 1, 0), hit + b0)


def stitched(parts: Iterator[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the groups in both sequences (as counts of tokens): the open group at a piece's border goes on in the next."""
    ends_a, ends_b = [], []
    for piece in parts:
        ends_a.append(piece.shared_a + 1)
        ends_b.append(piece.shared_b + 1)
    if not ends_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ends_a).astype(np.int64), np.concatenate(ends_b).astype(np.int64)


# --- tokenizers ----------------------------------------------------------------------------------------------------


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevelTokenizer:
    """Byte-level BPE of a .json file: ids and bytes of tokens, without special tokens."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        decode = _byte_level()
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        size = max(made["model"]["vocab"].values(), default=-1) + 1
        self.bytes = [b""] * max([size, *(t["id"] + 1 for t in made["added_tokens"])])
        for token, i in made["model"]["vocab"].items():
            self.bytes[i] = bytes(decode[c] for c in token) if all(c in decode for c in token) else token.encode()
        pre = made["pre_tokenizer"] or {}
        plain_tokens = not [t for t in made["added_tokens"] if not t["special"]]
        self.separable = made["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and plain_tokens

    def encode(self, units: Sequence[str]) -> list[list[int]]:
        """Ids of each unit behind a space."""
        return [x.ids for x in self._tokenizer.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]


class PieceTokenizer:
    """Pieces of a .model file that adds a space in front."""

    def __init__(self, path: str):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self._library.id_to_piece(i) for i in range(self._library.get_piece_size())]
        self.bytes = [
            bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self._library.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
            for i, p in enumerate(names)
        ]
        # units stay apart if no piece has a space behind another character
        self.separable = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in names) and self.encode(["a", "a b"])[1][: len(self.encode(["a"])[0])] == self.encode(["a"])[0]

    def encode(self, units: Sequence[str]) -> list[list[int]]:
        return self._library.encode(list(units), num_threads=1)


class UnitCoder:
    """Ids of both tokenizers for units, remembered; lists of ids lie one behind the other in two arrays."""

    def __init__(self, a: ByteLevelTokenizer, b: PieceTokenizer):
        self.a, self.b = a, b
        self.separable = a.separable and b.separable
        self.length_a = np.array([len(x) for x in a.bytes], np.int64)
        self.length_b = np.array([len(x) for x in b.bytes], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self._ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self._ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self._good = np.zeros(0, bool)

    def units(self, text: str) -> list[str]:
        if not self.separable:
            return [text]
        return _BREAK.split(text) if _ODD_SPACE.search(text) else text.split(" ")

    def learn(self, texts: Sequence[list[str]]) -> None:
        if len(self.at) > REMEMBERED_UNITS:
            self._forget()
        new = list(dict.fromkeys(u for units in texts for u in units if u not in self.at))
        if not new:
            return
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        found = [self.a.encode(new), self.b.encode(new)]
        spelled = [b" " + u.encode() for u in new]
        good = np.ones(len(new), bool)
        for k, (names, sizes, lists) in enumerate(zip((self.a.bytes, self.b.bytes), (self.length_a, self.length_b), found, strict=True)):
            flat = list(chain.from_iterable(lists))
            ids = np.array(flat, np.int32)
            ends = np.cumsum([len(x) for x in lists])
            # all units at once; unit by unit only if that shows a difference
            same = b"".join(map(names.__getitem__, flat)) == b"".join(spelled)
            reached = np.append(0, np.cumsum(sizes[ids]))[ends]
            if not same or (reached != np.cumsum([len(x) for x in spelled])).any():
                good &= [b"".join(map(names.__getitem__, x)) == y for x, y in zip(lists, spelled, strict=True)]
            self._ids[k] = np.concatenate([self._ids[k], ids])
            self._ends[k] = np.concatenate([self._ends[k], ends + self._ends[k][-1]])
        self._good = np.concatenate([self._good, good])

    def good(self, at: np.ndarray) -> np.ndarray:
        return self._good[at]

    def ids(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units ``at``, one behind the other, and how many each has."""
        starts, counts = self._ends[k][at], self._ends[k][at + 1] - self._ends[k][at]
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return self._ids[k][np.repeat(starts, counts) + within], counts


@lru_cache(maxsize=2)
def coder(path_a: str, path_b: str) -> UnitCoder:
    return UnitCoder(ByteLevelTokenizer(path_a), PieceTokenizer(path_b))


def pair_bound(a: Sequence[bytes], b: Sequence[bytes]) -> int:
    """At most so many pairs of ids can end together: one of the two is a suffix of the other."""
    in_a, in_b = set(a), set(b)
    return sum(x[k:] in in_b for x in a for k in range(len(x))) + sum(x[k:] in in_a for x in b for k in range(1, len(x)))


# --- documents -----------------------------------------------------------------------------------------------------


@dataclass
class Aligned:
    """Token ids of both tokenizers and the groups' ends (as counts of tokens) of some documents, one behind the other."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    docs_a: np.ndarray
    docs_b: np.ndarray
    groups_a: np.ndarray
    groups_b: np.ndarray


def _spelled(found: UnitCoder, at: np.ndarray, text: str) -> bool:
    """Whether both tokenizers spell the whole text, though one of its units looks wrong by itself."""
    whole = (" " + text).encode()
    return all(b"".join(names[i] for i in found.ids(k, at)[0].tolist()) == whole for k, names in enumerate((found.a.bytes, found.b.bytes)))


def align(found: UnitCoder, texts: Sequence[str | None], work: int = WORK) -> Aligned:
    units = [found.units(t) if t else [] for t in texts]
    found.learn(units)
    counts = np.array([len(u) for u in units], np.int64)
    at = np.fromiter((found.at[u] for own in units for u in own), np.int64, int(counts.sum()))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(texts)), counts)
    bad = np.unique(doc[~found.good(at)])
    for i in [i for i in bad.tolist() if not _spelled(found, at[bounds[i] : bounds[i + 1]], texts[i])]:
        counts[i] = 0
    if len(bad):
        at, doc = at[counts[doc] > 0], doc[counts[doc] > 0]
    ids_a, n_a = found.ids(0, at)
    ids_b, n_b = found.ids(1, at)
    # ends within all documents together: a document begins where the one before ends, so both sequences ascend
    ends_a, ends_b = np.cumsum(found.length_a[ids_a]), np.cumsum(found.length_b[ids_b])
    groups_a, groups_b = stitched(pieces(ends_a, ends_b, work))
    docs_a = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=n_a, minlength=len(texts)))]).astype(np.int64)
    docs_b = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=n_b, minlength=len(texts)))]).astype(np.int64)
    return Aligned(ids_a, ids_b, docs_a, docs_b, groups_a, groups_b)


def _digests(found: Aligned) -> list[str]:
    """sha256 of each document's groups: ids of A, a bar, ids of B; groups are set apart by semicolons."""
    starts_a, starts_b = np.append(0, found.groups_a)[:-1], np.append(0, found.groups_b)[:-1]
    n_a, n_b = found.groups_a - starts_a, found.groups_b - starts_b
    # every token is written with the mark behind it: comma inside, bar behind A's last, semicolon behind B's last
    place_a = np.arange(len(found.ids_a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)
    place_b = np.arange(len(found.ids_b)) + np.repeat(np.cumsum(n_a), n_b)
    ids = np.empty(len(found.ids_a) + len(found.ids_b), np.int64)
    marks = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = found.ids_a, found.ids_b
    marks[place_a[found.groups_a - 1]] = ord("|")
    marks[place_b[found.groups_b - 1]] = ord(";")
    digits = np.ones(len(ids), np.int64)
    for power in range(1, 10):
        if not (more := ids >= 10**power).any():
            break
        digits += more
    ends = np.cumsum(digits + 1)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = marks
    left = ids.copy()
    for k in range(int(digits.max()) if len(digits) else 0):
        chosen = np.flatnonzero(digits > k)
        out[ends[chosen] - 2 - k] = left[chosen] % 10 + ord("0")
        left //= 10
    tokens = found.docs_a + found.docs_b
    cuts = np.append(0, ends)[tokens]
    data = out.tobytes()
    return [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"


def alignments(docs: DataFrame, path_a: str, path_b: str, work: int = WORK) -> DataFrame:
    """A row per row of ``docs``: numbers of tokens and groups, digest of the groups, and the distinct linked pairs with how
    often the document links them. A pair is one number: A's id times 2**32, and B's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(path_a, path_b)
        for batch in batches:
            for a, b in tx.text_slices(batch.column(1), SLICE_BYTES):
                found = align(known, batch.column(1).slice(a, b - a).to_pylist(), work)
                of = np.searchsorted(found.docs_b, found.groups_b, "left") - 1
                pair = found.ids_a[found.groups_a - 1].astype(np.int64) << 32 | found.ids_b[found.groups_b - 1]
                order = np.lexsort((pair, of))
                of, pair = of[order], pair[order]
                first = np.ones(len(of), bool)
                first[1:] = (of[1:] != of[:-1]) | (pair[1:] != pair[:-1])
                at = np.flatnonzero(first)
                offsets = np.searchsorted(of[at], np.arange(b - a + 1)).astype(np.int32)
                groups = np.bincount(of, minlength=b - a)
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(found.docs_a)),
                    pa.array(np.diff(found.docs_b)),
                    pa.array(groups.astype(np.int64)),
                    pa.array(_digests(found), pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(pair[at])),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.diff(np.append(at, len(of))).astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ALIGNED.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, b, n, best): links that hold a pair in the whole corpus, and whether no pair of its B id has more."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # no more rows leave a task than there are pairs
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pairs = np.concatenate([pairs, np.asarray(batch.column(0).flatten(), np.int64)])
            times = np.concatenate([times, np.asarray(batch.column(1).flatten(), np.int64)])
            pairs, inverse = np.unique(pairs, return_inverse=True)
            times = np.bincount(inverse, weights=times, minlength=len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])

    links = aligned.select("pairs", "times").mapInArrow(summed, "pair long, n long")
    counted = links.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_digest(docs: DataFrame, path_a: str, path_b: str, work: int = WORK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``."""
    aligned = stored(alignments(docs, path_a, path_b, work))
    # bounded by the vocabularies, see pair_bound
    counts = stored(pair_counts(aligned)).select("pair", "n", "best").toArrow()
    order = np.argsort(np.asarray(counts["pair"]))
    table = tuple(np.asarray(counts[c])[order] for c in ("pair", "n", "best"))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            of = np.repeat(np.arange(batch.num_rows), sizes)
            times = np.asarray(batch.column("times").flatten()).astype(np.int64)
            at = np.searchsorted(pair, np.asarray(lists.flatten()))

            def by_doc(values: np.ndarray, of: np.ndarray = of, rows: int = batch.num_rows) -> pa.Array:
                out = np.zeros(rows, np.int64)
                np.add.at(out, of, values)
                return pa.array(out)

            columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            columns += [by_doc(times), by_doc(times * best[at]), by_doc(times * n[at]), batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return aligned.mapInArrow(run, schema)
