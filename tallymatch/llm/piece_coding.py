"""SentencePiece encoding and decoding in numpy, equal to the library for byte-pair models.

A text is cut into units no piece reaches across. All new units of a batch advance together through a Viterbi pass, those
of equal length from the first character to the last: at each position hashes of the substrings that end there probe the sorted keys of the pieces, the
score of a piece is (whether it can stand behind the best piece before it, its length), and the maximum is stored as backpointer. A piece pair can
stand side by side if merging by rank leaves their border alone; that is a walk down the merge trees of both, done for
all candidates at once. For a model of merges the best path is unique and is what merging itself gives; a plain sum of
piece scores would choose other pieces.

Runs of spaces have pieces of equal rank, behind all others; of equal ranks the leftmost is merged first. So words are
whole before any of them is made, and two of them can stand side by side if merging as many spaces gives just these two.

A unit of over 4,096 characters has nothing to advance with. All its substrings are probed and all pairs of pieces that
can meet are scored in numpy, window by window; then one pass over its positions takes the maxima.
Characters without a piece become byte pieces.

Defined results: null and empty texts have no ids; the space mark U+2581 in a text counts as a space, as in the library;
repeated rows repeat their ids; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymatch.llm import text as tx

U64 = np.uint64
MARK = "▁"
LEARN_BYTES = 4 << 20  # units of so much text are encoded together
SLICE_BYTES = 1 << 20
CACHED_UNITS = 250_000
_UNITS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


_POWERS = np.cumprod(np.full(1 << 12, 0x100000001B3, U64))
_INVERSES = np.cumprod(np.full(1 << 12, pow(0x100000001B3, -1, 1 << 64), U64))
LONGEST_CLASS = len(_POWERS)


def _prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any substring of a row follows at once."""
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), U64)
    np.cumsum((codes.astype(U64) + U64(1)) * _POWERS[: codes.shape[1]], axis=1, out=sums[:, 1:])
    return sums


def _span_hash(sums: np.ndarray, rows: np.ndarray, start: int, end: int) -> np.ndarray:
    return tx.mix((sums[rows, end] - sums[rows, start]) * _INVERSES[start] + tx.golden(end - start))


def _runs_hash(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of substrings of one length in a single row."""
    return tx.mix((sums[0, starts + length] - sums[0, starts]) * _INVERSES[starts] + tx.golden(length))


class PieceModel:
    """Pieces of a byte-pair model, their ranks and merge trees."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        pieces = [library.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.unknown = library.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        self.bytes: list[bytes] = [p.replace(MARK, " ").encode() for p in pieces]
        for i, p in enumerate(pieces):
            if library.is_byte(i):
                self.byte_ids[int(_BYTE.fullmatch(p)[1], 16)] = i
                self.bytes[i] = bytes([int(_BYTE.fullmatch(p)[1], 16)])
            elif library.is_control(i):
                self.bytes[i] = b""
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on after a space: units can't be cut there")
        self.ids = {pieces[i]: i for i in plain}
        score = {p: library.get_score(i) for p, i in self.ids.items()}
        self.rank_of = {p: r for r, p in enumerate(sorted(self.ids, key=lambda p: -score[p]))}
        self.score = score
        self.longest = max(map(len, self.ids))
        self._trees()
        self._spaces()
        self._probes()

    def merged(self, unit: str) -> list[str]:
        """The unit after merging neighbours by best score, leftmost first, in n log n steps."""
        parts: list[str | None] = list(unit)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if both in self.score:
                heapq.heappush(heap, (-self.score[both], i, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            # one of the two may have been merged since
            if parts[i] is None or j == n or len(parts[i]) + len(parts[j]) != len(both):
                continue
            parts[i], parts[j], right[i] = both, None, right[j]
            if right[i] < n:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in parts if p is not None]

    def _trees(self) -> None:
        """For each piece that merging can make: rank, and the two pieces it was merged from last."""
        n = len(self.bytes)
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.made = np.zeros(n, bool)
        keys, merged = [], []
        for p, i in self.ids.items():
            if len(p) == 1:
                self.made[i] = True
            elif p.strip(MARK):
                parts = list(p)
                while len(parts) > 2:
                    best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
                    if best is None:
                        break
                    parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
                if len(parts) == 2 and all(x in self.ids for x in parts):
                    self.made[i] = True
                    self.rank[i] = self.rank_of[p]
                    self.left[i], self.right[i] = self.ids[parts[0]], self.ids[parts[1]]
            for k in range(1, len(p)):
                if p[:k] in self.ids and p[k:] in self.ids:
                    keys.append(self.ids[p[:k]] * n + self.ids[p[k:]])
                    merged.append(self.rank_of[p])
        children = np.flatnonzero(self.left >= 0)
        if (self.rank[children] <= np.maximum(self.rank[self.left[children]], self.rank[self.right[children]])).any():
            raise ValueError("the model's pieces aren't ranked in the order of their merges")
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.pair_bits = np.zeros(1 << 21, bool)
        self.pair_bits[(tx.mix(self.pair_keys.view(U64)) >> U64(43)).astype(np.int64)] = True

    def _spaces(self) -> None:
        """Which pieces of spaces alone merging makes, and which two of them can stand side by side."""
        runs = {len(p): i for p, i in self.ids.items() if not p.strip(MARK)}
        others = [s for p, s in self.score.items() if len(p) > 1 and p.strip(MARK)]
        if any(self.score[MARK * k] >= min(others, default=0) for k in runs if k > 1):
            raise ValueError("spaces are merged before words")
        split = {k: [len(p) for p in self.merged(MARK * k)] for k in range(1, 2 * max(runs, default=0) + 1)}
        self.spaces = np.zeros(len(self.bytes), np.int64)  # length of a piece of spaces
        for k, i in runs.items():
            self.spaces[i] = k
            self.made[i] = split[k] == [k]
        self.space = runs.get(1, -1)
        self.space_pairs = np.zeros((max(runs, default=0) + 1,) * 2, bool)
        for a in runs:
            for b in runs:
                self.space_pairs[a, b] = split[a + b] == [a, b]

    def _probes(self) -> None:
        """Sorted hashes of all pieces by length."""
        self.probe: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[str]] = {}
        for p, i in self.ids.items():
            if self.made[i]:
                by_length.setdefault(len(p), []).append(p)
        for length, pieces in by_length.items():
            codes = np.array([[ord(c) for c in p] for p in pieces], np.uint32)
            hashes = _span_hash(_prefix_sums(codes), np.arange(len(codes)), 0, length)
            order = np.argsort(hashes)
            self.probe[length] = hashes[order], np.array([self.ids[p] for p in pieces], np.int64)[order]
        self.bits: dict[int, np.ndarray] = {}
        for length, (hashes, _) in self.probe.items():
            self.bits[length] = np.zeros(1 << 18, bool)
            self.bits[length][(hashes >> U64(46)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Piece of each hashed substring of one length, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        known, ids = self.probe[length]
        likely = np.flatnonzero(self.bits[length][(hashes >> U64(46)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, hashes[likely]), len(known) - 1)
        hit = known[at] == hashes[likely]
        out[likely[hit]] = ids[at[hit]]
        return out

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that both would merge to; very large if there is none."""
        out = np.full(len(a), 1 << 40, np.int64)
        keys = a * len(self.bytes) + b
        likely = np.flatnonzero(self.pair_bits[(tx.mix(keys.view(U64)) >> U64(43)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.pair_keys, keys[likely]), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys[likely]
        out[likely[hit]] = self.pair_ranks[at[hit]]
        return out

    def stand_together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between pieces ``a`` and ``b`` alone.

        Undo the merges next to the border, latest first. Between two undone merges the two pieces at the border stood
        side by side; had they a merge of better rank than the one undone last, it would have come first. Of equal
        ranks the left one comes first.
        """
        good = np.ones(len(a), bool)
        both = (self.spaces[a] > 0) & (self.spaces[b] > 0)
        good[both] = self.space_pairs[self.spaces[a[both]], self.spaces[b[both]]]
        at = np.flatnonzero(~both)
        # when a word meets spaces they are single ones still
        a, b = np.where(self.spaces[a] > 0, self.space, a)[at], b[at]
        limit = np.full(len(a), 1 << 30, np.int64)  # twice the rank undone last, and one more on the right side
        while len(at):
            crossed = 2 * self._pair_rank(a, b) < limit
            good[at[crossed]] = False
            on = ~crossed & ((self.left[a] >= 0) | (self.left[b] >= 0))
            at, a, b = at[on], a[on], b[on]
            undo_left = self.rank[a] > self.rank[b]
            limit = np.where(undo_left, 2 * self.rank[a], 2 * self.rank[b] + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def _paths(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last piece and its start on the best path to each position; units in order of falling length. A character
        without a piece has -2, the start -1."""
        n, width = codes.shape
        if width > LONGEST_CLASS:
            return self._long_path(codes)
        last = np.full((n, width + 1), -1, np.int64)
        back = np.zeros((n, width + 1), np.int64)
        sums = _prefix_sums(codes)
        for i in range(1, width + 1):
            going = int(np.searchsorted(-lengths, -i, "right"))
            open_ = np.arange(going)
            for k in range(min(i, self.longest), 0, -1):
                if not len(open_):
                    break
                if k not in self.probe:
                    continue
                piece = self.find(_span_hash(sums, open_, i - k, i), k)
                hit = np.flatnonzero(piece >= 0)
                if not len(hit):
                    continue
                rows, piece = open_[hit], piece[hit]
                before = last[rows, i - k]
                score = np.ones(len(rows), bool)
                real = np.flatnonzero(before >= 0)
                score[real] = self.stand_together(before[real], piece[real])
                won = rows[score]
                last[won, i], back[won, i] = piece[score], i - k
                open_ = np.delete(open_, hit[score])
            last[open_, i], back[open_, i] = -2, i - 1
        return last, back

    def _candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End, length and piece of all substrings of a row that are pieces, by end and falling length."""
        sums = _prefix_sums(codes[None])
        ends, sizes, pieces = [], [], []
        for k in sorted(self.probe, reverse=True):
            starts = np.arange(max(len(codes) - k + 1, 0))
            found = self.find(_runs_hash(sums, starts, k), k)
            hit = np.flatnonzero(found >= 0)
            ends.append(starts[hit] + k)
            sizes.append(np.full(len(hit), k))
            pieces.append(found[hit])
        end, size, piece = np.concatenate(ends), np.concatenate(sizes), np.concatenate(pieces)
        order = np.argsort(end, kind="stable")
        return end[order], size[order], piece[order]

    def _long_path(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_paths`` of a single long unit."""
        n = len(self.bytes)
        last, sizes = [-1], [0]
        stands: dict[int, bool] = {}
        step = LONGEST_CLASS - self.longest
        for a in range(0, codes.shape[1], step):
            low = max(0, a - self.longest)
            end, size, piece = self._candidates(codes[0, low : a + step])
            cuts = np.searchsorted(end, np.arange(codes[0, low : a + step].size + 2))
            # every candidate behind every candidate that ends where it begins
            first, stop = cuts[end - size], cuts[end - size + 1]
            behind = np.repeat(np.arange(len(end)), stop - first)
            before = np.arange(len(behind)) - np.repeat(np.cumsum(stop - first) - (stop - first), stop - first) + first[behind]
            keys = np.unique(piece[before] * n + piece[behind])
            if len(stands) > CACHED_UNITS:
                stands.clear()
            stands.update(zip(keys.tolist(), self.stand_together(keys // n, keys % n).tolist(), strict=True))
            bounds, lengths, pieces = cuts.tolist(), size.tolist(), piece.tolist()
            for e in range(a + 1, min(a + step, codes.shape[1]) + 1):
                best, length = -2, 1
                for c in range(bounds[e - low], bounds[e - low + 1]):
                    x = last[e - lengths[c]]
                    if x >= 0:
                        key = x * n + pieces[c]
                        if key not in stands:  # x began before this window
                            stands[key] = bool(self.stand_together(np.array([x]), np.array([pieces[c]]))[0])
                        if not stands[key]:
                            continue
                    best, length = pieces[c], lengths[c]
                    break
                last.append(best)
                sizes.append(length)
        return np.array([last]), np.arange(len(last))[None] - np.array([sizes])

    def _viterbi(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the units, and the number of each."""
        last, back = self._paths(codes, lengths)
        rows, at = np.arange(len(codes)), lengths.copy()
        found_rows, found_ends, found_ids = [], [], []
        while len(rows):
            piece = last[rows, at]
            start = back[rows, at]
            known = piece >= 0
            found_rows.append(rows[known])
            found_ends.append(at[known] * 8)
            found_ids.append(piece[known])
            for r, e in zip(rows[~known], at[~known], strict=True):
                spelled = self.byte_ids[np.frombuffer(chr(codes[r, e - 1]).encode(), np.uint8)]
                found_rows.append(np.full(len(spelled), r))
                found_ends.append(e * 8 - 7 + np.arange(len(spelled)))
                found_ids.append(spelled)
            at = start
            rows, at = rows[at > 0], at[at > 0]
        unit, end, ids = np.concatenate(found_rows), np.concatenate(found_ends), np.concatenate(found_ids)
        order = np.lexsort((end, unit))
        return ids[order].astype(np.int32), np.bincount(unit, minlength=len(codes))

    def encode_units(self, units: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the units in order, and the number of each. Units of similar length make a class."""
        out: list[np.ndarray] = []
        order: list[np.ndarray] = []
        sizes = np.zeros(len(units), np.int64)
        classes: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            classes.setdefault((len(u) - 1).bit_length(), []).append(i)
        for members in classes.values():
            members.sort(key=lambda i: -len(units[i]))
            longest = len(units[members[0]])
            step = max(1, 1_000_000 // longest) if longest <= LONGEST_CLASS else 1
            for a in range(0, len(members), step):
                part = np.array(members[a : a + step])
                lengths = np.array([len(units[i]) for i in part])
                codes = np.zeros((len(part), lengths[0]), np.uint32)
                codes[np.arange(lengths[0]) < lengths[:, None]] = np.frombuffer("".join([units[i] for i in part]).encode("utf-32-le"), np.uint32)
                ids, n = self._viterbi(codes, lengths)
                out.append(ids)
                order.append(part)
                sizes[part] = n
        flat = np.concatenate([np.zeros(0, np.int32), *out])
        place = np.concatenate([np.zeros(0, np.int64), *order])
        starts = np.zeros(len(units), np.int64)
        starts[place] = np.cumsum(sizes[place]) - sizes[place]
        ends = np.cumsum(sizes)
        return flat[np.arange(len(flat)) + np.repeat(starts - (ends - sizes), sizes)], sizes


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def units_of(text: str) -> list[str]:
    """Units of a text in order: a run of spaces with the word after it, or a line break."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[0] == " ":
        return _UNITS.findall(MARK + text.replace(" ", MARK))
    found = (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
    return [u for u in found if u] if "" in found else found


class Encoder:
    """Encodes texts; ids of units are kept from batch to batch, up to a bound."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def learn(self, texts: Iterable[str]) -> None:
        """Encode all units of the texts that aren't known yet, together."""
        if len(self.known) > CACHED_UNITS:
            self._forget()
        known, before = self.known, len(self.known)
        for t in texts:
            for u in units_of(t):
                if u not in known:
                    known[u] = len(known)
        if len(known) > before:
            ids, sizes = self.model.encode_units(list(islice(known, before, None)))
            self.flat = np.concatenate([self.flat, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts whose units are known, and the offsets of each text."""
        known = self.known
        places: list[int] = []
        counts = []
        for t in texts:
            units = units_of(t)
            counts.append(len(units))
            places += [known[u] for u in units]
        place = np.array(places, np.int64)
        sizes = self.starts[place + 1] - self.starts[place]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(ends[-1]) + np.repeat(self.starts[place] - ends[:-1], sizes)
        return self.flat[at], ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(load(path))


def decode(model: PieceModel, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of encoded ids: bytes of the pieces in a row, without the space that encoding puts in front."""
    pieces = model.bytes
    out = []
    for a, b in zip(offsets, offsets[1:], strict=False):
        found = b"".join([pieces[i] for i in ids[a:b].tolist()])
        out.append(found.removeprefix(b" ").decode("utf-8", "replace"))
    return out


SCHEMA = "doc_id long, n_pieces long, round_trip boolean, ids array<int>"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, round_trip (decoding gives the text back, space marks as spaces) and the ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            for first, stop in tx.text_slices(texts, LEARN_BYTES):
                coder.learn(t.as_py() or "" for t in texts.slice(first, stop - first))
                yield from coded(coder, batch.slice(first, stop - first))

    def coded(coder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in tx.text_slices(batch.column(1), SLICE_BYTES):
            texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
            ids, offsets = coder.encode(texts)
            back = decode(coder.model, ids, offsets)
            same = [x == (t.replace(MARK, " ") if MARK in t else t) for x, t in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(offsets)),
                    pa.array(same, pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ],
                ["doc_id", "n_pieces", "round_trip", "ids"],
            )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of every row of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = decode(model, np.concatenate([np.zeros(0, np.int32), *lists]), offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(run, "doc_id long, text string")
