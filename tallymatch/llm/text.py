"""Words and word shingles of whole texts as 64-bit hashes, computed with numpy on Arrow buffers.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the lowercased text, but for
Unicode punctuation, spaces and controls, which separate words, and for the characters of scripts that are written without
spaces, each of which is a word. All functions work on whole texts; long ones are hashed piece by piece, so that working
memory stays at some megabytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
_PIECE = 1 << 18
SLICE_BYTES = 1 << 20  # of text that a task works on at once

_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _first, _last in ("09", "az", "AZ", "__"):
    _WORD[ord(_first) : ord(_last) + 1] = True

# Letters, marks and digits of scripts without spaces between words.
UNSPACED = (
    (0x0E01, 0x0E4E),  # Thai
    (0x0E50, 0x0E59),
    (0x0E81, 0x0EDF),  # Lao
    (0x1000, 0x1049),  # Burmese
    (0x1050, 0x109F),
    (0x1780, 0x17D3),  # Khmer
    (0x17E0, 0x17E9),
    (0x3005, 0x3007),  # Chinese and Japanese
    (0x3041, 0x3096),
    (0x309D, 0x309F),
    (0x30A1, 0x30FA),
    (0x30FC, 0x30FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F),
    (0x20000, 0x3FFFF),
)
_PART, _SEPARATOR, _WHOLE = 0, 1, 2  # of a word, between words, a word by itself

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def golden(n: int) -> np.uint64:
    """The n-th of a sequence of well spread constants."""
    return U64(n * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finalizer of a public hash)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def utf8(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets of each; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows that hold about ``limit`` in all, one row at least."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")))
        yield start, stop
        start = stop


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    return slices(sizes, limit)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        _powers = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, _BASE, U64))])
        _inverses = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, inverse, U64))])
    return _powers, _inverses


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; the spans are in order and don't overlap. Equal bytes have equal hashes."""
    out = np.empty(len(starts), U64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _PIECE, "right")))
        low, high = int(starts[a]), int(ends[b - 1])
        powers, inverses = _tables(high - low + 1)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum((data[low:high].astype(U64) + U64(1)) * powers[: high - low], out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(U64) * GOLDEN)
        a = b
    return out


@cache
def _kinds() -> np.ndarray:
    """What each code point beyond ASCII is to words. Planes from the third on hold no punctuation."""
    kinds = np.full(0x110000, _PART, np.uint8)
    for point in range(0x80, 0x20000):
        category = unicodedata.category(chr(point))
        if category[0] in "PZ" or category == "Cc":
            kinds[point] = _SEPARATOR
    for first, last in UNSPACED:
        kinds[first : last + 1] = _WHOLE
    return kinds


def _beyond_ascii(data: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Clear ``word`` at the bytes of separators, and return where characters that are words begin and end."""
    heads, cuts = np.flatnonzero(data >= 0xC0), []
    for start in range(0, len(heads), _PIECE):
        head = heads[start : start + _PIECE]
        first = data[head].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            point[more] = point[more] << 6 | data[head[more] + k] & 0x3F
        kind = _kinds()[point]
        for k in range(4):
            word[head[(kind == _SEPARATOR) & (size > k)] + k] = False
        whole = kind == _WHOLE
        cuts += [head[whole], head[whole] + size[whole]]
    return np.concatenate(cuts) if cuts else heads


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, none across two texts."""
    word = _WORD[data]
    cuts = np.concatenate([offsets[1:-1], _beyond_ascii(data, word)])
    cuts = cuts[cuts < len(word)]
    before = np.empty(len(word), bool)
    before[:1] = False
    before[1:] = word[:-1]
    before[cuts] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(word), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    after[cuts[cuts > 0] - 1] = False
    return starts, np.flatnonzero(word & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offset of each text's first word."""
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, with offsets by text. A text with fewer words has one shingle of them all,
    a text without words none."""
    n = len(hashes)
    counts = np.diff(offsets)
    out_counts = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    out_offsets = np.concatenate([[0], np.cumsum(out_counts)]).astype(np.int64)
    rolled = np.zeros(n, U64)
    for k in range(min(size, n)):
        term = mix(hashes + golden(k + 1)) * U64(2 * k + 3)
        rolled[: n - k] += term[k:] if k else term
    within = np.repeat(np.arange(len(counts)), out_counts)
    at = np.arange(out_offsets[-1]) - out_offsets[within] + offsets[within]
    out = mix(rolled[at])
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        whole = hashes[offsets[i] : offsets[i + 1]]
        places = np.arange(1, len(whole) + 1, dtype=U64)
        out[out_offsets[i]] = mix(np.array([(mix(whole + places * GOLDEN) * (places * U64(2) + U64(1))).sum() + U64(len(whole))], U64))[0]
    return out, out_offsets


def counted(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values by text: their text, value and count, sorted by text and value."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(first)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))
