"""Token counts of whole texts, long ones encoded in overlapping chunks and spliced where they provably agree.

A tokenizer of this kind first cuts a text into pieces by a pattern that looks ahead by one character but never back,
and then encodes each piece alone. A cut is therefore final if the text up to it was scanned from a known cut and the
chunk goes on for more than the longest special token after it. If the next chunk, scanned from an arbitrary start, has
a cut at the same place, everything it has from there on is what a scan of the whole text gives: the chunks are spliced
at that cut. Where no cut is shared inside the overlap (a long run without any, for example), the left chunk is encoded
again with the overlap doubled, at last to the end of the text.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside texts are handled as the library
does by default; repeated rows give repeated rows; other columns are neither read nor returned.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tallymatch.llm import text as tx

SLICE_BYTES = 1 << 20
CACHED_PIECES = 120_000


@dataclass(frozen=True)
class ResyncConfig:
    """Sizes in characters. Texts of up to ``chunk + overlap`` are encoded at once."""

    chunk: int = 32_768
    overlap: int = 512
    limit: int = 1024


@lru_cache(maxsize=4)
def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # the library remembers how it encoded a piece, 10,000 of them by default
    tokenizer.model._resize_cache(CACHED_PIECES)
    return tokenizer


@dataclass
class _Chunk:
    start: int
    end: int
    ids: list[int]
    cuts: dict[int, int]  # character position of a cut -> index of the token there


def _encoded(tokenizer, text: str, spans: Sequence[tuple[int, int]]) -> list[_Chunk]:
    out = []
    for (start, end), found in zip(spans, tokenizer.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False), strict=True):
        offsets, pieces = found.offsets, found.word_ids
        cuts, reached = {}, 0
        for i, (a, b) in enumerate(offsets):
            if a >= reached and (i == 0 or pieces[i] != pieces[i - 1]):
                cuts[start + a] = i
            reached = max(reached, b)
        out.append(_Chunk(start, end, found.ids, cuts))
    return out


def encode_long(tokenizer, text: str, config: ResyncConfig = ResyncConfig()) -> list[int]:
    """Token ids of one long text, equal to encoding it at once."""
    n, step = len(text), config.chunk
    reach = 2 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    starts = list(range(0, n, step))
    ids: list[int] = []
    left, taken = None, 0  # taken: tokens of the left chunk that are already out
    for group in range(0, len(starts), 16):
        spans = [(s, min(n, s + step + config.overlap)) for s in starts[group : group + 16]]
        for right in _encoded(tokenizer, text, spans):
            if left is None:
                left = right
                continue
            if right.end <= left.end:
                continue  # a widened left chunk holds all of it
            overlap = config.overlap
            while True:
                last = left.end - reach if left.end < n else n
                shared = min((p for p in left.cuts if right.start <= p <= last and left.cuts[p] >= taken and p in right.cuts), default=None)
                if shared is not None:
                    ids += left.ids[taken : left.cuts[shared]]
                    left, taken = right, right.cuts[shared]
                    break
                if left.end >= right.end:
                    break
                overlap *= 2
                left = _encoded(tokenizer, text, [(left.start, min(n, right.start + overlap))])[0]
    return ids + left.ids[taken:] if left else ids


def encode(tokenizer, texts: Sequence[str], config: ResyncConfig = ResyncConfig()) -> list[list[int]]:
    """Token ids of whole texts."""
    whole = [i for i, t in enumerate(texts) if len(t) <= config.chunk + config.overlap]
    out: list[list[int]] = [[]] * len(texts)
    for i, found in zip(whole, tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
        out[i] = found.ids
    for i, t in enumerate(texts):
        if len(t) > config.chunk + config.overlap:
            out[i] = encode_long(tokenizer, t, config)
    return out


def encoded(docs: DataFrame, path: str, config: ResyncConfig = ResyncConfig(), ids: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and, if asked for, the token ids of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for a, b in tx.text_slices(batch.column(1), SLICE_BYTES):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                found = encode(tokenizer, texts, config)
                n = [len(x) for x in found]
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > config.limit for x in n], pa.bool_()),
                ]
                names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                if ids:
                    columns.append(pa.array(found, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean" + (", ids array<int>" if ids else "")
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def token_counts(docs: DataFrame, path: str, config: ResyncConfig = ResyncConfig()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    return encoded(docs, path, config, ids=False)
