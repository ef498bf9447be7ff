"""Quality classifier over learned subword embeddings.

A document is the average of the vectors of its hashed words and character n-grams, each kind averaged on its own first
so that the many n-grams don't drown the few words, and whether a word repeats the one before it being a kind of its
own. A softmax over that average gives the probability of each label. Vectors and output weights are learned together by stochastic gradient descent with
per-feature step sizes, in numpy, on a bounded sample of labelled documents. As averaging and the output layer are both
linear, scoring needs one learned number for each feature: whole texts are scored with gathers and prefix sums.

Defined results: null and empty texts have no features and get the score of the output bias alone; without any labelled
row every score is 0.5; rows are scored one by one, so repeated rows repeat their score. Label, language, source, doc_id
and other columns are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import text as tx
from tallymatch.llm.training import labelled_sample

HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


@dataclass(frozen=True)
class QualityConfig:
    """At most ``train_rows`` labelled documents are used for the fit, whole. ``grams`` are lengths in bytes."""

    train_rows: int = 5000
    buckets: int = 1 << 18
    dim: int = 8
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 3
    rate: float = 0.6
    threshold: float = 0.3
    seed: int = 11


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(data: np.ndarray, offsets: np.ndarray, config: QualityConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all features in order, kind by kind, with their offsets by text: words (runs without white space), for
    each word whether it repeats the one before, then the n-grams of each length over the bytes of the text as it is."""
    part = config.buckets // (2 + len(config.grams))
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    words = tx.span_hashes(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    yield (words % np.uint64(part)).astype(np.int64), at
    again = np.zeros(len(words), np.int64)
    again[1:] = words[1:] == words[:-1]
    again[at[:-1][at[:-1] < len(words)]] = 0
    yield part + again, at
    wide = data.astype(np.uint32)
    for k, n in enumerate(config.grams):
        size = max(len(data) - n + 1, 0)
        hashed = np.zeros(size, np.uint32)
        for j in range(n):
            hashed = (hashed + wide[j : j + size] + np.uint32(1)) * np.uint32(0x9E3779B1)
            hashed ^= hashed >> np.uint32(15)
        # an n-gram that would reach into the next text belongs to none: each text's range ends before it
        yield (hashed % np.uint32(part)).astype(np.int64) + (k + 2) * part, offsets


def _ranges(offsets: np.ndarray, kind: int, config: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """First and last feature of each text in one kind's features."""
    begin, stop = offsets[:-1], offsets[1:]
    if kind > 1:
        stop = np.maximum(stop - config.grams[kind - 2] + 1, begin)
    return begin, stop


@dataclass
class QualityModel:
    weight: np.ndarray  # per bucket: how far it moves the difference of the two outputs
    bias: float

    def score(self, texts: pa.Array, config: QualityConfig) -> np.ndarray:
        """Probability of label 1 for each text."""
        data, offsets = tx.utf8(texts, lower=False)
        z = np.full(len(texts), self.bias)
        for kind, (buckets, at) in enumerate(features(data, offsets, config)):
            begin, stop = _ranges(at, kind, config)
            sums = np.concatenate([[0.0], np.cumsum(self.weight[buckets], dtype=np.float64)])
            limit = len(buckets)
            begin, stop = np.minimum(begin, limit), np.minimum(stop, limit)
            z += (sums[stop] - sums[begin]) / np.maximum(stop - begin, 1) / (2 + len(config.grams))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _counts(texts: pa.Array, config: QualityConfig) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares for each text."""
    data, offsets = tx.utf8(texts, lower=False)
    kinds = list(features(data, offsets, config))
    out = []
    for i in range(len(texts)):
        parts, shares = [], []
        for kind, (buckets, at) in enumerate(kinds):
            begin, stop = _ranges(at[i : i + 2], kind, config)
            ids, n = np.unique(buckets[begin[0] : stop[0]], return_counts=True)
            parts.append(ids)
            shares.append(n / max(n.sum(), 1) / len(kinds))
        out.append((np.concatenate(parts).astype(np.int32), np.concatenate(shares).astype(np.float32)))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, config: QualityConfig) -> QualityModel:
    """Learn vectors and output weights by stochastic gradient descent."""
    weight = np.zeros(config.buckets)
    if not len(labels):
        return QualityModel(weight, 0.0)
    rng = np.random.default_rng(config.seed)
    vectors = rng.uniform(-1, 1, (config.buckets, config.dim)).astype(np.float32) / config.dim
    output = rng.normal(0, 0.5, (config.dim, 2)).astype(np.float32)
    bias = np.log(np.bincount(labels, minlength=2) + 1.0).astype(np.float32)
    seen = np.full(config.buckets, 1e-8, np.float32)
    seen_output, seen_bias = np.full(output.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    steps, step = len(labels) * config.epochs, 0
    for _ in range(config.epochs):
        for i in rng.permutation(len(labels)):
            ids, share = rows[i]
            rate = config.rate * (1 - step / steps)
            step += 1
            own = vectors[ids]
            hidden = share @ own
            z = hidden @ output + bias
            wrong = np.exp(z - z.max())
            wrong /= wrong.sum()
            wrong[labels[i]] -= 1
            to_hidden = output @ wrong
            to_output = np.outer(hidden, wrong)
            seen[ids] += share * share * (to_hidden @ to_hidden) / config.dim
            vectors[ids] = own - (rate * share / np.sqrt(seen[ids]))[:, None] * to_hidden
            seen_output += to_output**2
            output -= rate * to_output / np.sqrt(seen_output)
            seen_bias += wrong**2
            bias -= rate * wrong / np.sqrt(seen_bias)
    difference = output[:, 1] - output[:, 0]
    return QualityModel((vectors @ difference).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel:
    """Fit on labelled documents that aren't held out. Executors turn texts into distinct features with their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tx.text_slices(batch.column(0)):
                found = _counts(batch.column(0).slice(a, b - a), config)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(a, b - a), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float32()))],
                    ["label", "ids", "shares"],
                )

    sample = labelled_sample(docs, labels, "quality", config.train_rows, ~F.expr(HELD_OUT))
    rows = sample.mapInArrow(run, "label int, ids array<int>, shares array<float>").toArrow()
    at = rows.column("ids").combine_chunks()
    shares = rows.column("shares").combine_chunks()
    if isinstance(at, pa.ChunkedArray) or not len(rows):
        return fit([], np.zeros(0, np.int64), config)
    cuts = at.offsets.to_numpy()
    ids, weights = at.values.to_numpy(), shares.values.to_numpy()
    pairs = [(ids[a:b], weights[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return fit(pairs, np.asarray(rows.column("label").to_pylist(), np.int64), config)


def score_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = train(docs, labels, config)
    compact = QualityModel(model.weight.astype(np.float32), model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tx.text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(compact.score(batch.column(1).slice(a, b - a), config))], ["doc_id", "score"]
                )

    scored = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted")
    )
