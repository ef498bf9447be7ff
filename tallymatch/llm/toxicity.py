"""Toxicity by a classifier chain.

Categories are predicted one after the other by sparse logistic models over the words and word beginnings of a text. A
later model also gets the probabilities of the earlier categories. In training these are out-of-fold predictions, so
that a later model learns how far to trust earlier ones on texts they have not seen. The last category is the label
``toxic`` itself and decides.

The labels name no kinds of toxicity, so the earlier categories are learned: the labelled toxic texts are grouped by the
words that speak for the label (spherical k-means), and each group is a category, the largest first. No word list is
involved, whatever the language.

Defined results: null and empty texts get the probabilities of the biases alone; without labelled rows, or with a
category that no sampled row has (fewer different toxic texts than groups), its probability is 0; toxic texts without a
word that speaks for the label are in no group; rows are scored one by one. Other columns are not read.
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

CONTINUED = np.uint64(0x5851F42D4C957F2D)  # tells a word's beginning from the same bytes as a whole word


@dataclass(frozen=True)
class ToxicityConfig:
    """At most ``train_rows`` labelled documents are used for the fit, whole. Of the words and beginnings in them, the
    ``features`` that differ most between the labels are used. Toxic texts are put into ``groups`` groups, the best of
    ``starts`` groupings."""

    train_rows: int = 6000
    features: int = 512
    beginning: int = 6
    groups: int = 4
    starts: int = 8
    folds: int = 4
    penalty: float = 1e-4
    steps: int = 150
    threshold: float = 0.5

    @property
    def categories(self) -> tuple[str, ...]:
        return (*[f"group_{i + 1}" for i in range(self.groups)], "toxic")


def _tokens(texts: pa.Array, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and hashes of all words, and of the first bytes of longer ones."""
    data, offsets = tx.utf8(texts)
    starts, ends = tx.word_spans(data, offsets)
    of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    words = tx.span_hashes(data, starts, ends)
    long = ends - starts > config.beginning
    first = tx.span_hashes(data, starts[long], starts[long] + config.beginning) ^ CONTINUED
    return np.concatenate([of, of[long]]), np.concatenate([words, first])


@dataclass
class ChainModel:
    vocabulary: np.ndarray  # sorted hashes
    links: list[tuple[np.ndarray, float]]  # weights over vocabulary and earlier probabilities, bias

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        """n x categories, each link fed with those before it."""
        out = np.zeros((len(present), len(self.links)))
        for i, (weights, bias) in enumerate(self.links):
            out[:, i] = _sigmoid(present @ weights[: len(self.vocabulary)] + out[:, :i] @ weights[len(self.vocabulary) :] + bias)
        return out

    def score(self, texts: pa.Array, config: ToxicityConfig) -> np.ndarray:
        of, hashes = _tokens(texts, config)
        return self.probabilities(_presence(of, hashes, len(texts), self.vocabulary))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _presence(of: np.ndarray, hashes: np.ndarray, n: int, vocabulary: np.ndarray) -> np.ndarray:
    present = np.zeros((n, len(vocabulary)), np.float32)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        hit = vocabulary[at] == hashes
        present[of[hit], at[hit]] = 1
    return present


def _select(sets: list[np.ndarray], toxic: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """Hashes whose share of toxic texts is furthest from what chance gives, in standard deviations."""
    if not sets or not any(map(len, sets)):
        return np.zeros(0, np.uint64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    lengths = [len(s) for s in sets]
    n = np.bincount(place, minlength=len(values)).astype(np.float64)
    hits = np.bincount(place, weights=np.repeat(toxic, lengths), minlength=len(values))
    rate = toxic.mean()
    z = np.where(n > 1, np.abs(hits - n * rate) / np.sqrt(n * rate * (1 - rate) + 1e-12), 0.0)
    best = np.argsort(-z, kind="stable")[: config.features]
    return np.sort(values[best[z[best] > 0]])


def _logistic(x: np.ndarray, y: np.ndarray, config: ToxicityConfig) -> tuple[np.ndarray, float]:
    """Sparse logistic regression: accelerated proximal gradient with a penalty on the sum of absolute weights."""
    width = x.shape[1]
    if not len(y) or not y.any():
        return np.zeros(width), -60.0
    if y.all():
        return np.zeros(width), 60.0
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    probe = np.ones(width + 1, np.float32)
    for _ in range(20):  # largest eigenvalue, for the step size
        probe = x.T @ (x @ probe)
        probe /= np.linalg.norm(probe)
    step = 4 * len(y) / max(float(probe @ (x.T @ (x @ probe))), 1e-12)
    w = np.zeros(width + 1, np.float32)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    ahead, t = w.copy(), 1.0
    for _ in range(config.steps):
        gradient = x.T @ (_sigmoid(x @ ahead) - y).astype(np.float32) / len(y)
        new = ahead - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * config.penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w[:-1].astype(np.float64), float(w[-1])


def toxic_groups(present: np.ndarray, toxic: np.ndarray, config: ToxicityConfig) -> np.ndarray:
    """The group of each text, from 0 by falling size; -1 for texts that are not toxic or have no word that speaks for it."""
    group = np.full(len(present), -1)
    if not toxic.any():
        return group
    speaks = present[toxic].mean(axis=0) > present.mean(axis=0)
    x = present[np.ix_(toxic, speaks)].astype(np.float64)
    x *= np.log(len(x) / np.maximum(x.sum(axis=0), 1)) + 1  # rarer words tell groups apart
    norm = np.linalg.norm(x, axis=1)
    members = np.flatnonzero(toxic)[norm > 0]
    x = x[norm > 0] / norm[norm > 0, None]
    if not len(x):
        return group
    of = max((_grouped(x, config.groups, np.random.default_rng(start)) for start in range(config.starts)), key=lambda found: found[1])[0]
    # equal sizes: the one that holds the first text
    used, first, sizes = np.unique(of, return_index=True, return_counts=True)
    rank = np.empty(len(used), int)
    rank[np.lexsort((first, -sizes))] = np.arange(len(used))
    group[members] = rank[np.searchsorted(used, of)]
    return group


def _grouped(x: np.ndarray, groups: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Spherical k-means on rows of length 1: the group of each row, and the sum of cosines with the group's centre."""
    centres = x[[rng.integers(len(x))]]
    for _ in range(groups - 1):
        far = np.maximum(1 - (x @ centres.T).max(axis=1), 0)
        if far.sum() < 1e-9:  # every row is a centre
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    of = np.full(len(x), -1)
    while True:
        cosine = x @ centres.T
        nearest = cosine.argmax(axis=1)
        # a row moves only for a better centre, so that the sum grows and the loop ends
        at = np.arange(len(x))
        moves = (of < 0) | (cosine[at, nearest] > cosine[at, of] + 1e-12)
        if not moves.any():
            return of, float(cosine[at, of].sum())
        of = np.where(moves, nearest, of)
        sums = np.stack([x[of == c].sum(axis=0) for c in range(len(centres))])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)


def fit(sets: list[np.ndarray], toxic: np.ndarray, config: ToxicityConfig) -> ChainModel:
    """Fit the chain on the hashed words of sampled texts (arrays of distinct hashes) and their labels."""
    vocabulary = _select(sets, toxic, config)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    present = _presence(of, np.concatenate(sets) if sets else np.zeros(0, np.uint64), len(sets), vocabulary)
    group = toxic_groups(present, toxic == 1, config)
    marks = [*[group == i for i in range(config.groups)], toxic == 1]
    fold = np.arange(len(sets)) % config.folds
    links = []
    earlier = np.zeros((len(sets), 0), np.float32)
    for mark in marks:
        x = np.hstack([present, earlier])
        y = mark.astype(np.float32)
        links.append(_logistic(x, y, config))
        if len(links) == len(marks):
            break
        unseen = np.zeros(len(sets))
        for k in range(config.folds):
            weights, bias = _logistic(x[fold != k], y[fold != k], config)
            unseen[fold == k] = _sigmoid(x[fold == k] @ weights + bias)
        earlier = np.hstack([earlier, unseen[:, None].astype(np.float32)])
    return ChainModel(vocabulary, links)


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ChainModel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tx.text_slices(batch.column(0)):
                of, hashes = _tokens(batch.column(0).slice(a, b - a), config)
                sets = [np.unique(hashes[of == i]).view(np.int64) for i in range(b - a)] if b - a < 8 else _by_text(of, hashes, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], ["label", "words"])

    sample = labelled_sample(docs, labels, "toxic", config.train_rows)
    rows = sample.mapInArrow(run, "label int, words array<long>").toArrow()
    if not len(rows):
        return fit([], np.zeros(0), config)
    lists = rows.column("words").combine_chunks()
    cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    return fit([values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], np.asarray(rows.column("label").to_pylist(), np.float64), config)


def _by_text(of: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """Distinct hashes of each text."""
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    of, hashes = of[first], hashes[first]
    cuts = np.searchsorted(of, np.arange(n + 1))
    return [hashes[a:b].view(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]


def score_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """doc_id, the probability of each category (p_group_1 and so on, p_toxic), and toxic, for every row."""
    model = train(docs, labels, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tx.text_slices(batch.column(1)):
                p = model.score(batch.column(1).slice(a, b - a), config)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *[pa.array(c) for c in p.T]], ["doc_id", *[f"p_{c}" for c in config.categories]]
                )

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in config.categories)
    scored = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)
    return scored.withColumn("toxic", F.col("p_toxic") >= config.threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, unchanged."""
    model = train(docs, labels, config)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tx.text_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                kept = model.score(part.column(at), config)[:, -1] < config.threshold
                if kept.any():
                    yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
