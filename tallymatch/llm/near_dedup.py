"""MinHash near-duplicates by DartMinHash.

Every text is a weighted set: its word 5-shingles with their counts. Hashed darts are thrown at the plane of weight and
rank above each element, the same darts for every text. A dart counts for a text if it lands below the element's
weight; each signature coordinate keeps the dart of lowest rank that falls to it. Two texts keep the same dart with the
probability of their weighted Jaccard similarity, at a cost of elements + k log k instead of elements * k.

Steps, all distributed:

1. Signatures. Texts with the same words form one class, represented by its smallest doc_id.
2. Signatures are cut into bands; classes that share a band meet in a bucket. Buckets with the same members are taken
   once. In blocks of bounded size a bucket's estimated similarities are reduced to a spanning forest, so a bucket gives
   fewer edges than members.
3. Connected estimates form clusters. Within a cluster the shingles themselves are compared, again in bounded blocks
   that give a spanning forest. Texts of clusters are fetched once for that.

Buckets and clusters of more than a block are joined as ``blocks.group_components`` describes: random parts, two times over, and
then only what is not in the largest component with the rest, exhaustively.

Defined results: a null or empty text, or one without words, is a class of its own and is never linked; texts of fewer
than five words have one shingle; equal texts are one class and one component; a row without doc_id is kept and has no
component; rows that repeat a doc_id with the same words are copies, and different texts of a doc_id are compared like
those of different documents: each is linked, and kept or not, by itself. Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import text as tx
from tallymatch.llm.blocks import crossing_edges, forest, group_components, stars
from tallymatch.llm.membership import maybe_in
from tallymatch.llm.storage import discard, stored
from tallymatch.operators.lookup import lookup

U64 = np.uint64
EMPTY = U64(0xFFFFFFFFFFFFFFFF)
SLICE_BYTES = 1 << 18  # of text whose darts are thrown at once
_FIRST_BAND = -6  # ranks below 2**-6 form the first cell of an element


@dataclass(frozen=True)
class NearConfig:
    """``bands * rows`` coordinates; a pair at the threshold shares no band with probability (1 - 0.8**rows)**bands, 5e-5
    here. ``margin`` is how far below the threshold an estimate may lie for the pair to be compared exactly: over four
    standard deviations. Blocks hold at most two parts of ``block_rows`` rows or ``block_words`` words."""

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5
    margin: float = 0.16
    block_rows: int = 256
    block_words: int = 400_000


# --- signatures --------------------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _poisson(area: float) -> np.ndarray:
    """Cumulative probabilities of the number of darts in a cell."""
    n = np.arange(int(area + 14 * np.sqrt(area) + 24))
    logs = n * np.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(n))))])
    return np.cumsum(np.exp(logs))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures, n_docs by k; ``EMPTY`` throughout for a document without elements.

    The plane above an element is cut into cells of weight 1 and of ranks [0, 2**-6), [2**-6, 2**-5), ... A cell's darts
    follow from hashes of element and cell alone. Ranks are opened upwards until every coordinate has a dart: first as
    far as k log k + 2 k darts are to be expected for the document, then doubled for those with a coordinate left.
    """
    signature = np.full((n_docs, k), EMPTY, U64)
    if not len(doc):
        return signature
    flat = signature.reshape(-1)
    cells = np.ceil(weight).astype(np.int64)
    unit_of = np.repeat(np.arange(len(doc)), cells)
    level = np.arange(len(unit_of)) - np.repeat(np.cumsum(cells) - cells, cells)
    room = weight[unit_of] - level
    unit_doc = doc[unit_of]
    region = tx.mix(element[unit_of] + level.astype(U64) * tx.GOLDEN)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    target = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    done = np.zeros(n_docs, np.int64)
    needed = total > 0
    while needed.any():
        upto = np.maximum(np.ceil(np.log2(np.maximum(target, 2.0**_FIRST_BAND))).astype(np.int64) - _FIRST_BAND + 1, 1)
        for band in range(int(done[needed].min()), int(upto[needed].max())):
            active = needed & (done <= band) & (upto > band)
            if not active.any():
                continue
            low = 0.0 if band == 0 else 2.0 ** (band - 1 + _FIRST_BAND)
            width = 2.0**_FIRST_BAND if band == 0 else low
            unit = np.flatnonzero(active[unit_doc])
            cell = tx.mix(region[unit] ^ tx.golden(3 * band + 7))
            darts = np.searchsorted(_poisson(width), _unit(cell), "right")
            hit = np.flatnonzero(darts)
            if not len(hit):
                continue
            darts, unit, cell = darts[hit], unit[hit], cell[hit]
            owner = np.repeat(np.arange(len(hit)), darts)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(darts) - darts, darts)
            place = tx.mix(cell[owner] + (nth + 1).astype(U64) * tx.GOLDEN)
            identity = tx.mix(place + tx.GOLDEN)
            rank = low + width * _unit(place)
            inside = _unit(tx.mix(identity + tx.GOLDEN)) < room[unit[owner]]
            coordinate = (identity % U64(k)).astype(np.int64)
            value = (rank.astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (identity >> U64(32))
            np.minimum.at(flat, (unit_doc[unit[owner]] * k + coordinate)[inside], value[inside])
        done = np.where(needed, np.maximum(done, upto), done)
        needed &= (signature == EMPTY).any(axis=1)
        target = np.where(needed, target * 2, target)
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), U64)
    for r in range(rows):
        out = tx.mix(out * U64(31) + signature[:, r : bands * rows : rows] + tx.golden(r + 1))
    return out


SIGNATURE_SCHEMA = "doc_id long, content long, key string, n_words long, bands array<long>, signature binary"


def signatures(docs: DataFrame, config: NearConfig) -> DataFrame:
    """A row per row of ``docs``: hash of the text, class key (null without words), number of words, band keys, signature."""
    k = config.bands * config.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents, texts = batch.columns
            for a, b in tx.text_slices(texts, SLICE_BYTES):
                hashes, offsets = tx.words(*tx.utf8(texts.slice(a, b - a)))
                doc, element, weight = tx.counted(*tx.shingles(hashes, offsets, config.shingle))
                signature = dart_minhash(doc, element, weight.astype(np.float64), b - a, k)
                keys = band_keys(signature, config.bands, config.rows)
                short = (signature ^ (signature >> U64(32))).astype(np.uint32)
                n = np.diff(offsets)
                text_keys = [_class_key(hashes[offsets[i] : offsets[i + 1]]) if n[i] else None for i in range(b - a)]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(b - a + 1, dtype=np.int32) * config.bands), pa.array(keys.view(np.int64).ravel())
                )
                columns = [ids.slice(a, b - a), contents.slice(a, b - a), pa.array(text_keys, pa.string()), pa.array(n), lists]
                columns.append(pa.array([x.tobytes() for x in short], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "key", "n_words", "bands", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, SIGNATURE_SCHEMA)


def _class_key(hashes: np.ndarray) -> str:
    """128 bits of a word sequence: equal sequences have equal keys."""
    places = np.arange(1, len(hashes) + 1, dtype=U64)
    one = tx.mix(hashes + places * tx.GOLDEN)
    two = tx.mix(one ^ U64(0xA0761D6478BD642F))
    return f"{int(one.sum()):016x}{int((two * (places + places + U64(1))).sum()):016x}"


# --- candidates --------------------------------------------------------------------------------------------------


def _agreement(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Share of equal coordinates: the estimated similarity of all rows of one side with all of the other."""
    ours, others = (np.frombuffer(b"".join(x["signature"]), np.uint32).reshape(len(x), -1) for x in (left, right))
    equal = np.zeros((len(ours), len(others)), np.uint16)
    for x, y in zip(ours.T, others.T, strict=True):
        equal += x[:, None] == y[None, :]
    return equal / ours.shape[1]


def _tree(block: pd.DataFrame, similarity: Callable[[pd.DataFrame], np.ndarray], least: float) -> pd.DataFrame | None:
    if len(block) < 2:
        return None
    ids = block["node"].to_numpy()
    return stars(ids, forest(similarity(block), least))


def candidate_clusters(reps: DataFrame, config: NearConfig) -> DataFrame:
    """(node, component) over all pairs of ``reps`` (node, bands, signature) with a common band and a high estimate."""
    slots = reps.where("bands is not null").select("node", F.posexplode("bands").alias("band", "bucket"))
    member = F.xxhash64("node")
    buckets = (
        slots.groupBy("band", "bucket")
        .agg(F.count("*").alias("n"), F.bit_xor(member).alias("x"), F.sum(F.shiftright(member, 20)).alias("y"))
        .where("n > 1")
    )
    chosen = (
        buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("at")).select("at.band", "at.bucket", "n")
    )
    chosen = stored(chosen.withColumn("group", F.monotonically_increasing_id()))
    parts = F.ceil(F.col("n") / config.block_rows).cast("int")
    # most slots are alone in their bucket, most nodes in all of theirs
    slots = maybe_in(slots, chosen, {"band": F.col("band"), "bucket": F.col("bucket")}).where("maybe").drop("maybe")
    rows = stored(lookup(slots, chosen, ["bucket", "band"]).where("n is not null").select("group", "node", parts.alias("parts")))
    discard(chosen)
    met = maybe_in(reps.select("node", "signature"), rows, {"node": F.col("node")}).where("maybe").drop("maybe")
    met = stored(met)
    least = config.threshold - config.margin
    found = group_components(
        rows,
        lambda nodes: lookup(nodes, met, ["node"]),
        lambda block: _tree(block, lambda x: _agreement(x, x), least),
        crossing_edges(lambda left, right: _agreement(left, right) >= least),
    )
    discard(rows)
    discard(met)
    return found


# --- exact comparison --------------------------------------------------------------------------------------------


def similarities(left: list[str], right: list[str] | None, size: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle counts of whole texts, all against all."""
    texts = left + (right or [])
    hashes, offsets = tx.words(*tx.utf8(pa.array(texts, pa.large_string())))
    doc, element, count = tx.counted(*tx.shingles(hashes, offsets, size))
    copies = np.repeat(np.arange(len(doc)), count)
    nth = np.arange(len(copies)) - np.repeat(np.cumsum(count) - count, count)
    doc, element = doc[copies], tx.mix(element[copies] + nth.astype(U64) * tx.GOLDEN)
    total = np.bincount(doc, minlength=len(texts)).astype(np.float64)
    order = np.argsort(element, kind="stable")
    doc, element = doc[order], element[order]
    group = np.concatenate([[0], np.cumsum(element[1:] != element[:-1])]) if len(element) else np.zeros(0, np.int64)
    shared = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    doc, group = doc[shared], group[shared]
    if len(group):
        group = np.concatenate([[0], np.cumsum(group[1:] != group[:-1])])
    n = len(left)
    common = np.zeros((n, len(texts) - n if right is not None else n), np.float32)
    step = 4096
    cuts = np.searchsorted(group, np.arange(0, (group[-1] + 1 if len(group) else 0) + step, step))
    for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a == b:
            continue
        part = np.zeros((len(texts), step), np.float32)
        part[doc[a:b], group[a:b] - c * step] = 1
        common += part[:n] @ (part[n:] if right is not None else part).T
    ours, others = total[:n], total[n:] if right is not None else total
    union = ours[:, None] + others[None, :] - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def exact_components(docs: DataFrame, clusters: DataFrame, sizes: DataFrame, config: NearConfig) -> DataFrame:
    """(node, component) over all pairs of a cluster with similarity at the threshold or above.

    ``clusters`` is (node, cluster), ``sizes`` is (node, rep, content, n_words), one row per node: the text of a node is
    the one of doc_id ``rep`` with the hash ``content``. Texts of clusters are fetched and written once; a bitmap of fixed
    size keeps most others out of the shuffle.
    """
    sized = lookup(clusters, sizes, ["node"])
    parts = F.greatest(
        F.lit(1), F.ceil(F.col("n") / config.block_rows), F.ceil(F.col("words") / config.block_words)
    ).cast("int")
    shape = sized.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).select("cluster", parts.alias("parts"))
    placed = stored(lookup(sized.drop("n_words"), shape, ["cluster"]))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("content"), F.coalesce("text", F.lit("")).alias("text"))
    keys = {"rep": F.col("rep"), "content": F.col("content")}
    found = maybe_in(texts, placed, keys).where("maybe").drop("maybe").join(placed, ["rep", "content"])
    # repeated rows are one
    found = found.groupBy("rep", "content", "cluster", "node", "parts").agg(F.min("text").alias("text"))
    members = stored(found.select(F.col("cluster").alias("group"), "node", "parts", "text"))
    discard(placed)

    def with_text(nodes: DataFrame) -> DataFrame:
        return nodes if "text" in nodes.columns else lookup(nodes, members.select("node", "text"), ["node"])

    def similar(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        return similarities(list(left["text"]), list(right["text"]), config.shingle) >= config.threshold

    found = group_components(
        members,
        with_text,
        lambda block: _tree(block, lambda x: similarities(list(x["text"]), None, config.shingle), config.threshold),
        crossing_edges(similar),
    )
    discard(members)
    return found


# --- the operator ------------------------------------------------------------------------------------------------


def _found(docs: DataFrame, config: NearConfig) -> DataFrame:
    """The rows of ``near_duplicates`` with the class key and the hash of the text."""
    made = stored(signatures(docs, config))
    # classes are the nodes, since a doc_id may stand for several; written numbers are shorter than keys
    chosen = F.min_by(F.struct(F.col("doc_id").alias("rep"), "content", "bands", "signature", "n_words"), F.struct("doc_id", "content"))
    reps = made.where("key is not null and doc_id is not null").groupBy("key").agg(chosen.alias("s")).select("key", "s.*")
    reps = stored(reps.withColumn("node", F.monotonically_increasing_id()))
    classes = reps.select("key", "rep")
    clusters = candidate_clusters(reps.select("node", "bands", "signature"), config)
    joined = exact_components(docs, clusters.withColumnRenamed("component", "cluster"), reps.select("node", "rep", "content", "n_words"), config)
    discard(clusters)
    joined = lookup(joined, reps.select("node", "key", "rep"), ["node"])
    first = joined.groupBy("component").agg(F.min(F.struct("rep", "key")).alias("first"))
    joined = lookup(joined.select("key", "component"), first, ["component"]).select("key", "first")
    found = lookup(made.select("doc_id", "content", "key", "n_words"), lookup(classes, joined, ["key"]), ["key"])
    class_id = F.coalesce("rep", "doc_id")
    component = F.coalesce("first.rep", class_id)
    smallest = F.col("key").isNull() | F.col("first").isNull() | (F.col("first.key") == F.col("key"))
    return found.select(
        "doc_id",
        class_id.alias("class_id"),
        component.alias("component_id"),
        "n_words",
        (F.col("doc_id").isNull() | ((F.col("doc_id") == component) & smallest)).alias("kept"),
        "key",
        "content",
    )


def near_duplicates(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id with the same words), component_id (smallest doc_id
    reachable over pairs of at least the threshold), n_words, kept (doc_id = component_id, of several classes of that
    doc_id in the component the one of the smallest key; or no doc_id)."""
    return _found(docs, config).drop("key", "content")


def keep_one_per_group(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """The rows of ``docs`` whose text is the smallest of its component, one row for each; rows without doc_id stay.

    Most rows stay as they are. Only those that go, or are repeated, have to meet their decision: a bitmap of fixed size
    keeps nearly all others out of the shuffle.
    """
    found = _found(docs, config).where("doc_id is not null")
    # of several texts with the same words that a doc_id has, the one of the least hash stays
    decided = found.groupBy("doc_id", "content").agg(F.max("kept").alias("kept"), F.min("key").alias("key"), F.count("*").alias("n"))
    twins = decided.where("kept").groupBy("doc_id", "key").agg(F.min("content").alias("stays"))
    decided = lookup(decided, twins, ["doc_id", "key"]).select("doc_id", "content", (F.col("kept") & (F.col("content") == F.col("stays"))).alias("kept"), "n")
    special = stored(decided.where("not kept or n > 1").select("doc_id", "content", "kept"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"))
    marked = maybe_in(rows, special, {"doc_id": F.col("doc_id"), "content": F.col("content")})
    plain = marked.where("not maybe or doc_id is null").select("row.*")
    met = marked.where("maybe and doc_id is not null").join(special, ["doc_id", "content"], "left")
    alone = met.where("kept is null").select("row.*")
    repeated = met.where("kept").dropDuplicates(["doc_id", "content"]).select("row.*")
    return plain.unionByName(alone).unionByName(repeated).select(*docs.columns)
