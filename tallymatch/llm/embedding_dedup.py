"""Near-duplicate embeddings by lattice hashing.

Each vector is projected at random into pairs of eight-dimensional spaces, one pair per table. The nearest points of
the E8 lattice there are its home cell; next to it the cells are probed that the vector comes closest to, by the 240
shortest lattice vectors. Vectors of which one lives in a cell that the other lives in or probes are compared by cosine
in double precision, in blocks of bounded size that give a spanning forest of their links. Components of these links
hold every link found; all pairs within a component are then compared once more, in blocks that give one count for each
vector, so that ``n_links`` is exact within a component and no pair is ever written out.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component link with nothing;
vectors of different lengths never link; a row without vec_id links with nothing, has no component and is kept; rows that
repeat vec_id and vector are one row. Different vectors of a vec_id are rows and nodes of their own, each with the links and
the component of its vector; those that can't be compared are one row. Other columns, the label among them, are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import text as tx
from tallymatch.llm.blocks import crossing_edges, forest, group_components, map_blocks, paired_parts, part_of, stars
from tallymatch.llm.membership import maybe_in
from tallymatch.llm.storage import discard, stored
from tallymatch.operators.lookup import lookup

U64 = np.uint64


@dataclass(frozen=True)
class LatticeConfig:
    """A pair at cosine 0.95 meets in a table with probability 0.55 and misses all with 1e-5; at 0.97 with 5e-8. Of
    unrelated pairs about 1e-5 meet in a table. For far more vectors take ``spaces`` 3 and more tables: fewer unrelated
    pairs meet, at more cells for each vector. ``cell`` is the scale of the lattice for unit vectors."""

    threshold: float = 0.95
    tables: int = 14
    spaces: int = 2
    cell: float = 0.6
    probes: int = 8
    block_rows: int = 512
    seed: int = 7


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


SHORTEST = _shortest()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(-1)
    odd = np.nonzero(near.sum(-1) % 2 != 0)
    at = odd + (worst[odd],)
    near[at] += np.where(off[at] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: integer points with an even sum, or those shifted by one half throughout."""
    whole = _nearest_even(x)
    half = _nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1)
    return np.where(closer[..., None], whole, half)


@lru_cache(maxsize=64)
def _projections(dim: int, config: LatticeConfig) -> np.ndarray:
    """tables x spaces x 8 x dim, orthonormal within a table and scaled so that a unit vector keeps about unit length."""
    width = 8 * config.spaces
    out = []
    for t in range(config.tables):
        rng = np.random.default_rng([config.seed, t, dim])
        rows = np.linalg.qr(rng.normal(size=(max(dim, width), width)))[0].T[:, :dim]
        out.append(rows.reshape(config.spaces, 8, dim) * np.sqrt(max(dim, width) / 8) / config.cell)
    return np.array(out)


def cells(unit: np.ndarray, config: LatticeConfig) -> np.ndarray:
    """Keys of the cells of each unit vector by table: n x tables x (1 + probes), the home cell first."""
    n, dim = unit.shape
    out = np.empty((n, config.tables, 1 + config.probes), U64)
    weights = tx.mix(np.arange(1, 8 * config.spaces + 1, dtype=U64) * tx.GOLDEN).reshape(config.spaces, 8)
    steps = (2 * SHORTEST).astype(np.int64).astype(U64)
    for t, rows in enumerate(_projections(dim, config)):
        x = np.einsum("nd,kjd->nkj", unit, rows)
        near = nearest_e8(x)
        home = ((2 * near).astype(np.int64).astype(U64) * weights).sum((1, 2)) + tx.golden(1009 * dim + t)
        gain = ((x - near) @ SHORTEST.T).reshape(n, -1)
        best = np.argpartition(-gain, config.probes, axis=1)[:, : config.probes]
        moves = np.stack([(steps * w).sum(1) for w in weights]).reshape(-1)
        out[:, t, 0] = tx.mix(home)
        out[:, t, 1:] = tx.mix(home[:, None] + moves[best])
    return out


def _usable(column: pa.Array) -> tuple[list[np.ndarray | None], list[str | None]]:
    """Vectors in double precision (None where they can't be compared) and a key of their content."""
    vectors: list[np.ndarray | None] = []
    keys: list[str | None] = []
    for v in column.to_pylist():
        x = np.array(v, np.float64) if v and None not in v else None
        if x is not None and (not np.isfinite(x).all() or not x.any()):
            x = None
        vectors.append(x)
        keys.append(None if x is None else hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).hexdigest())
    return vectors, keys


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


HASHED = "vec_id long, key string, vector array<double>, cells array<long>"


def hashed(vectors: DataFrame, config: LatticeConfig) -> DataFrame:
    """vec_id, content key, unit vector and cells of each row; the last three are null where nothing can be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                found, keys = _usable(batch.column(1))
                out: list[list | None] = [None] * len(found)
                units: list[np.ndarray | None] = [None] * len(found)
                for dim in {len(x) for x in found if x is not None}:
                    rows = [i for i, x in enumerate(found) if x is not None and len(x) == dim]
                    unit = _unit(np.stack([found[i] for i in rows]))
                    for i, u, c in zip(rows, unit, cells(unit, config).reshape(len(rows), -1).view(np.int64), strict=True):
                        units[i], out[i] = u, c
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(keys, pa.string()), pa.array(units, pa.list_(pa.float64())), pa.array(out, pa.list_(pa.int64()))],
                    ["vec_id", "key", "vector", "cells"],
                )

    return vectors.selectExpr("cast(vec_id as long) as vec_id", "embedding").mapInArrow(run, HASHED)


def _cosines(block: pd.DataFrame) -> np.ndarray:
    """All cosines of a block; below any threshold between vectors of different lengths."""
    lengths = block["vector"].map(len).to_numpy()
    if (lengths == lengths[0]).all():
        x = np.stack(block["vector"].to_numpy())
        return x @ x.T
    out = np.full((len(block), len(block)), -2.0)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        x = np.stack(block["vector"].to_numpy()[at])
        out[np.ix_(at, at)] = x @ x.T
    return out


def _cosines_between(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    both = pd.concat([left, right], ignore_index=True)
    return _cosines(both)[: len(left), len(left) :]


def _linked(config: LatticeConfig):
    def compute(block: pd.DataFrame) -> pd.DataFrame | None:
        ids = block["node"].to_numpy()
        return stars(ids, forest(_cosines(block), config.threshold)) if len(block) > 1 else None

    return compute


def _counted(config: LatticeConfig):
    def compute(block: pd.DataFrame) -> pd.DataFrame:
        linked = _cosines(block) >= config.threshold
        part = block["part"].to_numpy()
        same = part[:, None] == part[None, :]
        # a block of two parts counts between them, a block of one part within it
        linked &= ~same if block["part_a"].iat[0] != block["part_b"].iat[0] else ~np.eye(len(block), dtype=bool)
        return pd.DataFrame({"node": block["node"].to_numpy(), "links": linked @ block["copies"].to_numpy()})

    return compute


def linked_vectors(vectors: DataFrame, config: LatticeConfig = LatticeConfig()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable over links), kept."""
    made = stored(hashed(vectors, config))
    rows = made.select("vec_id", "key").distinct()
    whole = made.where("key is not null and vec_id is not null")
    # vectors are the nodes, since a vec_id may stand for several; written numbers are shorter than keys
    counted = rows.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    first = lookup(whole, counted, ["key"]).where("vec_id = rep")
    reps = first.groupBy("key").agg(
        F.min("rep").alias("rep"), F.min("copies").alias("copies"), F.min("vector").alias("vector"), F.min("cells").alias("cells")
    )
    reps = stored(reps.withColumn("node", F.monotonically_increasing_id()))
    joined = linked_components(reps, config)

    sizes = joined.groupBy("component").agg(F.ceil(F.count("*") / config.block_rows).cast("int").alias("parts"))
    placed = lookup(lookup(joined, sizes, ["component"]), reps.select("node", "vector", "copies"), ["node"])
    placed = paired_parts(placed.withColumn("part", part_of(F.col("node"), F.col("parts"))), "part", "parts")
    counts = map_blocks(
        placed.select("component", "part_a", "part_b", "part", "node", "vector", "copies"),
        ["component", "part_a", "part_b"], _counted(config), "node long, links long",
    )
    links = counts.groupBy("node").agg(F.sum("links").alias("links"))
    classes = lookup(lookup(reps.select("node", "key", "rep", "copies"), joined, ["node"]), links, ["node"])
    least = classes.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    facts = lookup(classes, least, ["component"]).select("key", "rep", "copies", "links", "least")
    found = lookup(rows, facts, ["key"])
    unlinked = F.col("rep").isNull() | F.col("vec_id").isNull()
    component = F.when(unlinked, F.col("vec_id")).otherwise(F.coalesce("least", "rep"))
    return found.select(
        "vec_id",
        F.when(unlinked, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"),
    )


def linked_components(reps: DataFrame, config: LatticeConfig) -> DataFrame:
    """(node, component) over all linked pairs of ``reps`` (node, vector, cells) of which one lives in a cell of the other."""
    per_table = 1 + config.probes
    member = F.xxhash64("node")
    slots = reps.select("node", F.posexplode("cells").alias("at", "cell")).select(
        "node", F.expr(f"cast(at div {per_table} as int)").alias("lattice"), "cell", (F.col("at") % per_table == 0).cast("int").alias("home")
    )
    buckets = (
        slots.groupBy("lattice", "cell")
        .agg(F.count("*").alias("n"), F.sum("home").alias("homes"), F.bit_xor(member).alias("x"), F.sum(F.shiftright(member, 20)).alias("y"))
        .where("n > 1 and homes > 0")
    )
    # buckets with the same members are taken once
    chosen = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("lattice", "cell")).alias("at")).select("at.lattice", "at.cell", "n")
    chosen = stored(chosen.withColumn("group", F.monotonically_increasing_id()))
    parts = F.ceil(F.col("n") / config.block_rows).cast("int")
    slots = maybe_in(slots.drop("home"), chosen, {"lattice": F.col("lattice"), "cell": F.col("cell")}).where("maybe").drop("maybe")
    rows = stored(lookup(slots, chosen, ["cell", "lattice"]).where("n is not null").select("group", "node", parts.alias("parts")))
    discard(chosen)
    found = group_components(
        rows,
        lambda nodes: lookup(nodes, reps.select("node", "vector"), ["node"]),
        _linked(config),
        crossing_edges(lambda left, right: _cosines_between(left, right) >= config.threshold),
    )
    discard(rows)
    return found


#: The same over all pairs, for a small table.
SQL = """
WITH RECURSIVE checked AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
given AS (
  SELECT row_number() OVER () AS node, vec_id, e
  FROM (SELECT DISTINCT vec_id, CASE WHEN usable THEN e END AS e FROM checked)),
links AS (
  SELECT a.node AS x, b.node AS y FROM given a JOIN given b ON a.node <> b.node AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reached(node, other) AS (
  SELECT node, node FROM given WHERE e IS NOT NULL UNION SELECT r.node, l.y FROM reached r JOIN links l ON l.x = r.other),
least AS (SELECT r.node, min(g.vec_id) AS component_id FROM reached r JOIN given g ON g.node = r.other GROUP BY r.node)
SELECT g.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, g.vec_id) AS component_id,
  g.vec_id IS NULL OR g.vec_id = coalesce(c.component_id, g.vec_id) AS kept
FROM given g
LEFT JOIN (SELECT x, count(*) AS n_links FROM links GROUP BY x) n ON n.x = g.node
LEFT JOIN least c ON c.node = g.node
"""
