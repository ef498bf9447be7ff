"""Grouped work in bounded blocks: rows of one block meet in a task and only small results leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymatch.llm.graph import components
from tallymatch.llm.storage import discard, stored
from tallymatch.operators.lookup import lookup

OUT_ROWS = 4096


def map_blocks(
    rows: DataFrame, keys: Sequence[str], compute: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str
) -> DataFrame:
    """Apply ``compute`` to the rows of each key. The caller keeps each key's rows to a bounded number.

    One sorted pass per task, many small keys to an Arrow batch: a call per key of ``applyInPandas`` costs a round trip
    for each, and here most blocks hold two or three rows.
    """
    keys = list(keys)
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        out: list[pd.DataFrame] = []
        n_out = 0

        def closed(parts: list[pd.DataFrame]) -> None:
            nonlocal n_out
            found = compute(parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True))
            if found is not None and len(found):
                out.append(found[names])
                n_out += len(found)

        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for k in keys:
                values = batch[k].to_numpy()
                new[1:] |= values[1:] != values[:-1]
            cuts = [0, *np.flatnonzero(new), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(batch[k].iat[a] for k in keys)
                if held and key != last:
                    closed(held)
                    held = []
                held.append(batch.iloc[a:b])
                last = key
                if n_out >= OUT_ROWS:
                    yield pd.concat(out, ignore_index=True)
                    out, n_out = [], 0
        if held:
            closed(held)
        if out:
            yield pd.concat(out, ignore_index=True)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def part_of(key: Column, parts: Column, seed: int = 0) -> Column:
    """A part number below ``parts``, by hash."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), parts.cast("long")).cast("int")


def paired_parts(rows: DataFrame, part: str, parts: str) -> DataFrame:
    """Each row once for every pair of parts that its own part is in; all rows of two parts meet in block (part_a, part_b).

    A group of one part has a single block. A hot group of p parts has p * (p + 1) / 2 blocks of bounded size.
    """
    other = rows.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)))
    return other.withColumns(
        {"part_a": F.least(part, "other_part"), "part_b": F.greatest(part, "other_part")}
    ).drop("other_part")


def forest(similarity: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest over the pairs of at least ``least``: they connect what all such pairs would."""
    n = len(similarity)
    best = np.full(n, -1.0)
    via = np.zeros(n, int)
    outside = np.ones(n, bool)
    edges = []
    at = 0
    for _ in range(n - 1):
        outside[at] = False
        closer = outside & (similarity[at] > best)
        best[closer], via[closer] = similarity[at][closer], at
        nxt = int(np.argmax(np.where(outside, best, -2.0)))
        if best[nxt] >= least:
            edges.append((int(via[nxt]), nxt))
        at = nxt
    return edges


EDGES = "a long, b long"
Payload = Callable[[DataFrame], DataFrame]
Compute = Callable[[pd.DataFrame], pd.DataFrame | None]


def stars(ids: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame | None:
    """Edges (a, b) from the least id of each connected set to its others: the same sets, with nothing far from its root."""
    if not edges:
        return None
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in edges:
        i, j = find(i), find(j)
        low, high = (i, j) if ids[i] <= ids[j] else (j, i)
        root[high] = low
    return pd.DataFrame([(ids[find(i)], ids[i]) for i in range(len(ids)) if find(i) != i], columns=["a", "b"])


def group_components(members: DataFrame, payload: Payload, within: Compute, across: Compute) -> DataFrame:
    """(node, component) as comparing all pairs of each group would give, in blocks of bounded size; a written table.

    ``members`` is a written table (group, node, parts, ...): of a group that ``parts`` blocks can hold; a node may be in
    several groups. ``payload`` adds to such rows what nodes are compared by. ``within`` gets the rows of a block,
    ``across`` those of two blocks (``side`` 0 and 1) with the ``component`` of each; both give edges, of nodes and of
    components.

    A group of one part is one block. Of the larger ones, each node's largest is dealt into random parts twice, which joins
    nearly all that can be joined; then, in every large group, nodes outside its largest component are compared with the
    rest, all of it. So groups of copies cost their size, and no pair is left out. Rows are copied to blocks as numbers and
    get their payload last.
    """
    columns = ["group", "part", "node"]

    def dealt(rows: DataFrame, seed: int) -> DataFrame:
        blocks = payload(rows).withColumn("part", part_of(F.col("node"), F.col("parts"), seed)).drop("parts")
        return map_blocks(blocks.select(*columns, *[c for c in blocks.columns if c not in columns]), ["group", "part"], within, EDGES)

    large = members.where("parts > 1").select("group", "node", "parts")
    if large.isEmpty():
        edges = stored(dealt(members, 1))
        found = components(edges)
        discard(edges)
        return found
    home = stored(large.groupBy("node").agg(F.max(F.struct("parts", "group")).alias("home")).select("home.group", "node", "home.parts"))
    edges = stored(dealt(members.where("parts = 1"), 1).unionByName(dealt(home, 1)).unionByName(dealt(home, 2)))
    joined = components(edges)
    member = stored(lookup(large, joined, ["node"]).withColumn("component", F.coalesce("component", "node")))
    counts = member.groupBy("group", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("group").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"), F.sum("n").alias("all")
    )
    rest = lookup(member, main, ["group"]).where("outside > 0")
    rest = rest.withColumn("own_parts", F.greatest(F.lit(1), F.ceil(F.col("parts") * F.col("outside") / F.col("all"))).cast("int"))
    left = rest.where("component <> main").select(
        "group", "node", "component", F.lit(0).alias("side"),
        part_of(F.col("node"), F.col("own_parts"), 3).alias("part_a"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part_b"),
    )
    right = rest.select(
        "group", "node", "component", F.lit(1).alias("side"),
        F.explode(F.sequence(F.lit(0), F.col("own_parts") - 1)).alias("part_a"),
        part_of(F.col("node"), F.col("parts"), 4).alias("part_b"),
    )
    crossing = stored(map_blocks(payload(left.unionByName(right)), ["group", "part_a", "part_b"], across, EDGES))
    done = [home, edges, member]
    if not crossing.isEmpty():
        # the edges are those of components: few
        merged = components(crossing)
        renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("root"))
        alone = crossing.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        nodes = joined.unionByName(lookup(alone, joined.select("node"), ["node"], "left_anti").withColumn("component", F.col("node")))
        found = stored(lookup(nodes, renamed, ["component"]).select("node", F.coalesce("root", "component").alias("component")))
        done += [joined, merged]
        joined = found
    for table in [*done, crossing]:
        discard(table)
    return joined


def crossing_edges(linked: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]) -> Compute:
    """``across`` for ``group_components`` from a matrix of which row of one side is linked with which of the other."""

    def compute(block: pd.DataFrame) -> pd.DataFrame | None:
        left, right = block[block["side"] == 0], block[block["side"] == 1]
        if not len(left) or not len(right):
            return None
        ours, others = left["component"].to_numpy(), right["component"].to_numpy()
        i, j = np.nonzero(linked(left, right) & (ours[:, None] != others[None, :]))
        edges = pd.DataFrame({"a": ours[i], "b": others[j]})
        return edges.drop_duplicates() if len(edges) else None

    return compute
