"""Lattice hashing against all pairs."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from tallymatch.llm import embedding_dedup as ed


def truth(ids, x):
    unit = ed._unit(x)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    component = ids.copy()
    while True:
        least = np.minimum(component, np.where(linked, component[None, :], 1 << 60).min(1))
        if (least == component).all():
            return linked.sum(1), component
        component = least


def test_nearest_points_of_the_lattice():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * 2
    near = ed.nearest_e8(x)
    even = (near.sum(1) % 2 == 0) & ((near == np.rint(near)).all(1) | (near - 0.5 == np.rint(near - 0.5)).all(1))
    assert even.all() and len(ed.SHORTEST) == 240
    around = near[:, None, :] + ed.SHORTEST[None]
    assert (((x - near) ** 2).sum(1)[:, None] <= ((x[:, None, :] - around) ** 2).sum(2) + 1e-9).all()


@pytest.mark.parametrize("block_rows", [512, 20])
def test_links_and_components_equal_all_pairs(spark, block_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64))
    x = np.concatenate([c + rng.normal(size=(n, 64)) * s for c, n, s in zip(centres, rng.integers(1, 60, 40), rng.uniform(0.05, 0.35, 40))])
    x = np.concatenate([x, x[:20], x[:10] * 3.0]).astype(np.float32)
    ids = rng.permutation(len(x)) + 10
    rows = [(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ed.linked_vectors(vectors, replace(ed.LatticeConfig(), block_rows=block_rows)).toPandas().set_index("vec_id").loc[ids]
    links, component = truth(ids, x.astype(np.float64))
    assert links.max() > 20
    assert (got.component_id.to_numpy() == component).mean() >= 0.999
    assert (got.n_links.to_numpy() == links).mean() >= 0.999
    assert (got.kept.to_numpy() == (got.index == got.component_id)).all()


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0]),
        (7, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (10, [float("inf"), 1.0]), (11, [2e38, 0.0]),
    ]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "1 as key", "1 as n_links", "'x' as cells")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ed.linked_vectors(odd).collect()}
    assert got == {
        1: (3, 1, True), 2: (3, 1, False), 7: (3, 1, False), 11: (3, 1, False), None: (0, None, True),
        **{i: (0, i, True) for i in (3, 4, 5, 6, 8, 9, 10)},
    }
    assert ed.linked_vectors(odd.limit(0)).count() == 0


def test_each_vector_of_a_vec_id_counts(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a), (1, b), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (4, c), (4, None), (4, [0.0, 0.0, 0.0]), (5, c), (5, a), (1, a)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    expected = [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (4, 1, 4, True), (5, 1, 4, False), (5, 2, 1, False)]
    assert got == expected


def test_a_bucket_of_many_parts_costs_its_size(spark):
    """Near copies by the thousand and a few vectors that only hang on to some of them."""
    rng = np.random.default_rng(9)
    x = np.r_[rng.normal(size=16) + rng.normal(size=(600, 16)) * 0.01, rng.normal(size=(60, 16))].astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    config = replace(ed.LatticeConfig(), block_rows=25)
    got = ed.linked_vectors(vectors, config).toPandas().set_index("vec_id").loc[range(len(x))]
    links, component = truth(np.arange(len(x)), x.astype(np.float64))
    assert (got.n_links.to_numpy() == links).all() and (got.component_id.to_numpy() == component).all()
