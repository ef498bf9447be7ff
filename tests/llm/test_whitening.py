"""Whitening against numpy's own eigensolver, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from tallymatch.llm import whitening as wh


def symmetric(values, seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return (q * values) @ q.T, q


SPECTRA = [
    np.arange(1.0, 41.0),
    np.geomspace(1e-9, 1e9, 40),
    np.r_[np.full(20, 1.0), np.full(20, 3.0)],
    np.r_[np.zeros(30), 1.0, 2.0, 5.0],
    np.full(12, 7.0),
    np.r_[1e6, np.linspace(1, 1.001, 30)],
    np.array([4.0]),
    np.array([1.0, 1.0 + 1e-9]),
]


@pytest.mark.parametrize("spectrum", SPECTRA, ids=range(len(SPECTRA)))
def test_components_are_eigenvectors(spectrum):
    matrix, _ = symmetric(spectrum, 7)
    for wanted in (1, 3, len(spectrum)):
        values, vectors = wh.spectral_components(matrix, min(wanted, len(spectrum)))
        size = np.abs(spectrum).max()
        assert np.abs(values - np.sort(spectrum)[::-1][: len(values)]).max() < 1e-12 * size
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_polar_factor_is_orthogonal_and_has_the_signs():
    for seed, values in enumerate((np.linspace(-3, 5, 30) + 0.01, np.r_[-1e-12, 1, 2, -4], np.r_[1e-8, -1e8])):
        matrix, q = symmetric(values, seed)
        u = wh.polar(matrix)
        assert np.abs(u @ u.T - np.eye(len(values))).max() < 1e-13
        assert np.abs(u - (q * np.sign(values)) @ q.T).max() < 1e-3
    rng = np.random.default_rng(3)
    general = rng.standard_normal((9, 9))
    left, _, right = np.linalg.svd(general)
    assert np.abs(wh.polar(general) - left @ right).max() < 1e-12


def brute(rows, wanted):
    """Rows by the definition with numpy's eigensolver; the sign of a component is left open."""
    usable = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    x = {i: np.floor(64 * v).astype(np.int64) + 1_000_000 for i, v in usable}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    covariance = centred.T @ centred / n
    e, q = np.linalg.eigh(covariance)
    e, q = e[::-1][:wanted], q[:, ::-1][:, :wanted]
    out = {}
    for i, v in x.items():
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s))
        for k in range(len(e)):
            out[i, k + 1] = n, deviation, abs((v - s / n) @ q[:, k] / np.sqrt(e[k])), e[k] / np.trace(covariance)
    return out


def check(got, expected):
    assert {(r.vec_id, r.component) for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        n, deviation, whitened, explained = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - whitened) < 1e-8 and abs(r.explained - explained) < 1e-12
        assert 0 <= r.identity_error < 1e-10
    assert len({r.identity_error for r in got}) <= 1


def test_query_equals_brute_force_on_whole_table(spark):
    import __spark_entry__ as entry

    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    got = entry.queries()["op13_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    check(got, brute([(r[0], r[1]) for r in table], 16))


def test_repeated_and_unusable_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).astype(float).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(40)]
    odd = [(200, None), (201, [None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, [])]
    schema = "vec_id long, embedding array<double>"
    frame = spark.createDataFrame(rows + odd, schema).selectExpr("*", "'a' as x", "1 as component", "2 as n")
    got = wh.whitened_components(frame, 16).collect()
    check(got, brute(rows, 16))
    assert {r.n for r in got} == {60} and max(r.component for r in got) == 5
    one = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert all({r.component: r.whitened for r in got if r.vec_id == 100 + i} == one for i in range(40))


def test_a_constant_entry_and_few_vectors_have_fewer_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [0.5, *rng.normal(size=3).tolist()]) for i in range(50)]
    rows += [(None, rows[1][1])]
    got = wh.whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1, 2, 3} and len(got) == 51 * 3
    three = [(i, rng.normal(size=8).tolist()) for i in range(3)]
    got = wh.whitened_components(spark.createDataFrame(three, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in got} == {1, 2} and all(r.identity_error < 1e-10 for r in got)


def test_tables_without_variance_and_mixed_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        got = wh.whitened_components(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and len(got.columns) == 7
    with pytest.raises(ValueError, match="entries"):
        wh.whitened_components(spark.createDataFrame([(1, [0.5]), (2, [0.5, 0.25])], schema))


def test_deviations_are_exact_and_fail_beyond_64_bits():
    fit = wh.Whitening(1_000_003, np.array([10**12, 5]), np.ones(1), np.ones((2, 1)), 1.0, 0.0)
    x = np.array([[1_000_001, 3], [999_999, -2]])
    assert fit.deviations(x).tolist() == [sum((1_000_003 * int(a) - int(s)) ** 2 for a, s in zip(row, fit.sums)) for row in x]
    with pytest.raises(OverflowError):
        fit.deviations(np.array([[10**12, 0]]))
