import math

import numpy as np
import pytest

from corpusrules.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n double, id string, x binary"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(k, v, 0, "c", 1.0, "i", b"x") for k, v in zip(ids, vectors, strict=True)], SCHEMA)


def brute(vectors):
    """Distinct whole vectors, their mean, and eigenvalues and eigenvectors (columns) of their covariance, falling."""
    x = np.floor(64.0 * np.asarray(vectors, np.float32).astype(float)) + 1_000_000
    distinct = np.unique(x, axis=0)
    mean = distinct.mean(0)
    values, columns = np.linalg.eigh((distinct - mean).T @ (distinct - mean) / len(distinct))
    return x, distinct, mean, values[::-1], columns[:, ::-1]


def held_against_brute(found, vectors, ids, components):
    x, distinct, mean, values, columns = brute(vectors)
    n, sums = len(distinct), [int(s) for s in distinct.sum(0)]
    assert len(found) == len(vectors) * components
    rows = {(r["id"], r["component"]): r for r in found}
    for c in range(components):
        ours = np.array([rows[k, c + 1]["whitened"] for k in ids])
        theirs = (x - mean) @ columns[:, c] / np.sqrt(values[c])
        assert min(abs(ours - theirs).max(), abs(ours + theirs).max()) < 1e-7
        for k, v in zip(ids, x, strict=True):
            r = rows[k, c + 1]
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - s) ** 2 for a, s in zip(v, sums, strict=True))
            assert math.isclose(r["explained"], values[c] / values.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 24)) @ rng.normal(size=(24, 24)) + 3).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:50], np.repeat(vectors[:1], 100, 0)])
    found = whitening.whitened(frame(spark, vectors.tolist()).repartition(3)).collect()
    held_against_brute(found, vectors, range(len(vectors)), 16)


def test_small_eigenvalues_keep_their_digits():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    scale = 10.0 ** -np.arange(12)
    factor = q * np.sqrt(scale)
    values, vectors = whitening.one_sided_jacobi(factor @ np.linalg.qr(rng.normal(size=(12, 12)))[0])
    assert np.allclose(values, scale, rtol=1e-6)
    assert np.allclose(np.abs(vectors @ q), np.eye(12), atol=1e-6)


@pytest.mark.parametrize("rank", [0, 1, 5, 9])
def test_cholesky_finds_the_rank(rank):
    rng = np.random.default_rng(rank)
    g = rng.normal(size=(9, rank))
    factor = whitening.pivoted_cholesky(g @ g.T)
    assert factor.shape == (9, rank) and np.allclose(factor @ factor.T, g @ g.T)


def test_rotations_are_orthogonal_for_odd_and_even_numbers_of_columns():
    for d in (1, 2, 7, 64):
        g = np.random.default_rng(d).normal(size=(d, d))
        values, vectors = whitening.one_sided_jacobi(g)
        assert np.allclose(vectors @ vectors.T, np.eye(d), atol=1e-12)
        assert np.allclose(values, np.linalg.svd(g, compute_uv=False) ** 2)


def test_unusable_vectors(spark):
    good = [[0.5, 1.0, -2.0], [0.0, 1.5, 4.0], [3.0, 0.25, 0.0], [0.5, 1.0, -2.0]]
    bad = [None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0], []]
    found = whitening.whitened(frame(spark, good + bad)).collect()
    held_against_brute(found, good, range(4), 2)


def test_null_and_repeated_ids(spark):
    vectors = [[0.0, 1.0], [1.0, 0.0], [5.0, 1.0], [5.0, 1.0]]
    found = whitening.digest(whitening.whitened(frame(spark, vectors, [None, 7, 7, 7]))).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == [(0, 1), (0, 2)] + [(7, 1)] * 3 + [(7, 2)] * 3


def test_no_components(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]] * 2, [None]):
        assert whitening.whitened(frame(spark, vectors)).collect() == []


def test_large_entries(spark):
    """Whole numbers of several widths; a deviation that is no long is null."""
    vectors = [[0.0, 1.0], [float(1 << 20), 2.0], [float(1 << 40), 5.0], [float(1 << 50), -3.0]]
    found = {(r["id"], r["component"]): r for r in whitening.whitened(frame(spark, vectors)).collect()}
    assert len(found) == 8 and all(r["deviation"] is None and r["n"] == 4 for r in found.values())
    few = whitening.Fit(3, [1_000_003, -5], np.zeros(0), np.zeros((0, 2)), 0.0)
    x = np.array([[1 << 28, 4], [1 << 30, 1], [1 << 32, 0]], np.int64)
    exact = [sum((3 * int(a) - s) ** 2 for a, s in zip(v, few.sums, strict=True)) for v in x]
    assert whitening.deviations(x, few) == [e if e < 1 << 63 else None for e in exact]
