"""Whitening against a library's eigenvectors, whole-number sums and its own proof."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lograft.llm.whitening import leading_pairs, whitened_vectors

SCHEMA = "vec_id long, embedding array<float>"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10_000), st.sampled_from(["any", "low", "tied", "tiny", "huge"]))
def test_pairs_against_a_library(n, seed, kind):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, 2 if kind == "low" else n + 2))
    m = a @ a.T * {"tiny": 1e-120, "huge": 1e120}.get(kind, 1)
    if kind == "tied":
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        m = q @ np.diag(np.repeat([3.0, 2.0], n)[n // 2 : n // 2 + n]) @ q.T
        m = (m + m.T) / 2
    k = min(8, n)
    values, vectors = leading_pairs(m, 8)
    size = np.max(np.abs(m))
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:k], rtol=0, atol=1e-12 * n * size)
    assert np.max(np.abs(m @ vectors - vectors * values)) < 1e-12 * n * size
    assert np.max(np.abs(vectors.T @ vectors - np.eye(k))) < 1e-10


def whole(rows):
    return np.floor(1024 * np.array(rows, np.float32).astype(float)).astype(np.int64) + 100_000


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(700, 12)) * np.linspace(3, 0.5, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [
        (None, vectors[0].tolist()), (5, vectors[1].tolist()), (900, None), (901, []),
        (902, [1.0]), (903, [None] + [0.0] * 11), (904, [float("nan")] + [0.0] * 11),
        (905, [float("inf")] + [0.0] * 11),
    ]
    got = whitened_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    x = whole([*vectors, vectors[0], vectors[1]])
    n, s = len(x), x.sum(axis=0)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    expected = (x - s / n) @ axes / np.sqrt(values)
    deviation = ((n * x.astype(object) - s) ** 2).sum(axis=1)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = np.sign([by_id[0][c + 1][0].whitened * expected[0, c] for c in range(8)])
    for i in (0, 1, 77, 699):
        for c in range(8):
            (r,) = by_id[i][c + 1]
            assert r.deviation == deviation[i]
            assert abs(r.whitened - signs[c] * expected[i, c]) < 1e-9
            share = values[c] / np.trace(np.cov(x.T, bias=True))
            assert abs(r.explained - share) < 1e-9
            assert r.identity_error < 1e-9
    assert len(by_id[5][1]) == 2 and len(by_id[None][1]) == 1
    w = np.array([[by_id[i][c + 1][0].whitened for c in range(8)] for i in range(700) if i != 5])
    assert np.max(np.abs(np.cov(w.T, bias=True) - np.eye(8))) < 0.05


@pytest.mark.parametrize("rows, components", [
    ([(1, [1.0, 2.0])], 2), ([(1, [1.0, 2.0])] * 4, 2), ([(1, [0.5]), (2, [1.5])], 1),
    ([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], 3),
])
def test_directions_without_variance(spark, rows, components):
    got = whitened_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) * components
    live = {r.component for r in got if r.whitened is not None}
    assert live == (set() if len({tuple(v) for _, v in rows}) == 1 else {1})
    assert all(r.identity_error < 1e-9 for r in got)


def test_empty_tables_and_clashing_columns(spark):
    assert whitened_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitened_vectors(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0
    frame = spark.createDataFrame(
        [("a", [1.0], 1), ("b", [2.0], 2)], "vec_id string, embedding array<double>, whitened int"
    )
    assert {r.vec_id for r in whitened_vectors(frame).collect()} == {"a", "b"}


def test_deviation_beyond_a_long_is_an_error(spark):
    rows = [(i, [3e11 * (i % 2)]) for i in range(10)]
    with pytest.raises(Exception, match="beyond a long"):
        whitened_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
