"""Whitening against the eigenvectors of the covariance, computed directly."""

from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from devicehealth.llm.q_whitening import op12_embedding_whitening
from devicehealth.llm.whitening import bidiagonal, whitened


def brute(rows, components=16):
    """``{id: (n, deviation, projections)}``, variances and their sum; rows of one length."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    used = [k for k in range(min(components, len(values))) if values[k] > 1e-15 * values[0]]
    own = {i: (n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), np.array([(n * c - s) / n for c, s in zip(v, sums)]) @ axes[:, used] / np.sqrt(values[used])) for i, v in x.items()}
    return own, values[used] / values.sum()


def check(got, rows):
    own, explained = brute(rows)
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    assert by.keys() == own.keys()
    signs = None
    for i, (n, deviation, projections) in own.items():
        mine = by[i]
        assert sorted(mine) == list(range(1, len(explained) + 1))
        values = np.array([mine[k + 1].whitened for k in range(len(explained))])
        if signs is None:
            top = max(own, key=lambda j: np.abs(own[j][2]).min())
            signs = np.sign(own[top][2]) * np.sign([by[top][k + 1].whitened for k in range(len(explained))])
        assert np.allclose(values * signs, projections, atol=1e-6)
        assert {(r.n, r.deviation) for r in mine.values()} == {(n, deviation)}
        assert np.allclose([mine[k + 1].explained for k in range(len(explained))], explained, rtol=1e-8)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_query_on_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/embeddings.parquet")
    check(op12_embedding_whitening(spark, sf).collect(), list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist())))


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(60, 5)) @ np.diag([9, 5, 2, 1, 0.2]))]
    good += [(100, good[3][1]), (101, [50.0, -50.0, 1.0, 2.0, 3.0])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0] * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], "vec_id long, embedding array<float>, n string, component int")
    check(whitened(df).collect(), good)
    twice = whitened(df.union(df)).collect()
    assert len(twice) == 2 * 5 * len(good) and {r.n for r in twice} == {61}


def test_fewer_components_than_dimensions(spark):
    rows = [(i, [float(i % 3), 2.0 * (i % 3), 7.0, float(i % 2)]) for i in range(12)]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(got, rows)
    assert {r.component for r in got} == {1, 2}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_variance(spark, rows):
    assert whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_large_deviations_are_exact(spark):
    rows = [(i, [1e9 * ((i * 7919) % 13), float(i)]) for i in range(20)]
    got = {r.vec_id: r.deviation for r in whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((20 * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert got == {i: w if w < 1 << 63 else None for i, w in enumerate(want)} and None in got.values()


def test_equal_singular_values_are_all_found():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 8)))[0]
    turned = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    x = q @ np.diag([5, 5, 5, 2, 2, 1, 1e-4, 0]) @ turned

    def product(w):
        u = x @ w
        return u @ u, x.T @ u

    values, axes = bidiagonal(product, 8)
    assert np.allclose(values, [5, 5, 5, 2, 2, 1, 1e-4, 0], atol=1e-7)
    assert np.allclose(axes @ axes.T, np.eye(8), atol=1e-12)
    assert np.allclose(np.linalg.norm(x @ axes.T, axis=0), values, atol=1e-6)
