"""Near-duplicate vectors against a comparison of all pairs."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from devicehealth.llm.near_vectors import bucket_codes, near_vectors
from devicehealth.llm.q_near_vectors import op1_embedding_near_dedup

SCHEMA = "vec_id long, label int, embedding array<float>, n_links string, bucket int"


def brute(rows, cosine=0.98):
    """``{id: (links, component, kept)}`` of distinct ids."""
    units = {}
    for i, label, v in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            units[i] = (label, x / np.linalg.norm(x))
    links = {i: 0 for i, _, _ in rows}
    at = {i: i for i in links}
    for group in {(label, len(x)) for label, x in units.values()}:
        ids = sorted(i for i, (label, x) in units.items() if (label, len(x)) == group)
        matrix = np.array([units[i][1] for i in ids])
        close = matrix @ matrix.T >= cosine
        np.fill_diagonal(close, False)
        for a, b in zip(*np.nonzero(np.triu(close))):
            a, b = ids[a], ids[b]
            links[a] += 1
            links[b] += 1
            tops = []
            for c in (a, b):
                while at[c] != c:
                    c = at[c]
                tops.append(c)
            at[max(tops)] = min(tops)

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    return {i: (links[i], top(i), top(i) == i) for i in links}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_groups_with_small_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 64))
    rows = []
    for i in range(900):
        c = 0 if i % 3 == 0 else rng.integers(12)
        v = centres[c] + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.14])
        rows.append((i, int(c) % 4, [float(x) for x in v]))
    rows += [(1000 + i, 1, rows[5][2]) for i in range(50)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert result(near_vectors(df, block=64)) == brute(rows)


def test_query(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["label"].to_pylist(), t["embedding"].to_pylist()))
    assert result(op1_embedding_near_dedup(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, 0, None), (2, 0, []), (3, 0, [0.0, 0.0, 0.0]), (4, 0, [1.0, None, 3.0]), (5, 0, [float("nan"), 1.0, 2.0]), (6, 0, [float("inf"), 1.0, 2.0]),
            (7, None, v), (8, None, v), (9, 0, v), (10, 0, [2.0, 4.0, 6.0]), (11, 1, v), (12, 0, [1.0, 2.0, 3.0, 0.0]), (13, 0, [1e30, 2e30, 3e30]), (14, 0, [1.0]), (15, 0, [3.0]), (16, 0, [-1.0])]
    df = spark.createDataFrame([(*r, None, None) for r in rows] + [(None, 0, v, None, None)], SCHEMA)
    got = result(near_vectors(df))
    assert got.pop(None) == (0, None, True)
    assert got == brute(rows)
    twice = near_vectors(spark.createDataFrame([(1, 0, v, "x", 1), (1, 0, v, "x", 1), (2, 0, v, "x", 1)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in twice) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_no_rows(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("cosine", [0.98])
def test_recall_of_the_buckets(cosine):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(axis=1)[:, None] * x
    y = cosine * x + np.sqrt(1 - cosine ** 2) * g / np.linalg.norm(g, axis=1)[:, None]
    shared = (bucket_codes(x, 6, 3, 4)[:, :, None] == bucket_codes(y, 6, 3, 4)[:, None, :]).any(axis=(1, 2))
    assert shared.mean() > 0.9999
