from __future__ import annotations

import numpy as np
import pytest

from hopweave.llm.neighbours import EVERY, Block, Heaps, nearest, op6_neighbours, quantise
from tests.conftest import SF


def brute(ids, x, k, queries=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(ids)):
        if queries is None or ids[i] in queries:
            c = np.round(u @ u[i], 9)
            order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-c[j], ids[j]))[:k]
            out[ids[i]] = [ids[j] for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.vec_id, []).append(r.neighbour_id)
    return out


def test_the_query_has_recall_one(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = [r.vec_id for r in rows]
    want = brute(ids, np.array([r.embedding for r in rows], np.float64), 10, {i for i in ids if i % EVERY == 0})
    got = found(op6_neighbours(spark, SF))
    hits = sum(len(set(want[i]) & set(got[i])) for i in want)
    assert hits >= 0.999 * 10 * len(want) and set(got) == set(want)


def test_all_rows_as_queries_in_several_blocks(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    all_ = rows.collect()
    want = brute([r.vec_id for r in all_], np.array([r.embedding for r in all_], np.float64), 10)
    got = found(nearest(rows, query_bytes=100 * 64 * 8))
    assert sum(len(set(want[i]) & set(got[i])) for i in want) >= 0.999 * 10 * len(want)


@pytest.mark.parametrize("block", [7, 64])
def test_small_blocks_and_ties(spark, block):
    r = np.random.default_rng(2)
    x = r.integers(-3, 4, (150, 5)).astype(float)
    x[np.abs(x).sum(axis=1) == 0] = 1.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert found(nearest(df, k=4, block=block)) == brute(list(range(150)), x, 4)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = quantise(u)
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    slack = e[:, None] + e[None, :] * (1 + e[:, None])
    assert (np.abs(near - u @ u.T) <= slack).all()
    b = Block(np.arange(300), x)
    assert Heaps(300, 10).add(b, b) < 0.2 * 300 * 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, id string, v int")
    assert found(nearest(df)) == {1: [2, 2], 2: [1]}
    assert nearest(df.limit(0)).count() == 0 and nearest(df, df.limit(0)).count() == 0
    longs = spark.createDataFrame([(1, [1, 0]), (2, [2, 1]), (2, [0, 5])], "vec_id long, embedding array<int>")
    assert sorted((r.vec_id, r["rank"], r.neighbour_id) for r in nearest(longs).collect()) == [(1, 1, 2), (1, 2, 2), (2, 1, 1), (2, 1, 1)]
