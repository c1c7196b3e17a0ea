from __future__ import annotations

import math
import random

import numpy as np
import pytest

from hopweave.llm import registry
from hopweave.llm.topk import Share, top_k
from tests.conftest import SF
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


def brute(docs, queries, k):
    words = {i: t.lower().split() for i, t in docs}
    words = {i: w for i, w in words.items() if w}
    mean = sum(map(len, words.values())) / max(1, len(words))
    out = {}
    for q, t in queries:
        scores = []
        for i, w in words.items():
            s = 0.0
            for x in set(t.lower().split()):
                df = sum(x in v for v in words.values())
                tf = w.count(x)
                s += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if s > 0:
                scores.append((-round(s, 9), i))
        out[q] = sorted(scores)[:k]
    return {q: [i for _, i in v] for q, v in out.items() if v}


@pytest.mark.parametrize("blocks", [1 << 20, 40])
def test_same_as_scoring_everything(spark, blocks):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(r.choices(vocab, [1 / (j + 1) for j in range(40)], k=r.randrange(0, 40)))) for i in range(150)]
    docs += [(1000 + i, docs[i][1]) for i in range(10)]
    queries = [(i, " ".join(r.choices(vocab, k=1 + i % 7))) for i in range(20)] + [(50, "absent"), (51, "")]
    d = spark.createDataFrame([(*x, 0, "c") for x in docs], "doc_id long, text string, item_id int, words string")
    got = {}
    for x in sorted(top_k(d, spark.createDataFrame(queries, "item_id long, text string"), k=5, query_bytes=blocks).collect(), key=lambda x: x["rank"]):
        got.setdefault(x.item_id, []).append(x.doc_id)
    assert got == brute(docs, queries, 5)


def test_stops_on_proof_only():
    r = np.random.default_rng(0)
    n, t = 5000, 6
    doc = np.concatenate([np.sort(r.choice(n, 3000, replace=False)) for _ in range(t)])
    term = np.repeat(np.arange(t), 3000)
    tf = 1 + r.poisson(1, len(doc))
    size = r.integers(5, 500, n)
    idf = np.array([0.1, 3.0, 0.2, 2.5, 0.1, 0.3])
    part = (np.arange(n), size.astype(np.int32), term.astype(np.uint32), doc.astype(np.uint32), tf.astype(np.uint32))
    s = Share([tuple(x.tobytes() for x in part)], idf, 200.0)
    full = np.zeros(n)
    for i in range(len(s.key)):
        full[s.key[i] & 0xFFFFFFFF] += s.impact[i]
    for floor in (0.0, np.sort(full)[-4]):
        s.read = s.held = 0
        found, score = s.search(np.arange(t), 10, floor)
        assert np.allclose(score, full[found]) and len(found) < n / 10
        best = set(np.argsort(-full)[:10].tolist())
        assert {d for d in best if full[d] >= floor} <= set(found.tolist())
        assert s.held == len(doc) and s.read < 0.7 * s.held  # the segments of the frequent words are left unread


def test_segments_left_unread_in_a_corpus():
    """Words as frequent as in a language: most postings belong to words that can't decide."""
    r = np.random.default_rng(1)
    n, t = 3000, 40
    p = 0.9 / (1 + np.arange(t)) ** 0.8
    hit = r.random((t, n)) < p[:, None]
    hit[:, :12] = True  # copies of the query
    term, doc = np.nonzero(hit)
    tf, size = 1 + r.poisson(0.3, len(doc)), r.integers(30, 300, n)
    df = hit.sum(axis=1)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    s = Share([tuple(x.tobytes() for x in (np.arange(n), size.astype(np.int32), term.astype(np.uint32), doc.astype(np.uint32), tf.astype(np.uint32)))], idf, 165.0)
    full = np.zeros(n)
    np.add.at(full, s.key & 0xFFFFFFFF, s.impact)
    found, score = s.search(np.arange(t), 10, 0.0)
    assert set(np.argsort(-full)[:10].tolist()) <= set(found.tolist()) and np.allclose(score, full[found])
    assert s.read < s.held


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x y"), (3, "x " * 50000), (4, "x y"), (4, "x y")]
    docs = spark.createDataFrame([(*r, "c", 1.0) for r in rows], "doc_id long, text string, rank string, score double")
    q = spark.createDataFrame([(1, "X, y!"), (1, "X, y!"), (2, None), (None, "x"), (3, "?")], "item_id long, text string")
    out = top_k(docs, q).collect()
    assert sorted((r["rank"], r.doc_id) for r in out) == [(1, 4), (2, 4), (3, 3)] and {r.item_id for r in out} == {1}
    assert top_k(docs.limit(0), q).count() == 0 and top_k(docs, q.limit(0)).count() == 0


def test_one_query_id_on_several_texts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d"), (2, "a"), (3, "e")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "a b"), (7, "c b"), (8, "a b c")], "item_id long, text string")
    by = {}
    for r in top_k(docs, q).collect():
        by.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    assert len(by[7]) == 3 and sorted(by[7]) == sorted(by[8])
