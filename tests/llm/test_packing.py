from __future__ import annotations

import random

import pytest

from hopweave.llm.near_dup import components
from hopweave.llm.packing import cut_components, op4_packing, packed, walk
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_walk_is_greedy_and_lowest_degree_first():
    near = [[(1, 9), (2, 5)], [(0, 9), (2, 7), (3, 1)], [(0, 5), (1, 7)], [(1, 1)]]
    assert walk([0, 1, 2, 3], near) == [3, 1, 0, 2]
    assert walk([5], [[]]) == [5]


def pieces(rows, window):
    by = {}
    for r in rows:
        by.setdefault(r.window_id, []).append(r)
    for w in by.values():
        w.sort(key=lambda r: r.seq)
        assert [r.seq for r in w] == list(range(len(w))) and sum(r.n_tokens for r in w) <= window
    return by


def test_every_word_is_in_one_piece_and_windows_are_full(spark):
    rows = op4_packing(spark, SF).collect()
    by = pieces(rows, 2048)
    docs = {r.doc_id: len(r.text.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    for d, n in docs.items():
        at = 0
        for s, k in sorted(spans.get(d, [])):
            assert s == at
            at += k
        assert at == n
    last = max(by)
    assert all(sum(r.n_tokens for r in w) == 2048 for k, w in by.items() if k != last)


def test_related_documents_meet(spark):
    """Recall of the graph: the neighbour found is nearly as similar as the best by brute force."""
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(3000)]
    texts = []
    for g in range(60):
        base = [r.choice(vocab) for _ in range(120)]
        for _ in range(1 + g % 5):
            w = list(base)
            for _ in range(r.randrange(0, 25)):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(w)
    r.shuffle(texts)
    bags = [set(zip(w, w[1:])) for w in texts]
    docs = spark.createDataFrame([(i, " ".join(w), None, None, 0) for i, w in enumerate(texts)], SCHEMA)
    from pyspark.sql import functions as F

    from hopweave.llm.packing import _scan, graph
    from hopweave.llm.shared import as_text

    nodes = as_text(docs, "doc_id", "text").withColumn("node", F.col("doc_id")).mapInArrow(_scan, "node long, doc_id long, t long, heads binary, sketch binary")
    found = {}
    for e in graph(nodes).collect():
        found.setdefault(e.a, set()).add(e.b)
    jac = lambda a, b: len(bags[a] & bags[b]) / len(bags[a] | bags[b])
    good = total = 0
    for i in range(len(texts)):
        best = max(jac(i, j) for j in range(len(texts)) if j != i)
        if best >= 0.3:
            total += 1
            good += max((jac(i, j) for j in found.get(i, ())), default=0) >= 0.9 * best
    assert total > 100 and good >= 0.9 * total


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "x", "s", 0), (None, "a b", None, None, 3), (3, "a b " * 5000, "x", "s", 1), (4, "k l m", "x", "s", 1), (4, "k l m", "x", "s", 1)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA + ", node int, root int")
    out = packed(docs, window=64).collect()
    pieces(out, 64)
    tokens = {}
    for r in out:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {None: 2, 3: 10000, 4: 6}
    assert packed(docs.limit(0)).count() == 0


def test_components_of_no_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_large_components_are_cut_and_all_is_packed(spark):
    """One text in every document: a component of all, spread over tasks."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(80)] = f"x{r.randrange(999)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packed(docs, window=400, per_stream=4, most=40).collect()
    got = {}
    for x in out:
        got[x.doc_id] = got.get(x.doc_id, 0) + x.n_tokens
    assert got == {i: 80 for i in range(300)}
    size = {}
    for x in out:
        size[x.window_id] = size.get(x.window_id, 0) + x.n_tokens
    assert max(size.values()) <= 400


def test_components_are_cut_at_their_weakest_edges(spark):
    edges = [(1, 2, 60), (2, 3, 60), (3, 4, 21), (4, 5, 60), (5, 6, 60), (7, 8, 13)]
    e = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "a long, b long, w int")
    every = spark.createDataFrame([(i, 1) for i in range(1, 7)] + [(7, 7), (8, 7)], "node long, root long")
    got = {}
    for x in cut_components(every, e, most=3).collect():
        got.setdefault(x.root, set()).add(x.node)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [4, 5, 6], [7, 8]]
    tiny = {}
    for x in cut_components(every, e, most=1).collect():
        tiny.setdefault(x.root, set()).add(x.node)
    assert sum(map(len, tiny.values())) == 8
