from __future__ import annotations

import random
from collections import Counter

import numpy as np

from hopweave.llm.near_dup import dart_signatures, near_duplicates, near_groups, op9_near_dup, spans
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def bag(words):
    return Counter(zip(words, words[1:]))


def jaccard(a, b):
    both = a.keys() | b.keys()
    return sum(min(a[x], b[x]) for x in both) / max(1, sum(max(a[x], b[x]) for x in both))


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    for overlap in (0.2, 0.6, 0.9):
        elem = r.integers(1, 2**48, 400).astype(np.uint64)
        w = r.integers(1, 9, 400)
        n = int(400 * overlap)
        a, b = (elem, w), (np.r_[elem[:n], r.integers(1, 2**48, 400 - n).astype(np.uint64)], np.r_[w[:n] + r.integers(0, 3, n), w[n:]])
        true = jaccard(Counter(dict(zip(a[0].tolist(), a[1].tolist()))), Counter(dict(zip(b[0].tolist(), b[1].tolist()))))
        doc = np.repeat([0, 1], 400)
        s = dart_signatures(doc, np.r_[a[0], b[0]], np.r_[a[1], b[1]].astype(float), 2, 512)
        assert abs((s[0] == s[1]).mean() - true) < 0.09


def test_spans_connect_what_is_equal_enough():
    r = np.random.default_rng(0)
    sig = r.integers(0, 2, (40, 16)).astype(np.uint16)
    edges = spans(sig, 12)
    adj = {i: {j for j in range(40) if j != i and (sig[i] == sig[j]).sum() >= 12} for i in range(40)}

    def closure(links):
        root = list(range(40))
        for i, j in links:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
        return [root.index(x) for x in root]

    assert closure(edges) == closure([(i, j) for i in adj for j in adj[i]])


def test_recall_against_brute_force_and_clean_documents(spark):
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(4000)]
    texts = []
    for g in range(80):
        base = [r.choice(vocab) for _ in range(r.randrange(60, 400))]
        for _ in range(1 + g % 4):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.02, 0.05, 0.1]))):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append((g, w))
    r.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(w), None, None, 0) for i, (_, w) in enumerate(texts)], SCHEMA)
    group = {x.doc_id: x.group_id for x in near_duplicates(docs).collect()}
    bags = [bag(w) for _, w in texts]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if texts[i][0] == texts[j][0] and jaccard(bags[i], bags[j]) >= 0.65]
    hit = sum(group.get(i, -i) == group.get(j, -j) for i, j in near)
    assert len(near) > 50 and hit >= 0.95 * len(near)
    for i, g in group.items():
        assert texts[i][0] == texts[g][0]


def test_groups_of_the_table(spark):
    rows = op9_near_dup(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    members = {}
    for r in rows:
        members.setdefault(r.group_id, []).append(r)
    assert len(rows) == len({r.doc_id for r in rows})
    for g, m in members.items():
        assert len(m) > 1 and [r.doc_id for r in m if r.keep] == [g] == [min(r.doc_id for r in m)]
    group = {r.doc_id: r.group_id for r in rows}
    same = {}
    for d, t in docs.items():
        same.setdefault(t, []).append(d)
    assert all(len({group.get(d) for d in ds}) == 1 and None not in {group.get(d) for d in ds} for t, ds in same.items() if len(ds) > 1 and t.split())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "x y " * 50000), (4, "x y " * 50000), (5, "k"), (6, "K!"), (7, "m n o"), (7, "m n o"), (8, "..."), (9, " \n")]
    docs = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "doc_id long, text string, key string, rep int, group_id int")
    got = {(r.doc_id, r.group_id, r.keep) for r in near_duplicates(docs).collect()}
    assert {(3, 3, True), (4, 3, False), (5, 5, True), (6, 5, False)} <= got and {d for d, _, _ in got} <= {3, 4, 5, 6, 7}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_hot_buckets_lose_no_link(spark):
    """Buckets taken for hot are linked as others: by their hub, and in cells where members differ."""
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(6):
        base = r.choice(words, 60).tolist()
        for j in range(30):  # a drift, so that the ends of a chain are unlike each other and linked by its middle
            base[int(r.integers(60))] = f"x{g}_{j}"
            rows.append((100 * g + j, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(x.doc_id, x.group_id, x.keep) for x in near_groups(docs).collect()}
    for cell in (3, 64):
        assert {(x.doc_id, x.group_id, x.keep) for x in near_groups(docs, hot=4, cell=cell).collect()} == want
    assert len(want) > 100


def test_one_id_on_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a.replace("a7 ", "z ")), (3, b), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.copies, r.group_id, r.keep) for r in near_groups(docs).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
