from __future__ import annotations

import random

import numpy as np
import pytest

from hopweave.llm import repeats
from hopweave.llm.anchors import owners
from hopweave.llm.repeats import _sorted, maximal_repeats, occurrences, without_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts: dict[int, list[str]], least: int) -> set:
    """All maximal repeats with all occurrences, by trying every pair of positions."""
    found = {}
    at = [(d, i) for d, w in texts.items() for i in range(len(w))]
    for x in range(len(at)):
        for y in range(x):
            (d, i), (e, j) = at[x], at[y]
            a, b = texts[d], texts[e]
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                found[tuple(a[i : i + n])] = None
    out = set()
    for u in found:
        occ = tuple(sorted((d, i) for d, w in texts.items() for i in range(len(w) - len(u) + 1) if tuple(w[i : i + len(u)]) == u))
        out.add((len(u), occ))
    return out


def got(trees) -> set:
    groups = {}
    for r in occurrences(trees).collect():
        groups.setdefault((r.tree_id, r.first, r.last, r.n_words), []).append((r.doc_id, r.start))
    assert all(len(v) == k[2] - k[1] + 1 > 1 for k, v in groups.items())
    return {(k[3], tuple(sorted(v))) for k, v in groups.items()}


def corpus(seed: int) -> dict[int, list[str]]:
    r = random.Random(seed)
    words = ["ab", "cd", "ef", "gh"] if seed % 2 else [f"w{i}" for i in range(40)]
    base = [r.choice(words) for _ in range(60)]
    out = {}
    for d in range(8):
        w = list(base) if d % 2 else [r.choice(words) for _ in range(50)]
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        if d == 4:
            w = w[:20] + base[10:40] + w[20:] + base[10:40]
        out[d] = w
    out[8] = list(out[3])
    return out


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_same_as_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(d, " ".join(w), None, None, 0) for d, w in texts.items()], SCHEMA)
    assert got(maximal_repeats(docs, least=12)) == brute(texts, 12)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(3000))
    rows = [(1, None, None, None, None), (2, "", "x", "s", 0), (None, long, None, None, None), (3, "short", None, None, 5), (4, "a " * 500, None, None, 1000), (5, long, None, "s", 9), (6, long, None, "s", 9), (6, long, None, "s", 9)]
    docs = spark.createDataFrame([(*r, "clash", "a", "b", "c") for r in rows], SCHEMA + ", start string, __text string, __ID string, __th string")
    trees = maximal_repeats(docs)
    assert (3000, ((5, 0), (6, 0))) in got(trees)
    assert all({d for d, _ in occ} <= {4, 5, 6} for _, occ in got(trees))
    left = without_repeats(docs)
    assert left.columns == docs.columns
    by = {}
    for r in left.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[5] == [long] and 6 not in by and by[None] == [long] and by[1] == [None] and by[2] == [""] and by[3] == ["short"]
    assert maximal_repeats(docs.limit(0)).count() == 0 and without_repeats(docs.limit(0)).count() == 0


def test_cut_keeps_the_first_and_the_rest(spark):
    r = random.Random(5)
    p = " ".join(f"p{r.randrange(10**6)}" for _ in range(60))
    own = [" ".join(f"q{r.randrange(10**6)}" for _ in range(30)) for _ in range(4)]
    docs = spark.createDataFrame([(1, f"{own[0]}. {p}, {own[1]}", "en", "a", 1), (2, f"{own[2]}\n{p}\n{own[3]}", "en", "a", 1), (3, own[0], "en", "b", 1)], SCHEMA)
    out = {x.doc_id: x.text for x in without_repeats(docs).collect()}
    assert out == {1: f"{own[0]}. {p}, {own[1]}", 2: f"{own[2]}\n{own[3]}", 3: own[0]}


@pytest.mark.parametrize("words", [["a"] * 60, [f"b{i}" for i in range(15)] * 4, ["x", *"cd" * 25, "y"], ["z"] + [f"e{i % 20}" for i in range(70)]])
def test_a_document_that_repeats_only_itself(spark, words):
    docs = spark.createDataFrame([(4, " ".join(words), None, None, 0), (5, " ".join(f"u{i}" for i in range(80)), None, None, 0)], SCHEMA)
    want = brute({4: words}, 12)
    assert want and got(maximal_repeats(docs, least=12)) == want
    left = {r.doc_id: r.text for r in without_repeats(docs, least=12).collect()}
    assert len(left[4].split()) < len(words) and set(left[4].split()) == set(words)


def test_long_suffixes_are_sorted_as_short_ones(monkeypatch):
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 40):
        texts = [r.integers(0, 2, k).astype(">u4").tobytes() for k in (n, 3 * n, n)] + [b"\0\0\0\7" * n]
        texts.append(texts[0])
        own = np.repeat(np.arange(5), [len(t) // 4 for t in texts])
        pos = np.concatenate([np.arange(len(t) // 4) for t in texts])
        some = r.permutation(len(own))[: max(2, len(own) // 2)]
        want = _sorted(texts, own[some], pos[some])
        with monkeypatch.context() as m:
            m.setattr(repeats, "COPIED", -1)
            got_ = _sorted(texts, own[some], pos[some])
        assert (want[0] == got_[0]).all() and (want[1] == got_[1]).all()


def test_one_word_very_often(spark):
    docs = spark.createDataFrame([(1, "a " * 30000, None, None, 0)], SCHEMA)
    tree = maximal_repeats(docs).collect()
    assert len(tree) == 29951 and {r.n_words for r in tree} == {50} and sum(len(r.repeats) for r in tree) == 29950
    assert {r.start for r in tree} == set(range(29951)) and {r.nth for r in tree} == set(range(29951))
    assert [r.text.strip() for r in without_repeats(docs).collect()] == ["a"]


def test_long_arrays_are_cut_into_overlapping_pieces():
    v = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    v[100:140] = v[99]
    assert (owners(v, 43, 7) == owners(v & ~np.uint64(127), 43)).all() and len(owners(v, 43, 7)) == 5000 - 42
    assert len(owners(v[:42], 43)) == 0


def test_one_id_on_two_texts(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    docs = spark.createDataFrame([(1, p, "en", "a", 1), (1, f"{q} x", "en", "a", 1), (2, f"{p} y", "en", "a", 1), (3, q, "en", "a", 1)], SCHEMA)
    assert got(maximal_repeats(docs)) == {(60, ((1, 0), (2, 0))), (60, ((1, 0), (3, 0)))}
    assert sorted((r.doc_id, r.text) for r in without_repeats(docs).collect()) == [(1, p), (1, f"{q} x"), (2, "y")]
