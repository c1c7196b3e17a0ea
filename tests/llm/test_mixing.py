from __future__ import annotations

import math

import numpy as np
import pytest

from hopweave.llm.mixing import mixed, op8_mixing, rates
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def solve(rows, want, tongue, length):
    """The same dual by plain gradient scaling over single documents (iterative proportional fitting
    of sources and languages with a bisection for the length)."""
    t = np.array([r[0] for r in rows], float)
    z = np.tanh((np.log2(t) - 8) / 4)
    src, lang = [r[1] for r in rows], [r[2] for r in rows]
    w = np.ones(len(rows))
    for _ in range(3000):
        for key, goal in ((src, want), (lang, tongue)):
            for k, g in goal.items():
                m = np.array([x == k for x in key])
                w[m] *= g / (t[m] * w[m]).sum()
        lo, hi = -5.0, 5.0
        for _ in range(60):
            b = (lo + hi) / 2
            lo, hi = (b, hi) if (t * w * np.exp(b * z) * z).sum() < length else (lo, b)
        w *= np.exp(lo * z)
    return w


def test_same_as_brute_force(spark):
    rows = [(1 + 37 * i % 900, "abc"[i % 3], "xy"[(i * i) % 5 % 2]) for i in range(40)]
    docs = spark.createDataFrame([(i, "w " * t, y, s, 0) for i, (t, s, y) in enumerate(rows)], SCHEMA)
    targets = {"a": 1.0, "b": 1.0, "c": 2.0, "absent": 3.0}
    got = {r.doc_id: r.rate for r in rates(docs, targets).collect()}
    total = sum(r[0] for r in rows)
    tongue = {y: sum(r[0] for r in rows if r[2] == y) for y in "xy"}
    length = sum(r[0] * math.tanh((math.log2(r[0]) - 8) / 4) for r in rows)
    w = solve(rows, {k: v * total / 4 for k, v in targets.items() if k != "absent"}, tongue, length)
    assert [got[i] for i in range(40)] == pytest.approx(w.tolist(), rel=1e-4)


def test_constraints_hold_and_copies_follow(spark):
    rows = op8_mixing(spark, SF).collect()
    sums, now = {}, {}
    for r in rows:
        sums[r.source] = sums.get(r.source, 0) + r.n_tokens
        now[r.source] = now.get(r.source, 0) + r.n_tokens * r.rate
        assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
    norm = sum(sums.values()) / sum(v**0.7 for v in sums.values())
    assert now == pytest.approx({k: norm * v**0.7 for k, v in sums.items()}, rel=1e-6)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "x", "s", 0), (None, "a b", None, None, 3), (3, "a " * 9999, "x", "s", 1), (4, "k", "x", "gone", 1), (4, "k", "x", "gone", 1)]
    docs = spark.createDataFrame([(*r, 7, "c", 0.5) for r in rows], SCHEMA + ", n_tokens int, COPIES string, nth double")
    out = rates(docs, {"s": 1.0}).collect()
    by = {(r.doc_id, r.text): (r.rate, r["copies_"]) for r in out}
    assert {(r["n_tokens"], r["COPIES"], r["nth"]) for r in out} == {(7, "c", 0.5)} and {r["n_tokens_"] for r in out} == {0, 1, 2, 9999}
    assert {(r["n_tokens"], r["COPIES"], r["nth"]) for r in mixed(docs).collect()} == {(7, "c", 0.5)}
    assert len(out) == 6 and by[4, "k"] == (0.0, 0) and by[2, ""] == (1.0, 1) and by[1, None] == (0.0, 0)
    assert by[3, rows[3][1]][0] == pytest.approx(1.0)
    assert mixed(docs).columns == docs.columns
    assert mixed(docs.limit(0)).count() == 0
    assert mixed(docs.where("doc_id = 2")).count() == 1
