from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hopweave.llm.textnum import Words
from hopweave.llm.toxicity import CREDIT, CREDITED, LOOSE, NOISE, Spelling, Tokens, code, fit, learn, op7_toxicity, readings, scored, spelling, threshold

WORDS = ["idiot", "moron", "clown", "scum", "worthless", "pathetic", "disgusting", "trash"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def model(spark, big):
    sp = spelling(big[0])
    return sp, fit(*big, sp)


def test_decoder_finds_the_cheapest_path():
    r = np.random.default_rng(0)
    sp = Spelling(r.integers(0, 50, 28**3))

    def price(s, extra):
        a, b, v = 27, 27, extra
        for c in s:
            v += sp.cost[a][b][code(c)]
            a, b = b, code(c)
        return v + sp.cost[a][b][27]

    for token, slots in {
        "1d10t": [[("i", 1), ("l", 1)], [("d", 0)], [("i", 1), ("l", 1)], [("o", 1)], [("t", 0)]],
        "a@bbb7": [[("a", 0)], [("a", 1)], [("b", 0.8), ("bb", 0.4)], [("t", 1)]],
        "see$$": [[("s", 0)], [("e", 0.4), ("ee", 0)], [("s", 2.4), ("ss", 2)]],
    }.items():
        all_ = [("".join(x for x, _ in p), sum(e for _, e in p)) for p in itertools.product(*slots)]
        assert sp.restore(token) == min(all_, key=lambda x: price(*x))[0]
        assert sp.restore(token, CREDITED) == min(all_, key=lambda x: price(*x) - CREDIT * len(x[0]))[0]
    loose = [[("s", 1), ("", NOISE)], [("t", 0)], [("o", 0)], [("i", 2.4), ("ii", 2), ("", NOISE)]]
    all_ = [("".join(x for x, _ in p), sum(e for _, e in p)) for p in itertools.product(*loose)]
    assert sp.restore("$to!!", LOOSE) == min(all_, key=lambda x: price(*x))[0]
    assert sp.restore("plain") == "plain" and sp.restore("b-o-k") == "bok"


def words_of(text, sp):
    """Hashes of the restored words of a text, and those of given words."""
    t = Tokens(pa.array([text], pa.large_string()), sp)
    of = lambda w: int(Words(pa.array([w], pa.large_string()), True, False).hash[0])
    return set(t.hash.tolist()), of


@pytest.mark.parametrize(
    ("text", "word"),
    [
        ("x $tupid!! y", "stupid"), ("you @$$hole", "asshole"), ("$#!t", "shit"), ("a$$!!!", "ass"), ("an iddiot here", "idiot"), ("moroon", "moron"), ("stuupid", "stupid"), ("a s s", "ass"), ("i  d\ti o t!", "idiot"),
        ("so i d i o t a", "idiot"), ("I D I O T", "idiot"), ("1 d 1 0 t", "idiot"), ("i-d-i-o-t", "idiot"), ("idiooooot", "idiot"), ("(1d10t),", "idiot"), ("asssshole", "asshole"), ("c l o w n s h o e s a r e h e r e t o d a y", "clownshoesarehere"), ("plain words", "words"), ("@#$tupid!@#$%&+|!", "tupid"),
    ],
)
def test_readings_of_disguised_words(model, text, word):
    got, of = words_of(text, model[0])
    assert of(word) in got


def test_held_out_accuracy(spark, big):
    """Fitted without every fifth labelled document, scored on these."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    sp = spelling(docs)
    held = labels.where("doc_id % 5 = 0")
    scores = fit(docs, labels.where("doc_id % 5 <> 0"), sp)
    rows = scored(docs.where("lang = 'en'"), sp, scores).join(held.withColumnRenamed("toxic", "label"), "doc_id").select("toxic", "label").collect()
    hit, said, true = sum(a and b > 0 for a, b in rows), sum(a for a, _ in rows), sum(b > 0 for _, b in rows)
    assert true >= 20 and hit >= 0.9 * said and hit >= 0.9 * true


def test_the_query_scores_all_documents(spark, big):
    docs = big[0]
    got = {r.doc_id: r.toxic for r in op7_toxicity(spark, "/root/testdata/sf0.01").collect()}
    # labels of the other languages say nothing about their texts
    english = {r.doc_id for r in docs.where("lang = 'en'").select("doc_id").collect()}
    assert len(got) == docs.count() and sum(v for k, v in got.items() if k not in english) <= 0.03 * len(got)


def test_scores_are_those_of_plain_loops(spark, model):
    """Score and decision of whole texts by sets of words, one text at a time."""
    sp, m = model
    texts = ["You 1d10t! see the iddiot", "clean words only", "m o r o n", "", "p@thetic $cum!! and trash, trash"]
    of = lambda w: int(Words(pa.array([w], pa.large_string()), True, False).hash[0])
    weight = dict(zip(m.hashes.tolist(), m.weights.tolist()))
    want = []
    for t in texts:
        tokens = t.lower().split()
        words = set(re.findall(r"[a-z0-9]+", t.lower()))
        for x in tokens:
            words |= {sp.restore(*r) for r in readings(x)} | {re.sub(r"(.)\1+", r"\1", x)}
        if t.startswith("m o"):
            words |= {"moron"[i:j] for i in range(5) for j in range(i + 2, 6)}
        want.append(max([weight.get(of(w), 0.0) for w in words if w], default=0.0))
    rows = scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sp, m).collect()
    by = {r.doc_id: r for r in rows}
    assert [by[i].score for i in range(5)] == pytest.approx([round(x, 6) for x in want])
    assert [by[i].toxic for i in range(5)] == [x >= m.threshold for x in want] and want[0] > 0 and want[1] == 0


def test_planted_obfuscation(spark, big, model):
    r = random.Random(4)
    clean = [x.text for x in big[0].collect() if x.lang == "en" and not any(w in x.text.lower() for w in WORDS) and "$$$" not in x.text][:60]
    # the words the model has learnt at this size
    sp, scores = model
    known = [w for w in WORDS if scores.of(Tokens(pa.array([w], pa.large_string()), sp), 1)[0] >= scores.threshold]
    assert len(known) >= 3
    leet = str.maketrans({"i": "1", "o": "0", "e": "3", "a": "@", "s": "$"})
    ways = [lambda w: w.translate(leet), lambda w: " ".join(w), lambda w: "-".join(w), lambda w: w[:2] + w[2] * 4 + w[3:], lambda w: w.upper() + "!!!", lambda w: w.capitalize() + ",", lambda w: w[:2] + w[1:], lambda w: w.translate(leet) + "!!!", lambda w: "   ".join(w)]
    rows = []
    for i, t in enumerate(clean):
        words = t.split(" ")
        at = r.randrange(len(words) + 1)
        w = ways[i % len(ways)](known[i % len(known)])
        rows.append((i, " ".join([*words[:at], w, *words[at:]]), None, None, 0))
        rows.append((1000 + i, t, None, None, 0))
    got = {x.doc_id: x.toxic for x in scored(spark.createDataFrame(rows, SCHEMA), *model).collect()}
    assert sum(got[i] for i in range(60)) >= 55
    assert sum(got[1000 + i] for i in range(60)) <= 3


def test_parts():
    w = learn(np.array([30.0, 2, 30, 30]), np.array([0.0, 0, 900, 5]), 100, 900)
    assert w[0] > w[3] > 0 and w[1] == 0 and w[2] == 0
    assert threshold(np.array([0, 1, 2, 3.0]), np.array([False, False, True, True])) == 1.5
    assert threshold(np.zeros(0), np.zeros(0, bool)) == np.inf


def test_odd_rows(spark, big, model):
    rows = [(1, None, None, None, None), (2, "", "x", "s", 0), (None, "a b", None, None, 3), (3, "i d i o t " * 9000, "x", "s", 1), (4, "k7" * 30000, "x", "s", 1), (5, "a " * 5000, "x", "s", 1), (5, "a " * 5000, "x", "s", 1)]
    docs = spark.createDataFrame([(*r, 3, "c") for r in rows], SCHEMA + ", toxic int, score string")
    out = scored(docs, *model).collect()
    assert len(out) == 7 and {r.doc_id: r.score for r in out}[1] == 0 and not {r.doc_id: r.toxic for r in out}[2]
    assert scored(docs.limit(0), *model).count() == 0
    none = fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), model[0])
    assert not any(r.toxic for r in scored(docs, spelling(docs.limit(0)), none).collect())
    odd = fit(big[0], spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, None, 0), (2, None, 0)], "doc_id long, quality int, toxic int"), model[0])
    assert odd.threshold == np.inf


def test_a_labelled_id_on_several_texts_counts_for_each(spark, model):
    rows = [(i % 10, f"awfulword{'' if i < 10 else ' b' + str(i)} c{i}") for i in range(30)] + [(100 + i, f"fine d{i}") for i in range(30)]
    labels = spark.createDataFrame([(i, 1, int(i < 10)) for i, _ in rows] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    m = fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, model[0])
    got = {r.doc_id: r.score for r in scored(spark.createDataFrame([(1, "awfulword"), (2, "fine")], "doc_id long, text string"), model[0], m).collect()}
    assert got[1] > 0 and got[2] == 0
