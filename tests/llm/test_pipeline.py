from __future__ import annotations

import corpus_pipeline as cp
from hopweave.llm.near_dup import near_duplicates
from hopweave.llm.shared import documents, materialise
from tests.conftest import SF


def test_stages_take_effect(spark):
    docs = documents(spark, SF)
    first = docs
    for name, stage in cp.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), name)
        assert out.columns == first.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {}
        for r in out.collect():
            after.setdefault(r.doc_id, []).append(r)
        assert set(after) <= set(before)
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        if name == "near_dup":
            gone = {r.doc_id for r in near_duplicates(docs).collect() if not r.keep}
            assert set(before) - set(after) == gone and near_duplicates(out).count() == 0
        if name == "repeats":
            assert all(len(a[0].text) == a[0].n_chars and len(a[0].text) <= len(before[d].text) for d, a in after.items())
            assert sum(a[0].text == before[d].text for d, a in after.items()) >= 0.5 * len(before)
        docs = out
    words = sum(len(r.text.split()) for r in docs.collect())
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert sum(r.n_tokens for r in packed.collect()) == words


def test_run_and_empty_input(spark, tmp_path):
    assert cp.run(spark, SF).count() > 0
    none = documents(spark, SF).limit(0)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


CLASH = ", found string, own string, th string, copies string, keep string, hit string, __text string, __id string, n_tokens string, rate string, nth string"


def test_odd_rows_in_every_stage(spark):
    """Nulls in any column, empty and very long texts, repeats, one id on two texts, and clashing names."""
    plain = "the of and to in that is for " * 12
    long = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "the of and to in a " * 30, "en", "s", 9), (3, plain, "en", None, 9), (4, long, "en", "s", 1), (5, "one id on two texts of the same", "en", "s", 1), (5, "and the other that is in there", "en", "s", 1), (6, "the same row", "en", "s", 1), (6, "the same row", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, *"abcdefghijk") for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + CLASH)
    out = {}
    for name, stage in cp.STAGES:
        out[name] = materialise(stage(spark, docs, SF), name)
        if name != "packing":
            assert out[name].columns == docs.columns
            assert all(tuple(r)[5:] == tuple("abcdefghijk") for r in out[name].collect())
    texts = {n: sorted((r.doc_id or 0, r.text or "") for r in d.collect()) for n, d in out.items() if n != "packing"}
    every = sorted((r[0] or 0, r[1] or "") for r in rows)
    assert not {(1, ""), (2, "")} & set(texts["language_id"]) and (4, long) in texts["language_id"]
    assert texts["near_dup"] == sorted(set(every))
    ids = [i for i, _ in texts["repeats"]]
    assert ids == [i for i, _ in every] and dict(texts["repeats"])[4] == long and len(dict(texts["repeats"])[3]) < len(plain)
    assert (1, "") in texts["mixing"] and texts["mixing"].count((6, "the same row")) % 2 == 0
    got = {}
    for r in out["packing"].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for i, t, *_ in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    assert got == {i: n for i, n in want.items() if n}


def test_near_dup_keeps_one_row_of_every_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(120)) for x in "abc")
    near = a.replace("a7 ", "other ")
    rows = [(1, a), (1, a), (2, a), (7, b), (7, b), (7, b), (8, c), (5, near), (5, c + " tail"), (9, "lone words only"), (None, a), (10, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r.doc_id or 0, r.text or "") for r in cp.drop_near_duplicates(spark, docs, SF).collect())
    assert left == sorted([(1, a), (7, b), (5, c + " tail"), (9, "lone words only"), (0, a), (10, "")])
