from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from hopweave.llm.language import counts, fit, identify, op10_language_id, spherical
from tests.conftest import SF

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet(f"{SF01}/documents.parquet"))


def test_accuracy_and_clean_documents_stay(spark):
    got = {r.doc_id: r for r in op10_language_id(spark, SF01).collect()}
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = sum(got[d.doc_id].language == d.lang for d in docs)
    assert right >= 0.97 * len(docs) and sum(r.rejected for r in got.values()) <= 0.01 * len(docs)


def test_held_out_accuracy(spark):
    """Fitted without every fifth document, scored on these."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = docs.where("doc_id % 5 = 0")
    got = identify(held, fit(docs.where("doc_id % 5 <> 0"))).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) >= 0.97 * len(got) and sum(r.rejected for r in got) <= 0.02 * len(got)


def test_same_as_plain_loops(spark):
    """Document frequencies, cosines with every centroid and rejection, one text at a time."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    m = fit(spark.read.parquet(f"{SF}/documents.parquet"))
    c = [counts(pa.array([r.text], pa.large_string()))[0].astype(float) for r in rows]
    df = sum((x > 0).astype(float) for x in c)
    idf = np.log((1 + len(rows)) / (1 + df)) + 0.05
    assert np.allclose(m.idf, idf, rtol=1e-5)
    got = {r.doc_id: r for r in op10_language_id(spark, SF).collect()}
    for r, x in zip(rows, c):
        v = np.log1p(x) * idf
        cos = [float(v @ y / max(np.linalg.norm(v), 1e-12)) for y in m.centroids.astype(float)]
        best = max(range(len(cos)), key=lambda i: (cos[i], -m.owner[i]))
        length = min(int(np.log2(max(x.sum(), 1))), m.floor.shape[1] - 1)
        floor = m.floor[m.owner[best], length]
        assert got[r.doc_id].cosine == pytest.approx(cos[best] if x.any() else 0.0, abs=1e-5)
        if x.any() and abs(cos[best] - floor) > 1e-5:
            assert got[r.doc_id].rejected == (cos[best] < floor)
            assert got[r.doc_id].language == (None if cos[best] < floor else m.langs[m.owner[best]])


def test_centroids_are_those_of_plain_k_means():
    r = np.random.default_rng(3)
    x = np.abs(r.normal(size=(60, 8))) + 3 * np.eye(8)[r.integers(0, 3, 60)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = spherical(x, 3)
    own = [max(range(3), key=lambda j: float(v @ got[j])) for v in x]
    for j in range(3):  # a fixed point: every centroid is the direction of the sum of its own
        s = sum(v for v, o in zip(x, own) if o == j)
        assert np.allclose(got[j], s / np.linalg.norm(s), atol=1e-6)


def test_counts_by_plain_loops():
    from hopweave.llm.language import DIM, DIM_BITS

    texts = ["Ab  c!", "", "é1é", "aaaa"]
    want = np.zeros((4, DIM))
    for i, t in enumerate(texts):
        raw, out = t.lower().encode(), []
        for j, b in enumerate(raw):
            letter = 97 <= b < 123 or b >= 128
            if letter:
                out.append(b)
            elif j and (97 <= raw[j - 1] < 123 or raw[j - 1] >= 128):
                out.append(32)
        for n in range(1, 5):
            for j in range(len(out) - n + 1):
                h = 0
                for b in out[j : j + n]:
                    h = (h * 257 + b) % 2**32
                want[i, ((h * 2654435761 + n * 0x1F123BB5) % 2**32) >> (32 - DIM_BITS)] += 1
    assert (counts(pa.array(texts, pa.large_string())) == want).all()


def test_foreign_text_is_rejected(spark, model):
    rows = [(1, "дом стоит на горе и река течет мимо него " * 20), (2, "12345 67890 !!!"), (3, "zxqj kwvx qqzz xjxj vkvk " * 30)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].rejected and got[2].rejected and got[3].rejected and got[1].language is None


def test_odd_rows(spark, model):
    docs = spark.createDataFrame([(1, None, "en", 1.0), (2, "", "en", 1.0), (None, "the and of that with " * 9, "en", 1.0), (3, "the and of that with " * 40000, None, 1.0), (3, "the and of that with " * 40000, None, 1.0)], "doc_id long, text string, lang string, cosine double")
    out = identify(docs, model).collect()
    assert len(out) == 5 and [r.rejected for r in out if r.doc_id in (1, 2)] == [True, True]
    assert len({(r.language, r.cosine) for r in out if r.doc_id == 3}) == 1
    assert fit(docs.limit(0)) is None and identify(docs, None).where("NOT rejected").count() == 0
    assert identify(docs.limit(0), model).count() == 0
    assert fit(docs) is None  # no labelled row with letters
    op = op10_language_id(spark, SF)
    assert op.columns == ["doc_id", "language", "cosine", "rejected"] and op.count() == 200


def test_left_out_language_and_short_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    m = fit(docs.where("lang <> 'de'"))
    assert (m.floor > 0).all()
    got = identify(docs.where("lang = 'de' AND length(text) > 300"), m).collect()
    assert sum(r.rejected for r in got) >= 0.9 * len(got)
    words = ["дом стоит", "на горе и река", "zxqj kwvx qqzz", "ξένος τόπος", "xjxj vkvk"]
    short = identify(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), m).collect()
    assert sum(r.rejected for r in short) >= 3
    kept = identify(docs.where("lang <> 'de'"), m).collect()
    assert sum(r.rejected for r in kept) <= 0.02 * len(kept)
