from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopweave.llm.textnum import U, grams
from hopweave.llm.tokenstore import LONGEST, MASK, SHORTEST, SPAN, VOCABULARY, Encoder, Store, cuts, digest, op3_token_store, rebuild, root, verify, write
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def enc():
    return Encoder()


def test_batches_give_the_encoders_ids(enc):
    r = random.Random(1)
    alphabet = ["a", "Ü", "’", " ", "  ", "\n", "\t", "12", "don't", "x!", " ", "\x1f", "漢", "🙂", "<|endoftext|>", ".", "\r\n"]
    texts = ["", " ", "  ", *["".join(r.choice(alphabet) for _ in range(r.randrange(30))) for _ in range(2000)]]
    for s in range(0, len(texts), 300):
        ids, offs = enc.encode(pa.array(texts[s : s + 300], pa.large_string()))
        for t, a, b in zip(texts[s:], offs[:-1], offs[1:], strict=False):
            assert ids[a:b].tolist() == enc.coder.encode_ordinary(t), t


def test_cuts_depend_on_content():
    r = np.random.default_rng(0)
    x = r.integers(0, 50000, 20000).astype("<u2")
    a = next(cuts(x, np.array([0, len(x)])))
    y = np.r_[r.integers(0, 50000, 777).astype("<u2"), x]
    b = next(cuts(y, np.array([0, len(y)])))
    assert len(set(np.array(b) - 777) & set(a)) > 0.9 * len(a)
    assert max(np.diff([0, *a])) <= 1024 and a[-1] == len(x)
    same = np.zeros(5000, "<u2")
    assert next(cuts(same, np.array([0, 5000])))[-1] == 5000


def test_round_trip_and_each_chunk_once(spark, tmp_path, enc):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    store = write(docs, str(tmp_path / "store"))
    assert store.chunks.groupBy("digest").count().where("count > 1").count() == 0
    back = {r.doc_id: enc.coder.decode(np.frombuffer(r.ids, "<u2").tolist()) for r in rebuild(store).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    total = store.manifest.agg(F.sum("n_ids")).first()[0]
    kept = store.chunks.agg(F.sum(F.length("data"))).first()[0] / 2
    assert kept < total


def test_verify_sees_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " + "word " * 300 + str(i) * 50, None, None, 0) for i in range(20)], SCHEMA)
    store = write(docs, str(tmp_path / "s"))
    assert all(r.verified for r in verify(store).collect())
    some = store.chunks.first()
    store.chunks = store.chunks.withColumn("data", F.when(F.col("digest") == F.lit(some.digest), F.lit(b"\0" * len(some.data))).otherwise(F.col("data")))
    assert not all(r.verified for r in verify(store).collect())
    store.chunks = Store(spark, str(tmp_path / "s")).chunks.where(F.col("digest") != F.lit(some.digest))
    assert not all(r.verified for r in verify(store).collect())


def test_roots():
    a, b, c = b"a" * 16, b"b" * 16, b"c" * 16
    assert len({root([]), root([a]), root([a, b]), root([b, a]), root([a, b, c]), root([a, b, c, c])}) == 6


def test_whole_table(spark):
    rows = op3_token_store(spark, SF).collect()
    assert len(rows) == 200 and all(r.verified for r in rows)


def plain_root(ids, width) -> tuple[str, int]:
    """Cuts at every position tried on its own, then the tree of digests by recursion."""
    chunks, at = [], 0
    for i in range(len(ids)):
        n = i + 1 - at
        low = i + 1 >= SPAN and i + 1 < len(ids) and int(grams(ids[i + 1 - SPAN : i + 1].astype(U) + U(1), SPAN)[0]) & MASK == 0
        if i + 1 == len(ids) or n >= LONGEST or low and n >= SHORTEST:
            chunks.append(digest(ids[at : i + 1].astype(f"<u{width}").tobytes()))
            at = i + 1

    def up(level: list[bytes]) -> bytes:
        if len(level) == 1:
            return level[0]
        return up([hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16, person=b"node").digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)])

    top = up(chunks) if chunks else b""
    return hashlib.blake2b(top + len(chunks).to_bytes(8, "little"), digest_size=16, person=b"root").hexdigest(), len(chunks)


def test_whole_table_same_as_brute_force(spark, enc):
    got = {r.doc_id: (r.root, r.n_chunks) for r in op3_token_store(spark, SF).collect()}
    want = {r.doc_id: plain_root(np.array(enc.coder.encode_ordinary(r.text), np.uint32), 2) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == want


def test_large_vocabulary_has_wide_ids(spark, tmp_path):
    """Ids beyond 16 bits take 4 bytes, and the check knows it."""
    small = open(VOCABULARY, "rb").read().split(b"\n")
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"\n".join([*(x for x in small if x), base64.b64encode(b"qzxqzx") + b" 70000"]))
    docs = spark.createDataFrame([(1, "some text " * 90), (2, "")], "doc_id long, text string")
    store = write(docs, str(tmp_path / "w"), vocabulary=str(path))
    out = {r.doc_id: r for r in verify(store).collect()}
    assert store.width == 4 and all(r.verified for r in out.values())
    ids = np.array(Encoder(str(path)).coder.encode_ordinary("some text " * 90), np.uint32)
    assert (out[1].root, out[1].n_chunks) == plain_root(ids, 4)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "x", "s", 0), (None, "a b", None, None, 3), (3, "a b " * 30000, "x", "s", 1), (4, "k l m", "x", "s", 1), (4, "k l m", "x", "s", 1), (4, "other", "x", "s", 1)]
    docs = spark.createDataFrame([(*r, "c", 5) for r in rows], SCHEMA + ", data string, row int")
    store = write(docs, str(tmp_path / "odd"))
    out = verify(store).collect()
    assert len(out) == 7 and all(r.verified for r in out)
    assert {r.doc_id: r.n_ids for r in out if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert len(rebuild(store).collect()) == 6
    assert verify(write(docs.limit(0), str(tmp_path / "none"))).count() == 0
