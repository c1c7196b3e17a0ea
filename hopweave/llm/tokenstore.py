"""Content-addressed store of token ids.

Texts are encoded with a public byte-level vocabulary, whose file has to lie under the same path on the
driver and every executor. A rolling hash over ``SPAN`` ids cuts each
id stream where the hash is low, between ``SHORTEST`` and ``LONGEST`` ids after the last cut, so equal
passages give equal chunks wherever they begin. Every distinct chunk is stored once under the digest
of its ids; a document is a recipe, its list of digests, under a Merkle root, and the manifest gives
every document its root. Chunks are stored as little-endian 16-bit ids (32-bit for larger vocabularies).

``verify`` holds a store against a manifest: every digest of a recipe is stored once, the stored ids
have that digest, and the recipe has its root. ``rebuild`` gives the ids back in order.

Defined results: null and empty texts and null doc_ids have an empty recipe and the root of no leaf;
repeated rows have a manifest row each, as have several texts of one doc_id; texts of any length are
encoded whole; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_text, documents, shared_dir
from .textnum import U, chunks, grams

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPAN, MASK, SHORTEST, LONGEST = 16, 127, 32, 1024
DIGEST = 16

class Encoder:
    """Ids of texts by a byte-level vocabulary file; no text is taken for a special token."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("store", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offset of every text."""
        ids = [self.coder.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in texts.to_pylist()]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(self.kind), np.r_[0, np.cumsum([len(x) for x in ids], dtype=np.int64)]


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def cuts(ids: np.ndarray, offs: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of every stream."""
    h = grams(ids.astype(U) + U(1), SPAN)
    low = np.flatnonzero((h & U(MASK)) == 0) + SPAN
    for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
        out, at = [], s
        for c in low[np.searchsorted(low, s + SPAN) : np.searchsorted(low, e)].tolist():
            while c - at > LONGEST:
                at += LONGEST
                out.append(at)
            if c - at >= SHORTEST:
                out.append(c)
                at = c
        while e - at > LONGEST:
            at += LONGEST
            out.append(at)
        if e > at:
            out.append(e)
        yield out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST, person=b"chunk").digest()


def root(digests: list[bytes]) -> bytes:
    """Merkle root; a level of odd length passes its last node on. The number of leaves is hashed in."""
    level = digests
    while len(level) > 1:
        up = [hashlib.blake2b(a + b, digest_size=DIGEST, person=b"node").digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(level) // 2 * 2 :]
    return hashlib.blake2b(b"".join(level) + len(digests).to_bytes(8, "little"), digest_size=DIGEST, person=b"root").digest()


def _encode(vocabulary: str):
    """Recipe rows (recipe set) and chunk rows (data set), told apart by what is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        seen: set[bytes] = set()
        for b in chunks(batches):
            ids, offs = enc.encode(b.column("text"))
            names, data, recipes, roots = [], [], [], []
            for s, ends in zip(offs[:-1].tolist(), cuts(ids, offs)):
                own = []
                for e in ends:
                    raw = ids[s:e].tobytes()
                    own.append(d := digest(raw))
                    if d not in seen:
                        seen.add(d)
                        names.append(d)
                        data.append(raw)
                    s = e
                recipes.append(b"".join(own))
                roots.append(root(own))
            if len(seen) > 1 << 20:
                seen.clear()
            n, m = b.num_rows, len(names)
            yield pa.record_batch(
                [pa.concat_arrays([b.column("doc_id"), pa.nulls(m, pa.int64())]), pa.array(np.r_[np.diff(offs), np.full(m, -1)]), pa.array([*recipes, *[None] * m], pa.binary()), pa.array([*roots, *names], pa.binary()), pa.array([*[None] * n, *data], pa.binary())],
                names=["doc_id", "n_ids", "recipe", "digest", "data"],
            )

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Manifest rows, and the first chunk of every digest; a partition holds all of a digest."""
    seen: set[bytes] = set()
    for b in batches:
        keep = []
        for i, (d, n) in enumerate(zip(b.column("digest").to_pylist(), b.column("n_ids").to_pylist())):
            if n < 0:
                if d in seen:
                    continue
                seen.add(d)
            keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


SCHEMA = "doc_id long, n_ids long, recipe binary, digest binary, data binary"


class Store:
    """A written store: ``chunks`` (digest, data) and ``manifest`` (doc_id, n_ids, recipe, digest). Both
    are in one table, as one pass writes them; rows of chunks have -1 ids. ``width``: bytes of an id."""

    def __init__(self, spark: SparkSession, path: str, width: int = 2):
        self.width = width
        both = spark.read.schema(SCHEMA).parquet(path)
        self.chunks = both.where("n_ids < 0").select("digest", "data")
        self.manifest = both.where("n_ids >= 0").select("doc_id", "n_ids", "recipe", "digest")


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> Store:
    """Encode and store all texts under ``path``."""
    encoded = as_text(docs, id_col, text_col).mapInArrow(_encode(vocabulary), SCHEMA)
    encoded.repartition("digest").mapInArrow(_once, SCHEMA).write.option("compression", "zstd").parquet(path)
    return Store(docs.sparkSession, path, encoder(vocabulary).kind.itemsize)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [digest(x) == d for d, x in zip(b.column("digest").to_pylist(), b.column("data").to_pylist())]
        yield pa.record_batch([b.column("digest"), pa.array(ok), pa.array([len(x) for x in b.column("data").to_pylist()])], names=["digest", "sound", "n_bytes"])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 1024):
            c = b.slice(s, 1024)
            rec = c.column("recipe").to_pylist()
            parts = [[r[i : i + DIGEST] for i in range(0, len(r), DIGEST)] for r in rec]
            rooted = [root(p) == d for p, d in zip(parts, c.column("digest").to_pylist())]
            size = [len(p) for p in parts]
            at = pa.array(np.repeat(np.arange(len(size)), size))
            yield pa.record_batch([c.column("row").take(at), pa.array([x for p in parts for x in p], pa.binary()), pa.array(np.repeat(rooted, size).astype(bool))], names=["row", "digest", "rooted"])


def verify(store: Store) -> DataFrame:
    """(doc_id, n_ids, n_chunks, root, verified) of every manifest row."""
    sound = store.chunks.mapInArrow(_check, "digest binary, sound boolean, n_bytes long").groupBy("digest").agg(F.count("*").alias("stored"), F.min("sound").alias("sound"), F.max("n_bytes").alias("n_bytes"))
    m = store.manifest.withColumn("row", F.xxhash64("doc_id", "digest"))
    leaves = m.select("row", "digest", "recipe").mapInArrow(_leaves, "row long, digest binary, rooted boolean")
    met = leaves.join(sound, "digest", "left").groupBy("row").agg(
        F.min(F.coalesce(F.col("rooted") & F.col("sound") & (F.col("stored") == 1), F.lit(False))).alias("all_sound"),
        F.sum("n_bytes").alias("n_bytes"),
        F.count("*").alias("met"),  # n_chunks times the number of equal rows
    )
    n_chunks = (F.length("recipe") / DIGEST).cast("int")
    good = F.when(n_chunks == 0, F.col("n_ids") == 0).otherwise(F.coalesce(F.col("all_sound") & (F.col("n_bytes") * n_chunks == F.col("n_ids") * store.width * F.col("met")), F.lit(False)))
    return m.join(met, "row", "left").select("doc_id", "n_ids", n_chunks.alias("n_chunks"), F.lower(F.hex("digest")).alias("root"), good.alias("verified"))


def rebuild(store: Store) -> DataFrame:
    """(doc_id, root, ids): the id stream of every distinct (doc_id, root), as little-endian bytes."""
    m = store.manifest.select("doc_id", F.col("digest").alias("root"), "recipe").distinct()
    step = F.expr(f"sequence(0, length(recipe) div {DIGEST} - 1)")
    leaves = m.where("length(recipe) > 0").select("doc_id", "root", "recipe", F.explode(step).alias("k")).select("doc_id", "root", "k", F.expr(f"substring(recipe, k * {DIGEST} + 1, {DIGEST})").alias("digest"))
    whole = leaves.join(store.chunks, "digest").groupBy("doc_id", "root").agg(F.array_sort(F.collect_list(F.struct("k", "data"))).alias("parts"))
    joined = m.select("doc_id", "root").join(whole.select(F.col("doc_id").alias("d"), F.col("root").alias("r"), "parts"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("root") == F.col("r")), "left")
    return joined.select("doc_id", "root", F.coalesce(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")), F.lit(b"")).alias("ids"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/hopweave-store-{uuid.uuid4().hex}"
    return verify(write(documents(spark, sf_dir), path))
