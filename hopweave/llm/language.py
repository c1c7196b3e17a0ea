"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte n-grams (1 to 4 bytes of lower-cased letters, other
characters as one separator), scaled to length one. Every language of the labelled rows gets a few
centroids by spherical k-means; a text takes the language of the centroid of largest cosine.

Rejection is by distance: a text whose best cosine is below the floor of its language and length gets no
language. Short texts are naturally farther from every centroid, so floors are learned per power of two of
n-grams, from texts that the centroids were not fitted on and from their first 1 to 256 words, so
that short lengths are seen as well: the ``REJECT`` quantile of cosines over the median cosine of
the length, and ``SLACK`` of that. Document frequencies and their count cover all documents; centroids and floors are fitted on
about ``FIT_ROWS`` labelled documents per language, drawn by a hash of doc_id.

Defined results: null, empty and letterless texts are rejected with cosine 0; rows keep their order of
columns and their number, repeated rows included; texts of any length count whole; ties between languages
go to the first in alphabetical order; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_text, documents, materialise
from .textnum import CHUNK_BYTES, chunks, flat

DIM_BITS = 12
DIM = 1 << DIM_BITS
SIZES = (1, 2, 3, 4)
CENTROIDS, FIT_ROWS, REJECT, SLACK = 4, 2000, 0.005, 0.95
#: Rows that a quantile and a median are taken from at least; fewer are pooled with neighbouring lengths, or all languages.
POOL, SEEN = 100, 5
LENGTHS = 24
SPARSE = ["slots", "n", "short_slots", "short_n"]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def counts(texts: pa.Array) -> np.ndarray:
    """Counts (texts x DIM) of the hashed n-grams; runs of other than letters count as one separator."""
    buf, offs = flat(pc.utf8_lower(texts))
    doc = np.repeat(np.arange(len(texts)), np.diff(offs))
    letter = _LETTER[buf]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, buf, 32).astype(np.uint32)[keep]
    doc = doc[keep]
    out = np.zeros(len(texts) * DIM, np.float32)
    h = np.zeros(len(code), np.uint32)
    base = doc * DIM
    for n in range(1, max(SIZES) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(257) + code[n - 1 :]
        ok = doc[:m] == doc[n - 1 :]
        slot = base[:m] + ((h * np.uint32(2654435761) + np.uint32(n * 0x1F123BB5 & 0xFFFFFFFF)) >> np.uint32(32 - DIM_BITS))
        out += np.bincount(slot[ok], minlength=len(out))[: len(out)].astype(np.float32)
    return out.reshape(len(texts), DIM)


def vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def lengths(c: np.ndarray) -> np.ndarray:
    """Power of two of the number of n-grams."""
    return np.minimum(np.log2(np.maximum(c.sum(axis=1), 1)).astype(np.int64), LENGTHS - 1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, limit=CHUNK_BYTES // 2):
        for at in range(0, b.num_rows, 256):
            yield b.slice(at, 256)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for b in _pieces(batches):
        df += (counts(b.column("text")) > 0).sum(axis=0)
        n += b.num_rows
    slots = np.r_[np.flatnonzero(df), -1]
    yield pa.record_batch([pa.array(slots), pa.array(np.r_[df[df > 0], n])], names=["slot", "n"])


def spherical(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a spherical k-means started from farthest points."""
    at = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[at[0]]
    while len(at) < min(k, len(x)):
        at.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        s = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
    return c


class Model:
    """Centroids of all languages, the idf of every slot, and the floors (languages x lengths)."""

    def __init__(self, langs: list[str], owner: np.ndarray, centroids: np.ndarray, idf: np.ndarray, floor: np.ndarray):
        self.langs, self.owner, self.centroids, self.idf, self.floor = langs, owner, centroids, idf, floor

    def best(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and cosine, of every row of counts."""
        cos = vectors(c, self.idf) @ self.centroids.T
        by = np.stack([cos[:, self.owner == i].max(axis=1) for i in range(len(self.langs))], axis=1)
        own = np.argmax(by, axis=1)
        return own, by[np.arange(len(own)), own]


def _middles(cos: np.ndarray, length: np.ndarray) -> np.ndarray | None:
    """Median of every length, between those of lengths seen often enough on a line."""
    at = np.flatnonzero(np.bincount(length, minlength=LENGTHS) >= SEEN)
    if not len(at):
        return None
    return np.interp(np.arange(LENGTHS), at, [np.median(cos[length == i]) for i in at])


def _floors(own: np.ndarray, cos: np.ndarray, length: np.ndarray, n_langs: int) -> np.ndarray:
    """Floor of every language and length from the best cosines of held-out rows."""
    every = _middles(cos, length)
    if every is None:
        every = np.full(LENGTHS, np.median(cos))
    middle = [_middles(cos[own == i], length[own == i]) for i in range(n_langs)]
    middle = np.stack([every if m is None else m for m in middle])
    ratio = cos / np.maximum(middle[own, length], 1e-6)
    out = np.zeros((n_langs, LENGTHS))
    for i in range(n_langs):
        use = own == i if (own == i).sum() >= POOL else np.ones(len(own), bool)
        r, n = ratio[use], length[use]
        for j in range(LENGTHS):
            away = np.abs(n - j)
            reach = np.sort(away)[min(POOL, len(away)) - 1]
            out[i, j] = np.quantile(r[away <= reach], REJECT) * middle[i, j]
    return np.maximum(SLACK * out, 1e-5)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model | None:
    """The model, or None where no row is labelled."""
    texts = as_text(docs, id_col, text_col)
    rows = texts.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DIM)
    df[rows.slot[rows.slot >= 0]] = rows.n[rows.slot >= 0]
    total = int(rows.n[rows.slot == -1].sum())
    idf = (np.log((1 + total) / (1 + df)) + 0.05).astype(np.float32)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    named = named.where("doc_id IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, float(min(1.0, fit_rows / n)))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = named.where(unit <= share[F.col("lang")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            c = counts(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            words = [1 << (d * 0x9E3779B97F4A7C15 >> 32) % 9 for d in ids]
            short = counts(pa.array([" ".join((t or "").split(None, n)[:n]) for t, n in zip(b.column("text").to_pylist(), words)], pa.large_string()))
            for i, (lang, doc) in enumerate(zip(b.column("lang").to_pylist(), ids)):
                at, few = np.flatnonzero(c[i]), np.flatnonzero(short[i])
                if len(at):
                    cols = [x for v, k in ((c[i], at), (short[i], few)) for x in (k.astype(np.uint16).tobytes(), v[k].astype(np.uint32).tobytes())]
                    yield pa.record_batch([pa.array([lang]), pa.array([doc]), *[pa.array([x]) for x in cols]], names=["lang", "doc_id", *SPARSE])

    got = materialise(sample.mapInArrow(features, "lang string, doc_id long, slots binary, n binary, short_slots binary, short_n binary"), "language")
    # one language at a time: about fit_rows sparse rows on the driver
    each = ((lang, got.where(F.col("lang") == lang).select("doc_id", *SPARSE).orderBy("doc_id", *SPARSE).toArrow()) for lang in sorted(sizes))
    return train(each, idf, centroids)


def _dense(rows: pa.Table, slots: str, n: str) -> np.ndarray:
    c = np.zeros((rows.num_rows, DIM), np.float32)
    for j, (s, k) in enumerate(zip(rows.column(slots), rows.column(n))):
        c[j, np.frombuffer(s.as_py(), np.uint16)] = np.frombuffer(k.as_py(), np.uint32)
    return c


def train(each: Iterator[tuple[str, pa.Table]], idf: np.ndarray, centroids: int) -> Model | None:
    """Centroids from three quarters of the rows of every language, floors from the others."""
    langs, owner, cents, held = [], [], [], []
    for lang, rows in each:
        if not rows.num_rows:
            continue
        c = _dense(rows, "slots", "n")
        test = np.arange(len(c)) % 4 == 3
        seen = test if test.any() else ~test
        short = _dense(rows.filter(pa.array(seen)), "short_slots", "short_n")
        held += [c[seen], short[short.any(axis=1)]]
        c = c[~test] if (~test).any() else c
        np.log1p(c, out=c)
        c *= idf
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        cents.append(spherical(c, centroids))
        owner += [len(langs)] * len(cents[-1])
        langs.append(lang)
    if not langs:
        return None
    model = Model(langs, np.array(owner), np.concatenate(cents).astype(np.float32), idf, np.zeros((len(langs), LENGTHS)))
    parts = [x[at : at + 256] for x in held for at in range(0, len(x), 256)]
    own, cos = (np.concatenate(x) for x in zip(*[model.best(x) for x in parts]))
    model.floor = _floors(own, cos, np.concatenate([lengths(x) for x in parts]), len(langs))
    return model


def language(docs: DataFrame, model: Model | None, text: str = "text"):
    """Column struct<language, cosine, rejected> of a text column."""
    if model is None:
        return F.struct(F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("cosine"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids a language and two vectors: its size doesn't depend on the rows

    @F.arrow_udf("language string, cosine double, rejected boolean")
    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        langs, coss, bads = [], [], []
        for b in _pieces([pa.record_batch([texts], names=["text"])]):
            c = counts(b.column("text"))
            own, cos = m.best(c)
            some = c.sum(axis=1) > 0
            cos = np.where(some, cos, 0.0)
            bad = ~some | (cos < m.floor[own, lengths(c)])
            langs += [None if x else m.langs[i] for i, x in zip(own, bad)]
            coss.append(np.round(cos.astype(np.float64), 6))
            bads.append(bad)
        cols = [pa.array(langs, pa.string()), pa.array(np.concatenate([*coss, np.zeros(0)])), pa.array(np.concatenate([*bads, np.zeros(0, bool)]))]
        return pa.StructArray.from_arrays(cols, names=["language", "cosine", "rejected"])

    # taken for nondeterministic so that a filter on the result doesn't run it a second time
    return run.asNondeterministic()(F.col(f"`{text}`").cast("string"))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, cosine, rejected) of every row."""
    src = as_text(docs, id_col, text_col)
    return src.select("doc_id", language(docs, model).alias("r")).select("doc_id", "r.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
