"""Vectorised text scanning: words and their 64-bit hashes straight from Arrow string buffers.

A word hash is the difference of two prefix sums of ``byte * BASE**i`` (mod 2**64) brought to a
common exponent, so no Python object is made per word. Equal words always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INV = U(pow(int(BASE), -1, 1 << 64))
#: Text bytes that are scanned at once; bounds memory, never what is read.
CHUNK_BYTES = 1 << 20

SPACES = bytes([9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
PUNCT = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    p, q = np.ones(n, U), np.ones(n, U)
    p[1:], q[1:] = BASE, INV
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _powers(max(16, int(n).bit_length()))
    return p[:n], q[:n]


class Words:
    """Words of an array of texts: ``doc`` (index of the text), ``hash``, ``start``/``end`` (bytes)."""

    def __init__(self, texts: pa.Array, strip_punct: bool, lower: bool):
        if lower:
            texts = pc.utf8_lower(texts)
        self.buf, self.offs = flat(texts)
        sep = np.zeros(256, bool)
        sep[list(SPACES + (PUNCT if strip_punct else b""))] = True
        n = len(self.buf)
        word = ~sep[self.buf]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = self.offs[:-1][self.offs[:-1] < n]
        first[heads] = word[heads]  # a word never crosses texts
        last = word.copy()
        if n:
            last[:-1] &= ~word[1:]
            tails = self.offs[1:]
            tails = tails[tails > 0] - 1
            last[tails] = word[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        p, q = powers(n + 1)
        acc = np.zeros(n + 1, U)
        np.cumsum((self.buf.astype(U) + U(1)) * p[:n], out=acc[1:])
        self.hash = mix((acc[self.end] - acc[self.start]) * q[self.start])
        counts = np.searchsorted(self.start, self.offs)
        self.first = counts  # index of the first word of each text, and the number of words
        self.doc = np.repeat(np.arange(len(self.offs) - 1), np.diff(counts))

    def __len__(self) -> int:
        return len(self.start)


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words between white space, of texts without nulls."""
    buf, offs = flat(texts)
    sep = np.zeros(256, bool)
    sep[list(SPACES)] = True
    gap = sep[buf]
    first = ~gap
    first[1:] &= gap[:-1]
    heads = offs[:-1][offs[:-1] < len(buf)]
    first[heads] = ~gap[heads]
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(first, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of texts without nulls."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive values; ``len(h) - n + 1`` of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    p, q = powers(len(h) + 1)
    acc = np.zeros(len(h) + 1, U)
    np.cumsum(h * p[: len(h)], out=acc[1:])
    return mix((acc[n:] - acc[:m]) * q[:m])


def sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """``op`` over all windows of ``w`` values, by doubling."""
    if len(x) < w:
        return x[:0]
    y, size = x, 1
    while size * 2 <= w:
        y = op(y[:-size], y[size:])
        size *= 2
    rest = w - size
    return op(y[: len(y) - rest], y[rest:]) if rest else y


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text (one row at least); null is ''."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(column)
        texts = pc.fill_null(batch.column(k).cast(pa.large_string()), "")
        batch = batch.set_column(k, pa.field(column, pa.large_string()), texts)
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, min(to, at + 32768) - at)
            at = min(to, at + 32768)
