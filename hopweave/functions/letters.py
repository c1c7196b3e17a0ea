"""Letter pairs of texts, over the bytes of whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are worked on at a time, as far as texts aren't longer.
PIECE = 1 << 20


def _parities(data: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Bits of the texts that end at ``ends`` of ``data``."""
    k = np.full(len(data), size * size, np.uint8)
    k[:-1] = first[data[:-1]] + second[data[1:]]
    k[ends[ends > 0] - 1] = size * size  # a pair isn't of two texts
    at = np.flatnonzero(k < size * size)
    v = k[at]
    # of a letter in a row every second pair overlaps with one that counts
    again = np.flatnonzero((v[1:] == v[:-1]) & (at[1:] == at[:-1] + 1)) + 1
    if len(again):
        starts = np.diff(again, prepend=-1) != 1
        run = np.arange(len(again)) - np.maximum.accumulate(np.where(starts, np.arange(len(again)), 0))
        counts = np.ones(len(at), bool)
        counts[again[run % 2 == 0]] = False
        at, v = at[counts], v[counts]
    odd = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.uint64(1) << v.astype(np.uint64))])
    upto = odd[np.searchsorted(at, ends)]
    return upto ^ np.concatenate([np.zeros(1, np.uint64), upto[:-1]])


def parities(texts: pa.Array, letters: str) -> pa.Array:
    """Signed 64-bit numbers of texts: bit ``i * len(letters) + j`` is whether the letters i and j, of at most eight
    ASCII ones, stand side by side an odd number of times, as ``replace`` finds them. Null for null."""
    size, n = len(letters), len(texts)
    first, second = np.full(256, size * size, np.uint8), np.full(256, size * size, np.uint8)
    for i, x in enumerate(letters):
        first[ord(x)], second[ord(x)] = i * size, i
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    out, i = np.zeros(n, np.uint64), 0
    while i < n:
        to = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        if at[to] > at[i]:
            out[i:to] = _parities(held[at[i] : at[to]], at[i + 1 : to + 1] - at[i], first, second, size)
        i = to
    return pa.array(out.view(np.int64), pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def pair_bits(text: Column, letters: str) -> Column:
    """``parities`` of a column."""

    @F.arrow_udf("long")
    def run(x: pa.Array) -> pa.Array:
        return parities(x, letters)

    return run(text)
