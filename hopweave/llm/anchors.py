"""Anchors of word streams: content-determined positions that cut a corpus-wide suffix array into
independent parts.

Every start of a ``least``-word window owns one anchor: the first smallest hash of the word k-grams
inside the window. Equal windows own equal anchors at equal offsets, so all suffixes that share their
first ``least`` words meet at one anchor hash, whichever documents they come from.
"""

from __future__ import annotations

import numpy as np

from .textnum import U, Words, grams, mix, powers, sliding

GRAM = 8
_INDEX_BITS = 24


def owners(v: np.ndarray, span: int, bits: int = _INDEX_BITS) -> np.ndarray:
    """Index of the first smallest value (of its upper ``64 - bits`` bits) of every window of ``span`` values.

    The index stands in the lower bits, so longer arrays are taken in overlapping pieces."""
    mask = U((1 << bits) - 1)
    step, out = (1 << bits) - span, []
    for s in range(0, len(v) - span + 1, step):
        part = v[s : s + step + span - 1]
        comp = (part & ~mask) | np.arange(len(part), dtype=U)
        out.append((sliding(comp, span, np.minimum) & mask).astype(np.int64) + s)
    return np.concatenate([*out, np.zeros(0, np.int64)])


class Anchors:
    """Anchors of all texts of a chunk, in order: ``doc``, ``pos`` (index of the word in the chunk), ``key``
    (hash of the k-gram), ``low`` (first window start that owns it), ``left`` (hash of the words from
    ``low - 1`` to ``pos``, 0 where ``low`` begins its text)."""

    def __init__(self, w: Words, least: int):
        self.words = w
        span = least - GRAM + 1
        v = mix(grams(w.hash, GRAM))
        n = len(w) - least + 1
        if n <= 0:
            n = 0
            owner = np.zeros(0, np.int64)
            starts = np.zeros(0, np.int64)
        else:
            owner = owners(v, span)[:n]
            starts = np.flatnonzero(w.doc[:n] == w.doc[least - 1 :])
            owner = owner[starts]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        self.pos = owner[first]
        self.low = starts[first]
        last = np.r_[first[1:], len(owner)] - 1
        self.high = starts[last] if len(owner) else self.low
        self.key = v[self.pos] if len(first) else np.zeros(0, U)
        self.doc = w.doc[self.pos] if len(first) else np.zeros(0, np.int64)
        head = w.first[:-1][self.doc] == self.low if len(first) else np.zeros(0, bool)
        p, q = powers(len(w) + 1)
        acc = np.zeros(len(w) + 1, U)
        np.cumsum(w.hash * p[: len(w)], out=acc[1:])
        frm = np.maximum(self.low - 1, 0)
        left = mix((acc[self.pos] - acc[frm]) * q[frm]) ^ mix((self.pos - frm).astype(U))
        self.left = np.where(head, U(0), left | U(1))

    def __len__(self) -> int:
        return len(self.pos)
