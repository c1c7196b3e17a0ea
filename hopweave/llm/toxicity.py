"""Toxicity of restored text: a noisy-channel decoder, then word scores.

Channel: a writer spells a word with look-alike characters (1d10t), repeats letters (idiooot, iddiot), puts
symbols around it, or puts single letters apart (i d i o t, i-d-i-o-t). The lattice of a token holds, for
every character, the letters it may stand for at a cost, and for every run of one letter one or two of it at
a cost that grows with what is dropped. Viterbi finds the cheapest path under a character trigram model of
the corpus. A token has several readings, as words are judged later: without the symbols at its edges, and with
the inner ones of them taken for letters, as many on either side as there are ways to choose (of more than
``SPLITS`` ways: all of them, and each as a letter or as noise, as is cheapest); and if it has
letters in a row each of these as is cheapest and with all such letters double, the first also
with a credit for every letter, which keeps doubles that are usual. Plain words have one path, themselves, and skip the search. Of letters that stand apart
all stretches of 2 to ``LONGEST`` letters are words, as lone letters of the sentence may stand beside them;
runs of such letters are read whole, whatever their length and the spaces between.

Model: letter trigrams of all words of all documents, as they stand, summed by the cluster. Words: on a bounded
sample of labelled documents (``FIT_ROWS``, drawn by a hash of doc_id) every restored word gets the
lower confidence bound of its log odds for toxic against clean documents; words of few documents or
without evidence weigh nothing. A document's score is the weight of its most telling word; the threshold is
the one of best F1 on a held-out quarter of the sample, and the weights are then taken from all of it.

Defined results: null and empty texts score 0 and are not toxic; without labels of both kinds nothing
is; documents of any length are read whole; repeated rows have a row each; a labelled doc_id with several
texts counts once for each of them, and labelled both ways it counts as toxic; equal costs go to the letter
listed first; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_text, documents
from .textnum import U, Words, chunks, mix, powers

FIT_ROWS, LEAST_DOCS, Z, FLOOR = 20_000, 3, 1.5, 1.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letters a character may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "%": "x", "&": "a", "¡": "i", "®": "r", "©": "c"}
SWAP, DROP, STAR = 1.0, 0.4, 1.5
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Marks of a sentence, never letters.
_MARKS = ".,;:?\"'`()[]{}<>"
_ROW = re.compile(r"(.)\1+", re.S)
#: Letters of the longest word that is looked for in letters apart.
LONGEST = 45
NOISE, CREDIT, SPLITS = 3.0, 2.5, 16
_RUN = re.compile(r"(.)\1*", re.S)
#: Ways to read a token; LOOSE and DOUBLED may be joined.
CHEAPEST, CREDITED, LOOSE, DOUBLED = 0, 1, 2, 4
_SIZE = 28  # letters, other letters, edge


def code(c: str) -> int:
    i = ord(c) - 97
    return i if 0 <= i < 26 else 26


class Spelling:
    """Costs of letter trigrams and the decoder."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(_SIZE, _SIZE, _SIZE).astype(np.float64)
        pair, single = c.sum(axis=0), c.sum(axis=(0, 1))
        uni = (single + 1) / (single.sum() + _SIZE)
        bi = (pair + 5 * uni) / (pair.sum(axis=1, keepdims=True) + 5)
        tri = (c + 5 * bi[None]) / (c.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(tri)).tolist()
        self.known: dict[str, str] = {}

    def restore(self, token: str, how: int = CHEAPEST) -> str:
        """Cheapest spelling of a lower-case token without spaces. CREDITED: with a credit for every letter;
        LOOSE: symbols at the edges may be noise; DOUBLED: of letters in a row two are kept."""
        got = self.known.get((token, how))
        if got is None:
            if len(self.known) >= 1 << 15:
                self.known.clear()
            got = self.known[token, how] = self._decode(token, how)
        return got

    def _slots(self, token: str, how: int) -> list[list[tuple[str, float]]]:
        slots: list[list[tuple[str, float]]] = []
        inner = token.strip(_EDGE)
        first = token.index(inner) if inner else 0
        i = 0
        while i < len(token):
            c, n = token[i], 1
            while i + n < len(token) and token[i + n] == c:
                n += 1
            if c.isalpha():
                opts = [(c * k, DROP * (n - k)) for k in ((2,) if n > 1 and how & DOUBLED else (1, 2)[:n])]
            elif c in LOOKS:
                swap = STAR if c == "*" else SWAP
                opts = [(x * k, swap * n + (DROP if k < n else 0)) for x in LOOKS[c] for k in ((2,) if n > 1 and how & DOUBLED else (1, 2)[:n])]
                opts += [("", swap * 2)] if c == "*" else []
                opts += [("", NOISE)] if how & LOOSE and not first <= i < first + len(inner) else []
            else:
                opts = [("", 0.0)]
            slots.append(opts)
            i += n
        return slots

    def _decode(self, token: str, how: int) -> str:
        slots = self._slots(token, how)
        # letters without a choice cost the same on every path; only the two next to a choice count
        open_ = [i for i, x in enumerate(slots) if len(x) > 1]
        if not open_:
            return "".join(x[0][0] for x in slots)
        before = "".join(x[0][0] for x in slots[: open_[0]])
        to = open_[-1] + 1
        near = 0
        while to < len(slots) and near < 2:
            near += len(slots[to][0][0])
            to += 1
        a, b = ([27, 27] + [code(c) for c in before[-2:]])[-2:]
        paths: dict = {(a, b): (0.0, None)}
        cost, credit = self.cost, CREDIT if how == CREDITED else 0.0
        for opts in slots[open_[0] : to]:
            nxt: dict = {}
            for (a, b), (w, back) in paths.items():
                for letters, extra in opts:
                    x, y, v = a, b, w + extra
                    for ch in letters:
                        z = code(ch)
                        v += cost[x][y][z] - credit
                        x, y = y, z
                    old = nxt.get((x, y))
                    if old is None or v < old[0]:
                        nxt[x, y] = v, (letters, back)
            paths = nxt
        ends = near < 2  # the end of the word counts too
        back = min(((v + (cost[x][y][27] if ends else 0.0), p) for (x, y), (v, p) in paths.items()), key=lambda e: e[0])[1]
        out = []
        while back is not None:
            out.append(back[0])
            back = back[1]
        return before + "".join(reversed(out)) + "".join(x[0][0] for x in slots[to:])


def doubles(word: str) -> set[str]:
    """The paths of a word of letters: one or two of every run of a letter."""
    out, at = {""}, 0
    for m in _ROW.finditer(word):
        out = {x + word[at : m.start()] + m[1] * k for x in out for k in (1, 2)}
        at = m.end()
    return {x + word[at:] for x in out}


def restored(token: str, spelling: Spelling) -> set[str]:
    """All readings of a token other than itself without the symbols around it."""
    core = token.strip(_EDGE)
    if core.isalpha() and len(token.strip(_MARKS)) == len(core) and len(_ROW.findall(core)) <= 4:
        return doubles(core)
    return {spelling.restore(*r) for r in readings(token)}


def readings(token: str) -> list[tuple[str, int]]:
    """Spellings of a token that the decoder is asked for, and how."""
    t = token.strip(_MARKS)
    if not any(c.isalpha() for c in t):
        return []
    core = t.strip(_EDGE)
    ways = (CHEAPEST, DOUBLED) if _ROW.search(t) else (CHEAPEST,)
    out = []
    if len(core) > 1 and (not core.isalpha() or _ROW.search(core)):
        out += [(core, how) for how in (*ways, CREDITED)]
    if len(core) < len(t):
        first = t.index(core)
        last = first + len(core)
        starts = [m.start() for m in _RUN.finditer(t[:first])] + [first]
        ends = [last] + [last + m.end() for m in _RUN.finditer(t[last:])]
        if len(starts) * len(ends) <= SPLITS:
            out += [(t[s:e], how) for s in starts for e in ends if (s, e) != (first, last) for how in ways]
        else:
            out += [(t, how | loose) for how in ways for loose in (0, LOOSE)]
    return out


def stretches(letters: str) -> np.ndarray:
    """Hashes of all words of 2 to ``LONGEST`` letters that letters set apart may make up."""
    buf = np.frombuffer(letters.encode(), np.uint8)
    at = np.r_[np.flatnonzero((buf & 0xC0) != 0x80), len(buf)]
    p, q = powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * p[: len(buf)], out=acc[1:])
    return np.concatenate([mix((acc[at[n:]] - acc[at[:-n]]) * q[at[:-n]]) for n in range(2, min(LONGEST, len(at) - 1) + 1)] + [np.zeros(0, U)])


def _sums(flag: np.ndarray, w: Words) -> np.ndarray:
    """How many bytes of every word have the flag."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[w.end] - total[w.start]


_KINDS = np.zeros((4, 256), bool)  # symbols and digits but marks, marks, beginnings of characters, letters and digits
_KINDS[0][33:127] = True
_KINDS[0][[*range(65, 91), *range(97, 123), *map(ord, _MARKS)]] = False
_KINDS[1][list(map(ord, _MARKS))] = True
_KINDS[2][[*range(128), *range(192, 256)]] = True
_KINDS[3][[*range(48, 58), *range(65, 91), *range(97, 123), *range(192, 256)]] = True


def _suspect(w: Words, buf: np.ndarray) -> np.ndarray:
    """Words that aren't plain: a digit, a symbol or a mark inside, or two of one letter in a row."""
    marks = _KINDS[1][buf]
    twice = np.zeros(len(buf), bool)
    twice[1:] = (buf[1:] == buf[:-1]) & ~marks[1:]
    edges = marks[w.start].astype(np.int64) + (marks[w.end - 1] & (w.end - w.start > 1))
    heads = twice[w.start]  # the byte before belongs to another word
    return (_sums(_KINDS[0][buf], w) > 0) | (_sums(marks, w) > edges) | (_sums(twice, w) > heads)


def _apart(w: Words, buf: np.ndarray, raw: bytes) -> Iterator[tuple[int, str]]:
    """(doc, letters) of runs of two or more words of one letter, which may have symbols around it."""
    one = (_sums(_KINDS[2][buf] & ~_KINDS[1][buf], w) == 1) | (_sums(_KINDS[3][buf], w) == 1)
    lone = np.flatnonzero(one)
    if len(lone) < 2:
        return
    new = np.r_[True, (np.diff(lone) > 1) | (w.doc[lone[1:]] != w.doc[lone[:-1]])]
    head = np.r_[np.flatnonzero(new), len(lone)]
    for s, e in zip(head[:-1].tolist(), head[1:].tolist()):
        if e - s > 1:
            letters = []
            for x, y in zip(w.start[lone[s:e]].tolist(), w.end[lone[s:e]].tolist()):
                t = raw[x:y].decode().strip(_MARKS)
                letters.append(t.strip(_EDGE) or t)
            yield int(w.doc[lone[s]]), "".join(letters)


class Tokens:
    """Distinct restored words of every text of a chunk, as (doc, hash of the word)."""

    def __init__(self, texts: pa.Array, spelling: Spelling):
        low = pc.utf8_lower(texts)
        w = Words(low, strip_punct=True, lower=False)
        loose = Words(low, strip_punct=False, lower=False)
        self.words = w
        docs, hashes = [w.doc], [w.hash]
        at = np.flatnonzero(_suspect(loose, loose.buf))
        raw = loose.buf.tobytes()
        # every distinct token is decoded once
        _, first, token = np.unique(loose.hash[at], return_index=True, return_inverse=True)
        found: list[str] = []
        of: list[int] = []
        for i, (x, y) in enumerate(zip(loose.start[at[first]].tolist(), loose.end[at[first]].tolist())):
            for t in restored(raw[x:y].decode(), spelling):
                found.append(t)
                of.append(i)
        if found:
            more = Words(pa.array(found, pa.large_string()), strip_punct=True, lower=False)
            owner = np.array(of)[more.doc]  # ascending
            n = np.bincount(owner, minlength=len(first))
            start = np.r_[0, np.cumsum(n)]
            times = n[token]
            docs.append(np.repeat(loose.doc[at], times))
            hashes.append(more.hash[np.repeat(start[:-1][token] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())])
        for d, letters in _apart(loose, loose.buf, raw):
            for t in {letters} | {spelling.restore(letters, how) for how in ((CHEAPEST, DOUBLED, CREDITED) if _ROW.search(letters) or not letters.isalpha() else ())}:
                h = stretches(t)
                docs.append(np.full(len(h), d))
                hashes.append(h)
        doc, h = np.concatenate(docs).astype(U), np.concatenate(hashes)
        key = np.lexsort((h, doc))
        doc, h = doc[key], h[key]
        keep = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        self.doc, self.hash = doc[keep].astype(np.int64), h[keep]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter trigrams of all words; other letters than a to z are one class, other characters separate."""
    total = np.zeros(_SIZE**3, np.int64)
    kind = np.full(256, 27, np.int64)
    kind[97:123] = np.arange(26)
    kind[192:] = 26
    for b in chunks(batches):
        low = pc.utf8_lower(b.column("text"))
        buf = np.frombuffer(b"  " + Words(low, False, False).buf.tobytes() + b"  ", np.uint8)
        buf = buf[(buf < 128) | (buf >= 192)]  # the following bytes of a character add nothing
        k = kind[buf]
        ok = (k[2:] != 27) | (k[1:-1] != 27)
        first = np.where(k[1:-1] == 27, 27, k[:-2])
        total += np.bincount((first * _SIZE * _SIZE + k[1:-1] * _SIZE + k[2:])[ok], minlength=_SIZE**3)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def spelling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Spelling:
    grams = as_text(docs, id_col, text_col).select("text").mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SIZE**3, np.int64)
    for r in grams.collect():  # at most 28**3 rows
        counts[r.gram] = r.n
    return Spelling(counts)


class Scores:
    """Hashes of the words that tell, their weights, and the threshold."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, threshold: float):
        self.hashes, self.weights, self.threshold = hashes, weights, threshold

    def of(self, t: Tokens, n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, t.hash), len(self.hashes) - 1)
            hit = self.hashes[at] == t.hash
            np.maximum.at(out, t.doc[hit], self.weights[at[hit]])
        return out


def learn(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Lower confidence bounds of the log odds of words in so many documents of either kind, 0 where
    they are under ``FLOOR``."""
    p = np.log((toxic + 0.1) / (n_toxic + 0.2)) - np.log((clean + 0.1) / (n_clean + 0.2))
    spread = np.sqrt(1 / (toxic + 0.1) + 1 / (clean + 0.5))
    return np.where((toxic >= LEAST_DOCS) & (p - Z * spread >= FLOOR), p - Z * spread, 0.0)


def fit(docs: DataFrame, labels: DataFrame, sp: Spelling, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Scores:
    """Word weights and threshold from at most about ``fit_rows`` labelled documents."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    known = known.where(unit < F.lit(min(1.0, fit_rows / max(n, 1)))).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0)
    shared = docs.sparkSession.sparkContext.broadcast(sp)  # 28**3 costs

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            t = Tokens(b.column("text"), shared.value)
            cut = np.searchsorted(t.doc, np.arange(b.num_rows + 1))
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"), b.column("held"), pa.array([t.hash[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], names=["doc_id", "toxic", "held", "bag"])

    texts = as_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id")  # known has at most about fit_rows rows
    bag = texts.select("doc_id", "text", "toxic", "held").mapInArrow(bags, "doc_id long, toxic int, held boolean, bag binary")
    bag = bag.dropDuplicates(["doc_id", "bag"]).persist()
    try:
        sizes = {(r.toxic > 0, r.held): r.n for r in bag.groupBy("toxic", "held").agg(F.count("*").alias("n")).collect()}
        n_t, n_c = sizes.get((True, False), 0), sizes.get((False, False), 0)
        if not n_t or not n_c:
            return Scores(np.zeros(0, U), np.zeros(0), np.inf)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 512):
                    c = b.slice(s, 512)
                    bags_ = c.column("bag").to_pylist()
                    tox = np.repeat(c.column("toxic").to_numpy() > 0, [len(x) // 8 for x in bags_])
                    yield pa.record_batch([pa.array(np.frombuffer(b"".join(bags_), np.int64)), pa.array(tox.astype(np.int64))], names=["word", "toxic"])

        def weigh(part: DataFrame, toxic: int, clean: int) -> Scores:
            words = part.select("toxic", "bag").mapInArrow(split, "word long, toxic long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
            rows = words.where(F.col("t") >= LEAST_DOCS).toPandas()
            w = learn(rows.t.to_numpy(np.float64), rows.c.to_numpy(np.float64), toxic, clean)
            h = rows.word.to_numpy(np.int64).view(U)[w > 0]
            order = np.argsort(h)
            return Scores(h[order], w[w > 0][order], np.inf)

        scores = weigh(bag.where("NOT held"), n_t, n_c)
        table = docs.sparkSession.sparkContext.broadcast(scores)  # words of LEAST_DOCS sampled documents that tell

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = table.value
                out = []
                for x in b.column("bag").to_pylist():
                    g = np.frombuffer(x, U)
                    out.append(float(s.weights[np.isin(s.hashes, g)].max(initial=0.0)))
                yield pa.record_batch([b.column("toxic"), pa.array(out, pa.float64())], names=["toxic", "score"])

        held = bag.where("held").select("toxic", "bag").mapInArrow(score, "toxic int, score double").toPandas()
        final = weigh(bag, n_t + sizes.get((True, True), 0), n_c + sizes.get((False, True), 0))
    finally:
        bag.unpersist()
    final.threshold = threshold(held.score.to_numpy(np.float64), held.toxic.to_numpy() > 0)
    return final


def threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of best F1, midway to the next score below it."""
    best, at = 0.0, np.inf
    levels = np.unique(score[score > 0])
    for i, x in enumerate(levels):
        said = score >= x
        f1 = 2 * (said & toxic).sum() / max(1, said.sum() + toxic.sum())
        if f1 > best:
            best, at = f1, (x + (levels[i - 1] if i else 0.0)) / 2
    return float(at)


def scored(docs: DataFrame, sp: Spelling, scores: Scores, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((sp, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s, m = shared.value
            got = m.of(Tokens(b.column("text"), s), b.num_rows)
            yield pa.record_batch([b.column("doc_id"), pa.array(np.round(got, 6)), pa.array(got >= m.threshold)], names=["doc_id", "score", "toxic"])

    return as_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sp = spelling(docs)
    return scored(docs, sp, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), sp))
