"""Maximal repeats of word sequences across all documents: a common-prefix interval tree in parts.

Suffixes are sorted in independent parts of one corpus-wide suffix array: all suffixes that share
their first ``least`` words have the same anchor (see ``anchors``), so one task that holds the
occurrences of an anchor holds every interval of the array that is ``least`` words deep or more there.
Per part the suffixes are sorted, a stack scan over the common-prefix lengths finds the intervals of
the tree, and an interval is a maximal repeat if the words left of its suffixes differ (the beginning
of a text differs from everything). Each repeat is given with all its occurrences.

Only anchors that occur twice are kept, and anchors whose occurrences all continue alike to the left
are left out, as no maximal repeat begins there. Anchors that occur together are sent to the same
cell, so a repeated stretch of text is shipped about once, not once an anchor.

Words are lower-cased, without ASCII punctuation. Defined results: null and empty texts and rows
without a doc_id have no repeats; rows repeated with the same doc_id and text count once, and one doc_id may
stand on several texts; texts of any length are scanned whole; equal texts of ``least`` words or more are
one repeat of their whole length; suffixes alike to the end stand in any order; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Anchors
from .shared import as_text, documents, fresh, materialise
from .textnum import U, Words, chunks, mix

LEAST = 50
#: Words of the suffixes of an anchor up to which they are copied to be sorted.
COPIED = 1 << 23
NAMES = ["tree_id", "n_words", "nth", "doc_id", "start", "repeats"]
SCHEMA = "tree_id long, n_words int, nth int, doc_id long, start int, repeats array<struct<last:int,n_words:int>>"
FLAG = np.dtype([("i", "<i4"), ("div", "?"), ("owner", "<i8")])
MARK = np.dtype([("key", "<u8"), ("pos", "<i4"), ("low", "<i4"), ("high", "<i4"), ("head", "?")])


def _scan(least: int):
    """One row per anchor: its hash, where it is, the hash left of it, and the label of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            a = Anchors(Words(b.column("text"), strip_punct=True, lower=True), least)
            if not len(a):
                continue
            label = np.full(b.num_rows, ~U(0))
            np.minimum.at(label, a.doc, mix(a.key))
            cut = np.searchsorted(a.doc, np.arange(b.num_rows + 1))
            nth = np.arange(len(a)) - cut[:-1][a.doc]
            at = pa.array(a.doc)
            yield pa.record_batch(
                [pa.array(a.key.view(np.int64)), b.column("doc_id").take(at), b.column("th").take(at), pa.array(nth.astype(np.int32)), pa.array(a.left.view(np.int64)), pa.array((label[a.doc] >> U(1)).view(np.int64))],
                names=["key", "doc_id", "th", "i", "lefts", "label"],
            )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that occur more than once, whether they are to be scanned, and their cell. A partition
    holds all rows of its anchors."""
    t = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if t is None:
        return
    key = t.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[head, len(k)])
    left, label = t.column("lefts").to_numpy()[order], t.column("label").to_numpy()[order]
    div = (np.minimum.reduceat(left, head) != np.maximum.reduceat(left, head)) | (np.logical_or.reduceat(left == 0, head))
    owner = np.minimum.reduceat(label, head)
    keep = np.repeat(size > 1, size)
    at = pa.array(order[keep])
    rows = t.select(["doc_id", "th", "i"]).take(at).combine_chunks()
    out = rows.append_column("div", pa.array(np.repeat(div, size)[keep])).append_column("owner", pa.array(np.repeat(owner, size)[keep]))
    yield from out.to_batches(max_chunksize=1 << 16)


def _regions(least: int):
    """Stretches of repeated text with the anchors to be scanned in them, one row per cell that owns some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            w = Words(b.column("text"), strip_punct=True, lower=True)
            a = Anchors(w, least)
            cut = np.searchsorted(a.doc, np.arange(b.num_rows + 1))
            code = (w.hash >> U(32)).astype(">u4")
            rows: list[tuple] = []
            for d, (doc, th, flags) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("flags").to_pylist())):
                own = np.array([(f["i"], f["div"], f["owner"]) for f in flags], FLAG)
                own = own[np.unique(own["i"], return_index=True)[1]]
                lo, hi = cut[d], cut[d + 1]
                base, end = w.first[d], w.first[d + 1]
                single = np.ones(hi - lo, bool)
                single[own["i"]] = False
                # words from an anchor on can repeat up to the last but one of the next window found once
                stops = np.append(np.where(single, a.low[lo:hi] + least - 1, end), end)
                after = np.append(np.where(single, np.arange(hi - lo), hi - lo), hi - lo)
                nxt = np.minimum.accumulate(after[::-1])[::-1]
                own = own[own["div"]]
                if not len(own):
                    continue
                stop = stops[nxt[own["i"]]]
                which = own["owner"]
                for o in np.unique(which):
                    for s in np.unique(stop[which == o]):
                        i = own["i"][(which == o) & (stop == s)] + lo
                        start = max(base, int(a.low[i[0]]) - 1)
                        m = np.zeros(len(i), MARK)
                        m["key"], m["pos"], m["low"], m["high"] = a.key[i], a.pos[i] - start, a.low[i] - start, a.high[i] - start
                        m["head"] = a.low[i] == base
                        rows.append((int(o), doc, th, int(start - base), code[start:s].tobytes(), m.tobytes()))
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["owner", "doc_id", "th", "start", "words", "marks"])

    return run


def _common(a: bytes, b: bytes) -> int:
    """Words that two word strings begin with alike."""
    n = min(len(a), len(b)) // 4
    if a[: n * 4] == b[: n * 4]:
        return n
    x, y = np.frombuffer(a, np.uint32, n), np.frombuffer(b, np.uint32, n)
    return int(np.argmax(x != y))


def intervals(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of the prefix intervals of depth ``least`` or more whose left words differ,
    inner ones first. ``lcp[i]`` is between suffixes i-1 and i; negative left words differ from all."""
    stack: list[list] = []  # [depth, first, left word or None if they differ]

    def one(i: int):
        return None if left[i] < 0 else left[i]

    n = len(left)
    for i in range(1, n + 1):
        h = lcp[i] if i < n else 0
        start, word, single = i - 1, one(i - 1), True
        while stack and stack[-1][0] > h:
            d, first, held = stack.pop()
            held = held if held == word else None
            if held is None:
                yield first, i - 1, d
            start, word, single = first, held, False
        if h >= least:
            if stack and stack[-1][0] == h:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == word and word is not None else None
            else:
                stack.append([h, start, word])
        elif not single:
            stack.clear()


def _sorted(texts: list[bytes], r: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at word ``pos[i]`` of text ``r[i]``, and the words that each shares
    with the one before it."""
    m = len(r)
    lcp = np.zeros(m, np.int64)
    size = np.array([len(t) // 4 for t in texts])
    if int((size[r] - pos).sum()) <= COPIED:
        rights = [texts[i][p * 4 :] for i, p in zip(r.tolist(), pos.tolist())]
        order = np.array(sorted(range(m), key=rights.__getitem__))
        for j in range(1, m):
            lcp[j] = _common(rights[order[j - 1]], rights[order[j]])
        return order, lcp
    # suffixes of few long texts: ranks by doubling, as copies of them would be quadratic
    used, own = np.unique(r, return_inverse=True)
    size = size[used]
    first = np.r_[0, np.cumsum(size + 1)]
    end = np.repeat(first[1:] - 1, size + 1)  # where a text has ended its rank is 0
    live = np.arange(len(end)) < end
    now = np.zeros(len(end), np.int64)
    now[live] = np.unique(np.concatenate([np.frombuffer(texts[i], ">u4") for i in used]), return_inverse=True)[1] + 1
    ranks = [now.astype(np.int32)]
    while (1 << len(ranks) - 1) < size.max():
        after = np.minimum(np.arange(len(end)) + (1 << len(ranks) - 1), end)
        now = np.unique(now * (len(end) + 1) + now[after], return_inverse=True)[1]
        ranks.append(now.astype(np.int32))
    at, stop = first[own] + pos, end[first[own]]
    order = np.argsort(now[at], kind="stable")
    x, y, a, b = at[order[:-1]], at[order[1:]], stop[order[:-1]], stop[order[1:]]
    n = np.zeros(m - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        n += np.where(ranks[k][np.minimum(x + n, a)] == ranks[k][np.minimum(y + n, b)], 1 << k, 0)
    lcp[1:] = np.minimum(n, np.minimum(a - x, b - y))
    return order, lcp


def part(order: np.ndarray, lcp: np.ndarray, lefts: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, list]]:
    """Maximal repeats that begin up to ``high`` words left of the occurrences of one anchor.

    ``order`` and ``lcp`` are those of the suffixes from the anchor on; ``lefts[i, j]``: word j+1 places left
    of occurrence i, negative at the beginning of its text. Yields (offset, members, [(first, last,
    depth), ...]) of every tree, members in suffix order and the root last."""
    m = len(order)
    lefts, low, high = lefts[order], low[order], high[order]
    todo = [(0, np.arange(m))]
    while todo:
        o, c = todo.pop()
        c = c[high[c] >= o]
        if len(c) < 2:
            continue
        same = (lefts[c, o:] == lefts[c[0], o:]).all(axis=0) & (lefts[c[0], o:] >= 0)
        skip = int(np.argmin(same)) if not same.all() else len(same)
        if skip:
            if o + skip < lefts.shape[1]:
                todo.append((o + skip, c))
            continue
        word = lefts[c, o]
        ok = low[c] <= o
        v = c[ok]
        if len(v) > 1:
            depth = np.zeros(len(v), np.int64)
            depth[1:] = np.minimum.reduceat(lcp[: v[-1] + 1], v[:-1] + 1)
            depth += o
            # runs of suffixes that share ``least`` words
            near = np.flatnonzero(np.r_[True, depth[1:] < least, True])
            for s, e in zip(near[:-1], near[1:]):
                if e - s < 2:
                    continue
                x = word[ok][s:e]
                if x[0] >= 0 and (x == x[0]).all():
                    continue
                if e - s == 2:
                    found = [(0, 1, int(depth[s + 1]))]
                else:
                    found = list(intervals(depth[s:e].tolist(), x.tolist(), least))
                yield o, order[v[s:e]], found
        by = np.argsort(word, kind="stable")
        ws = word[by]
        head = np.flatnonzero(np.r_[True, ws[1:] != ws[:-1]])
        for s, e in zip(head, np.r_[head[1:], len(ws)]):
            if e - s > 1 and ws[s] >= 0 and o + 1 < lefts.shape[1]:
                todo.append((o + 1, np.sort(c[by[s:e]])))


def _cell(rows: list[tuple], least: int, hashes: bool = False) -> Iterator[tuple]:
    """(anchor key, offset, doc_ids, starts, intervals) of one cell, and the hashes of the texts if asked for."""
    marks = [np.frombuffer(r[4], MARK) for r in rows]
    src = np.repeat(np.arange(len(rows)), [len(m) for m in marks])
    m = np.concatenate(marks)
    order = np.lexsort((src, m["key"]))
    key = m["key"][order]
    head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    texts = [r[3] for r in rows]
    docs = np.array([r[0] for r in rows], np.int64)
    ths = np.array([r[1] for r in rows], np.int64)
    starts = np.array([r[2] for r in rows], np.int64)
    for s, e in zip(head, np.r_[head[1:], len(key)]):
        if e - s < 2:
            continue
        at = order[s:e]
        r, mk = src[at], m[at]
        n = e - s
        suffixes = _sorted(texts, r, mk["pos"].astype(np.int64))
        high = (mk["pos"] - mk["low"]).astype(np.int64)
        width = int(high.max()) + 1
        lefts = np.empty((n, width), np.int64)
        lefts[:] = -1 - np.arange(n)[:, None]
        for j, (i, p, h, hd) in enumerate(zip(r.tolist(), mk["pos"].tolist(), high.tolist(), mk["head"].tolist())):
            q = h if hd else h + 1
            if q:
                lefts[j, :q] = np.frombuffer(rows[i][3], ">u4", q, (p - q) * 4)[::-1]
        low = (mk["pos"] - mk["high"]).astype(np.int64)
        where = starts[r] + mk["pos"]
        for o, members, found in part(*suffixes, lefts, low, high, least):
            yield int(key[s]), o, docs[r[members]], where[members] - o, found, *([ths[r[members]]] if hashes else [])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one cell after the other, each distinct row once; one row may hold all occurrences of an anchor."""
    now, held, seen = None, [], set()

    def several() -> bool:
        return sum(len(row[4]) for row in held) > MARK.itemsize

    for b in batches:
        for o, *row in zip(*[c.to_pylist() for c in b.columns]):
            if o != now:
                if several():
                    yield held
                now, held, seen = o, [], set()
            k = (row[0], row[1], row[2], row[4])
            if k not in seen:
                seen.add(k)
                held.append(row)
    if several():
        yield held


def _groups(least: int):
    """Rows of the trees: an occurrence each, with the repeats whose occurrences begin with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, docs, starts, found = zip(*trees)
            size = np.array([len(x) for x in docs])
            base = np.r_[0, np.cumsum(size)]
            every = np.concatenate([np.c_[t[:, 0] + b, t[:, 1:]] for t, b in zip(found, base)])
            every = every[np.argsort(every[:, 0], kind="stable")]
            offs = np.searchsorted(every[:, 0], np.arange(base[-1] + 1)).astype(np.int32)
            inner = pa.StructArray.from_arrays([pa.array(every[:, 1].astype(np.int32)), pa.array(every[:, 2].astype(np.int32))], names=["last", "n_words"])
            cols = [np.repeat(np.array(ids, np.int64), size), np.repeat(np.array([int(t[-1, 2]) for t in found], np.int32), size), (np.arange(base[-1]) - np.repeat(base[:-1], size)).astype(np.int32), np.concatenate(docs), np.concatenate(starts).astype(np.int32)]
            return pa.record_batch([*(pa.array(c) for c in cols), pa.ListArray.from_arrays(pa.array(offs), inner)], names=NAMES)

        size = 0
        for cell in _cells(batches):
            for key, o, docs, where, found in _cell(cell, least):
                t = np.array(found, np.int64)
                seed = key ^ (o * 0x9E3779B97F4A7C15) ^ (int(docs.min()) << 20) ^ int(where[0]) ^ (len(docs) << 44) ^ (int(t[-1, 2]) << 52)
                trees.append((int(mix(np.array([seed & (2**64 - 1)], U)).view(np.int64)[0]), docs, where, t))
                size += len(docs)
                if size > 1 << 16:
                    yield flush()
                    trees, size = [], 0
        if trees:
            yield flush()

    return run


def _cuts(least: int):
    """Per occurrence that isn't the first of its repeat, the longest such repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            out: list[np.ndarray] = []
            for _, _, docs, where, found, th in _cell(cell, least, True):
                done = np.zeros(len(docs), bool)
                rank = np.empty(len(docs), np.int64)
                rank[np.lexsort((where, docs))] = np.arange(len(docs))
                for f, g, d in found:  # inner intervals first
                    s = f + np.flatnonzero(~done[f : g + 1])
                    s = s[s != f + np.argmin(rank[f : g + 1])]
                    if len(s):
                        done[s] = True
                        out.append(np.stack([docs[s], th[s], where[s], np.full(len(s), d)], axis=1))
            if out:
                x = np.concatenate(out)
                yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int32)), pa.array(x[:, 3].astype(np.int32))], names=["doc_id", "th", "start", "n_words"])

    return run


def cells(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    texts = as_text(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("th", F.xxhash64("text"))
    scanned = texts.mapInArrow(_scan(least), "key long, doc_id long, th long, i int, lefts long, label long")
    flags = scanned.repartition("key").mapInArrow(_repeated, "doc_id long, th long, i int, div boolean, owner long")
    flags = materialise(flags, "anchors")
    lists = flags.groupBy("doc_id", "th").agg(F.collect_list(F.struct("i", "div", "owner")).alias("flags")).where(F.exists("flags", lambda f: f["div"]))
    joined = texts.join(lists.hint("shuffle_hash"), ["doc_id", "th"])
    regions = joined.mapInArrow(_regions(least), "owner long, doc_id long, th long, start int, words binary, marks binary")
    return regions.repartition("owner").sortWithinPartitions("owner")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Every maximal repeat of ``least`` words or more with all its occurrences, a row per occurrence of a tree.

    (tree_id, n_words, nth, doc_id, start, repeats): all rows of a tree share ``n_words`` words from word
    ``start`` (from 0) of ``doc_id`` on, ``nth`` numbers them in suffix order. An entry of ``repeats`` is a repeat
    of its ``n_words`` words that occurs at the rows ``nth`` to ``last`` of the tree. A tree of m occurrences
    holds up to m - 1 nested repeats, so there are as many rows as occurrences, not as many as their sum
    over all repeats; ``occurrences`` writes them out."""
    return cells(docs, id_col, text_col, least).mapInArrow(_groups(least), SCHEMA)


def occurrences(trees: DataFrame) -> DataFrame:
    """(tree_id, first, last, n_words, doc_id, start) of every occurrence of every repeat of ``trees``, which is
    told by its tree and the ``first`` and ``last`` of its rows."""
    each = trees.select(F.col("tree_id").alias("t"), F.col("nth").alias("first"), F.explode("repeats").alias("r")).select("t", "first", "r.*")
    rows = trees.select("tree_id", "nth", "doc_id", "start")
    met = each.join(rows, (F.col("t") == F.col("tree_id")) & F.col("nth").between(F.col("first"), F.col("last")))
    return met.select("tree_id", "first", "last", "n_words", "doc_id", "start")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans; the separators after a removed word go with it."""
    for b in chunks(batches):
        w = Words(b.column("text"), strip_punct=True, lower=False)
        texts = b.column("text").to_pylist()
        out = []
        for d, (text, spans) in enumerate(zip(texts, b.column("spans").to_pylist())):
            base, end = int(w.first[d]), int(w.first[d + 1])
            gone = np.zeros(end - base + 1, np.int64)
            for x in spans:
                gone[x["start"]] += 1
                gone[min(x["start"] + x["n_words"], end - base)] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            raw, off = text.encode(), int(w.offs[d])
            edge = np.r_[w.start[base:end] - off, len(raw)]
            edge[0] = 0
            cut = np.flatnonzero(np.r_[True, keep[1:] != keep[:-1], True])
            out.append(b"".join(raw[edge[s] : edge[e]] for s, e in zip(cut[:-1], cut[1:]) if keep[s]).decode())
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.large_string())).select(["doc_id", "th", "text"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with each maximal repeat left only at its first occurrence (by doc_id, then position).

    Only texts with something to remove change; those of which no word is left go."""
    spans = cells(docs, id_col, text_col, least).mapInArrow(_cuts(least), "doc_id long, th long, start int, n_words int")
    spans = materialise(spans, "spans").groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n_words")).alias("spans"))
    keyed = as_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    texts = keyed.where("doc_id IS NOT NULL AND text IS NOT NULL").join(spans.hint("shuffle_hash"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    changed = materialise(texts.mapInArrow(_remove, "doc_id long, th long, text string"), "cut")
    own, th, new = fresh(docs, "__id", "__th", "__text")
    changed = changed.toDF(own, th, new)
    c, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    joined = docs.join(changed.hint("shuffle_hash"), (c.cast("long") == F.col(own)) & (F.xxhash64(t.cast("string")) == F.col(th)), "left")
    kept = joined.where(F.col(new).isNull() | (F.length(F.trim(new)) > 0))
    return kept.select(*[F.coalesce(new, t.cast("string")).alias(text_col) if x == text_col else F.col(f"`{x}`") for x in docs.columns])


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats(documents(spark, sf_dir))
