"""Near-duplicate groups by DartMinHash.

A document is a weighted set: its word shingles with their counts as weights. Every element owns a
strip of the (weight, rank) plane, cut into dyadic weight regions. Hashed darts fall on a region as
a Poisson process in rank whose seed is the element and the region alone, so equal regions get equal
darts in every document. A dart counts if it lies below the document's weight of the element; each of
``k`` coordinates keeps its earliest dart. Two documents agree on a coordinate with a probability
equal to their weighted Jaccard similarity. Bands of coordinates give candidates, whole signatures
confirm them, and connected components of the confirmed pairs are the groups.

A band's bucket of up to ``HOT`` different documents is linked by one task. Larger ones are never gathered: all
members are compared with the bucket's hub, its smallest, where they lie; those unlike the hub are set against all
members in cells of ``CELL`` by ``CELL``, as many tasks as it takes, so no link of a bucket is lost.

Defined results: null or word-less texts and rows without a doc_id are in no group; repeated rows and
equal texts are one group; the smallest doc_id of a group is kept. Rows are told apart by doc_id and
text, so one doc_id may stand on several texts; of these the one of the smallest hash counts as first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import as_text, discard, documents, materialise
from .textnum import U, Words, chunks, grams, mix

K, ROWS, SHINGLE, THRESHOLD = 128, 4, 2, 0.55
HOT, CELL = 4096, 1024
GOLD = U(0x9E3779B97F4A7C15)
LOW = U((1 << 48) - 1)


def _step(n: int) -> np.uint64:
    return U(n * int(GOLD) & (1 << 64) - 1)


def _throw(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, theta: np.ndarray, k: int):
    """All darts with rank at most ``theta[doc]``: slot (doc * k + coordinate), rank, identity."""
    slots, ranks, ids = [], [], []
    level, low, width = 0, 0, 1
    live = np.arange(len(elem))
    while len(live):
        at, seed, rank, n = live, mix(elem[live] + _step(level + 1)), np.zeros(len(live)), 0
        while len(at):
            bits = mix(seed + _step(n))
            rank = rank - np.log1p(-(bits >> U(11)).astype(np.float64) * 2.0**-53) / width
            ok = rank <= theta[doc[at]]
            at, seed, rank, bits = at[ok], seed[ok], rank[ok], bits[ok]
            v = mix(bits ^ seed)
            hit = low + width * ((v & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < weight[at]
            coord = ((v >> U(32)) * U(k)) >> U(32)
            slots.append((doc[at] * k + coord.astype(np.int64))[hit])
            ranks.append(rank[hit])
            ids.append(mix(v)[hit])
            n += 1
        low, width = (1, 1) if level == 0 else (low * 2, width * 2)
        level += 1
        live = live[weight[live] > low]
    return np.concatenate(slots), np.concatenate(ranks), np.concatenate(ids)


def dart_signatures(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """DartMinHash signatures (n_docs x k, 16 bits each) of weighted sets given as triples."""
    total = np.bincount(doc, weight, n_docs)
    best = np.full(n_docs * k, np.inf)
    sig = np.zeros(n_docs * k, np.uint16)
    factor = k * (np.log(k) + 3)
    todo = total > 0
    while todo.any():
        use = todo[doc]
        slot, rank, ident = _throw(doc[use], elem[use], weight[use], factor / np.maximum(total, 1e-300), k)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        sig[slot[won]] = ident[won].astype(np.uint16)
        todo &= np.isinf(best.reshape(n_docs, k)).any(axis=1)
        factor *= 2
    return sig.reshape(n_docs, k)


def bags(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, 48-bit element, count) of the word shingles; a shorter text is one shingle."""
    w = Words(texts, strip_punct=True, lower=True)
    n = np.diff(w.first)
    g = grams(w.hash, shingle)
    ok = w.doc[: len(g)] == w.doc[shingle - 1 :][: len(g)]
    docs, elems = [w.doc[: len(g)][ok]], [g[ok]]
    for size in range(1, shingle):
        one = np.flatnonzero(n == size)
        if len(one):
            docs.append(one)
            elems.append(grams(w.hash, size)[w.first[:-1][one]])
    key = (np.concatenate(docs).astype(U) << U(48)) | (np.concatenate(elems) >> U(16))
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[at, len(key)])
    key = key[at]
    return (key >> U(48)).astype(np.int64), key & LOW, count


def _sign(k: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            doc, elem, count = bags(b.column("text"), shingle)
            sig = dart_signatures(doc, elem, count.astype(np.float64), b.num_rows, k)
            bag = np.zeros(b.num_rows, U)
            np.add.at(bag, doc, mix(elem ^ mix(count.astype(U))))
            some = np.flatnonzero(np.bincount(doc, minlength=b.num_rows))
            yield pa.record_batch(
                [*(b.column(c).take(pa.array(some)) for c in ("doc_id", "th", "node")), pa.array(bag[some].view(np.int64)), pa.array([sig[i].tobytes() for i in some], pa.binary())],
                names=["doc_id", "th", "node", "bag", "sig"],
            )

    return run


def _bands(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                c = b.slice(at, 4096)
                sig = np.frombuffer(b"".join(c.column("sig").to_pylist()), np.uint16).reshape(-1, k // rows, rows)
                key = np.zeros(sig.shape[:2], U)
                for r in range(rows):
                    key = mix(key + sig[:, :, r].astype(U) + GOLD)
                key = mix(key ^ mix(np.arange(k // rows, dtype=U))[None, :])
                ids = c.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, k // rows))], names=["key", "doc_id"])

    return run


def spans(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges that connect exactly the components of "at least ``least`` equal coordinates".

    Breadth first: each reached row is compared with the rows not reached yet, so a bucket of m
    copies costs about m comparisons, while no indirect link is missed."""
    out, left = [], np.arange(len(sig))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = (sig[left] == sig[i]).sum(axis=1) >= least
            found = left[near]
            out.extend((i, j) for j in found)
            queue.extend(found)
            left = left[~near]
    return out


def _link(k: int, threshold: float):
    least = int(np.ceil(threshold * k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(t: pa.Table) -> pa.RecordBatch:
            key = t.column("key").to_numpy()
            ids = t.column("doc_id").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), k)
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            size = np.diff(cut)
            a2 = cut[:-1][size == 2]
            ok = (sig[a2] == sig[a2 + 1]).sum(axis=1) >= least
            a, b = [ids[a2[ok]]], [ids[a2[ok] + 1]]
            for at, n in zip(cut[:-1][size > 2], size[size > 2]):
                pairs = np.array(spans(sig[at : at + n], least), np.int64).reshape(-1, 2)
                a.append(ids[at + pairs[:, 0]])
                b.append(ids[at + pairs[:, 1]])
            a, b = np.concatenate(a), np.concatenate(b)
            e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.record_batch([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            key = b.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if cut:
                held[-1] = b.slice(0, cut)
                yield edges(pa.Table.from_batches(held))
                held = [b.slice(cut)]
        if held:
            yield edges(pa.Table.from_batches(held))

    return run


def _to_hub(k: int, least: int):
    """Whether members of hot buckets are like their hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                c = b.slice(at, 4096)
                own, hub = (np.frombuffer(b"".join(c.column(x).to_pylist()), np.uint16).reshape(-1, k) for x in ("sig", "hub_sig"))
                near = (own == hub).sum(axis=1) >= least
                yield pa.record_batch([*(c.column(x) for x in ("key", "doc_id", "n", "hub")), pa.array(near), c.column("sig")], names=["key", "doc_id", "n", "hub", "near", "sig"])

    return run


def _cells(k: int, least: int):
    """Edges of the cells of hot buckets: rows unlike the hub (``far``) against each other and some of the members.
    Of members like the hub, which are linked already, one partner a row is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def edges() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids, far = t.column("doc_id").to_numpy(), t.column("far").to_numpy()
            near = t.column("near").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, k)
            open_ = np.flatnonzero(far | ~near)
            a, b = [], []
            for i, j in spans(sig[open_], least):
                a.append(ids[open_[i]])
                b.append(ids[open_[j]])
            known = np.flatnonzero(~far & near)
            for i in np.flatnonzero(far) if len(known) else ():
                like = (sig[known] == sig[i]).sum(axis=1) >= least
                if like.any():
                    a.append(ids[i])
                    b.append(ids[known[np.argmax(like)]])
            x, y = np.array(a, np.int64), np.array(b, np.int64)
            return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for b in batches:
            cell = list(zip(*(b.column(c).to_pylist() for c in ("key", "r", "s"))))
            at = 0
            for i in range(1, len(cell) + 1):
                if i == len(cell) or cell[i] != cell[at]:
                    if now is not None and cell[at] != now:
                        yield edges()
                        held = []
                    now = cell[at]
                    held.append(b.slice(at, i - at))
                    at = i
        if held:
            yield edges()

    return run


def _hot_edges(members: DataFrame, reps: DataFrame, hot: DataFrame, k: int, least: int, cell: int) -> DataFrame:
    """Edges of the buckets ``hot`` (key, n, hub) among ``members`` (key, doc_id)."""
    hubs = hot.join(reps.select(F.col("doc_id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    rows = members.join(hubs, "key").join(reps, "doc_id").select("key", "doc_id", "n", "hub", "sig", "hub_sig")
    told = materialise(rows.mapInArrow(_to_hub(k, least), "key long, doc_id long, n long, hub long, near boolean, sig binary"), "hot")
    star = told.where("near AND doc_id <> hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b"))
    many = told.where("NOT near").groupBy("key").agg(F.count("*").alias("n_far"))
    both = told.join(many, "key")
    part = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.ceil(n / cell)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(n / cell).cast("int") - 1))
    far = both.where("NOT near").select("key", part(F.col("n_far"), "r").alias("r"), every(F.col("n")).alias("s"), "doc_id", F.lit(True).alias("far"), "near", "sig")
    rest = both.select("key", every(F.col("n_far")).alias("r"), part(F.col("n"), "s").alias("s"), "doc_id", F.lit(False).alias("far"), "near", "sig")
    placed = far.unionByName(rest).repartition("key", "r", "s").sortWithinPartitions("key", "r", "s")
    return star.union(placed.mapInArrow(_cells(k, least), "a long, b long").where("a <> b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): connected components, root the smallest node, by alternating stars.

    Each round joins every edge with the smallest neighbour of its ends; rounds end when the edge
    set stays the same, after a number logarithmic in the size of the largest component."""
    now = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        down = large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        last, now = now, materialise(small.distinct(), "edges")
        discard(last)
        is_ = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(is_) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(is_)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rows: int = ROWS, shingle: int = SHINGLE, threshold: float = THRESHOLD, hot: int = HOT, cell: int = CELL
) -> DataFrame:
    """(doc_id, th, copies, group_id, keep) of the distinct rows that have a near copy: th is the hash of the
    text, copies the rows of that doc_id and text, group_id the doc_id of the row kept."""
    texts = as_text(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("th", F.xxhash64("text"))
    texts = texts.withColumn("node", F.xxhash64("doc_id", "th"))
    signed = materialise(texts.mapInArrow(_sign(k, shingle), "doc_id long, th long, node long, bag long, sig binary"), "signatures")
    exact = signed.groupBy("bag").agg(F.min("node").alias("rep"), F.count("*").alias("n"))
    reps = signed.select(F.col("node").alias("doc_id"), "sig").join(exact.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = materialise(reps, "representatives")
    banded = reps.mapInArrow(_bands(k, rows), "key long, doc_id long")
    # only the sizes of the buckets are gathered, and the smallest member
    keys = materialise(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("hub")).where("n > 1"), "buckets")
    shared = banded.join(keys.where(F.col("n") <= hot).select("key"), "key")
    rows_ = shared.join(reps, "doc_id").select("key", "doc_id", "sig").repartition("key").sortWithinPartitions("key", "doc_id")
    edges = rows_.mapInArrow(_link(k, threshold), "a long, b long")
    large = keys.where(F.col("n") > hot)
    if not large.isEmpty():
        edges = edges.union(_hot_edges(banded, reps, large, k, int(np.ceil(threshold * k)), cell))
    roots = components(edges)
    out = signed.select("doc_id", "th", "bag").join(exact, "bag").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    # a group of several bags also holds its root's own bag, which has no entry in roots
    several = roots.select(F.col("root").alias("rep")).distinct().withColumn("several", F.lit(True))
    out = out.join(several, "rep", "left").where("n > 1 OR root IS NOT NULL OR several")
    out = out.groupBy(F.coalesce("root", "rep").alias("top"), "doc_id", "th").agg(F.count("*").alias("copies"))
    out = materialise(out, "groups")
    first = out.groupBy("top").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    return out.join(first, "top").select("doc_id", "th", "copies", F.col("first.doc_id").alias("group_id"), (F.struct("doc_id", "th") == F.col("first")).alias("keep"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, rows: int = ROWS, shingle: int = SHINGLE, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, group_id, keep) of the documents that have a near copy; group_id is the doc_id kept.

    Pairs of weighted Jaccard similarity J become candidates with probability 1 - (1 - J**rows)**(k/rows)
    (0.988 at 0.6 as set) and are confirmed if signatures agree in ``threshold`` of the coordinates."""
    return near_groups(docs, id_col, text_col, k, rows, shingle, threshold).select("doc_id", "group_id", "keep").distinct()


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
