"""Related-document packing: windows are filled along greedy paths through a nearest-neighbour graph.

Sketch: one-permutation MinHash of the word pairs of every text, ``BINS`` values, empty bins filled
from others by a fixed sequence of draws. Graph: in each of ``TREES`` trees documents are sorted by
their sketch from another bin on; those that agree longest stand next to each other, so every document
is compared with the ``REACH`` next ones of its bucket (equal first bin), so a bucket of any size costs
its length. The search is approximate; its recall against brute force is tested. Edges join a document
to its ``NEAREST`` most similar ones found of at least ``LEAST`` estimated Jaccard similarity.

Components of more than ``MOST`` documents are cut: their weakest edges go first, by ``CUTS``, and what is still
too large then, documents with like sketches, is divided by hash. Path: in every component the walk begins at an unvisited document of lowest degree and goes
to the most similar unvisited neighbour until there is none; then it begins anew. Paths follow each
other in streams (as many as the corpus needs) that are cut into windows of ``window`` words; texts go
on in the next window where one ends, and only the last window of a stream isn't full.

Defined results: texts without words have no piece; null text counts as empty; rows with null doc_id
are packed with a null doc_id; repeated rows are packed once each, in different streams where there
are several, so copies of a text meet as rarely as chance has it; texts of any length are read whole; one
doc_id may stand on several texts; ties go to the smaller node hash; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .near_dup import components
from .shared import as_text, documents, materialise
from .textnum import U, Words, chunks, grams, mix, word_counts

BINS, TREES, REACH, NEAREST, LEAST = 64, 16, 3, 6, 0.2
WINDOW, PER_STREAM = 2048, 128
MOST, CUTS = 4096, (20, 32, 48, 64)


def sketches(texts: pa.Array, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(number of texts x bins) 32-bit values, and whether the text has any word."""
    w = Words(texts, strip_punct=True, lower=True)
    n = len(texts)
    g = grams(w.hash, 2)
    pair = w.doc[: len(g)] == w.doc[1:]
    lone = np.flatnonzero(np.diff(w.first) == 1)
    doc = np.r_[w.doc[: len(g)][pair], lone]
    h = mix(np.r_[g[pair], w.hash[w.first[:-1][lone]]])
    out = np.full(n * bins, ~U(0))
    np.minimum.at(out, doc * bins + (h >> U(58 if bins == 64 else 64 - (bins - 1).bit_length())).astype(np.int64), mix(h))
    out = out.reshape(n, bins)
    full = out != ~U(0)
    some = full.any(axis=1)
    sure, at = out.copy(), np.arange(bins)
    for attempt in range(1, 1 << 16):
        empty = ~full & some[:, None]
        if not empty.any():
            break
        src = (mix((at * 65537 + attempt).astype(U)) % U(bins)).astype(np.int64)
        take = empty & (sure != ~U(0))[:, src]
        out = np.where(take, mix(sure[:, src] + U(attempt)), out)
        full |= take
    return (out >> U(32)).astype(np.uint32), some


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        t = word_counts(b.column("text"))
        sk, some = sketches(b.column("text"))
        low = (sk & 0xFF).astype(np.uint8)
        yield pa.record_batch(
            [b.column("node"), b.column("doc_id"), pa.array(t), pa.array([a.tobytes() for a in sk], pa.binary(), mask=~some), pa.array([a.tobytes() for a in low], pa.binary(), mask=~some)],
            names=["node", "doc_id", "t", "heads", "sketch"],
        )


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    step = BINS // TREES
    for b in batches:
        for s in range(0, b.num_rows, 4096):
            c = b.slice(s, 4096)
            sk = np.frombuffer(b"".join(c.column("heads").to_pylist()), np.uint32).reshape(-1, BINS)
            low = np.frombuffer(b"".join(c.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            for t in range(TREES):
                key = mix(sk[:, t * step].astype(U) | U((t + 1) << 40))
                rolled = np.roll(low, -t * step, axis=1)
                yield pa.record_batch([pa.array(key.view(np.int64)), c.column("node"), pa.array([a.tobytes() for a in rolled], pa.binary())], names=["key", "node", "sketch"])


def _edges(reach: int, least: float):
    need = int(np.ceil(least * BINS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            if not b.num_rows:
                continue
            key, node = b.column("key").to_numpy(), b.column("node").to_numpy()
            sk = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            old = 0
            if tail is not None:
                old = len(tail[0])
                key, node, sk = np.r_[tail[0], key], np.r_[tail[1], node], np.concatenate([tail[2], sk])
            ends = []
            for r in range(1, reach + 1):
                i = np.arange(max(0, old - r), len(key) - r)
                i = i[key[i] == key[i + r]]
                w = (sk[i] == sk[i + r]).sum(axis=1)
                i, w = i[w >= need], w[w >= need]
                ends.append(np.stack([node[i], node[i + r], w]))
            tail = key[-reach:], node[-reach:], sk[-reach:]
            e = np.concatenate(ends, axis=1)
            e = e[:, e[0] != e[1]]
            yield pa.record_batch([pa.array(np.minimum(e[0], e[1])), pa.array(np.maximum(e[0], e[1])), pa.array(e[2].astype(np.int32))], names=["a", "b", "w"])

    return run


def graph(nodes: DataFrame, reach: int = REACH, nearest: int = NEAREST, least: float = LEAST) -> DataFrame:
    """(a, b, w): edges of the nearest-neighbour graph, both ways; w of BINS bins agree."""
    keyed = nodes.where("sketch IS NOT NULL").select("node", "heads", "sketch").mapInArrow(_trees, "key long, node long, sketch binary")
    pairs = keyed.repartitionByRange("key", "sketch", "node").sortWithinPartitions("key", "sketch", "node").mapInArrow(_edges(reach, least), "a long, b long, w int").distinct()
    both = pairs.union(pairs.select("b", "a", "w"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))
    top = both.withColumn("r", rank).where(F.col("r") <= nearest).drop("r")
    return materialise(top.union(top.select("b", "a", "w")).distinct(), "graph")


def walk(nodes: list[int], near: list[list[tuple[int, int]]]) -> list[int]:
    """Nodes in the order of the greedy paths; ``near[i]`` holds (node, weight) of node i's neighbours."""
    at = {n: i for i, n in enumerate(nodes)}
    order = [sorted(x, key=lambda e: (-e[1], e[0])) for x in near]
    heap = [(len(near[i]), n) for i, n in enumerate(nodes)]
    heapq.heapify(heap)
    seen, out, next_at = set(), [], [0] * len(nodes)
    while heap:
        _, n = heapq.heappop(heap)
        while n is not None and n not in seen:
            seen.add(n)
            out.append(n)
            i = at[n]
            n = None
            while next_at[i] < len(order[i]):
                m = order[i][next_at[i]][0]
                next_at[i] += 1
                if m not in seen:
                    n = m
                    break
    return out


def cut_components(every: DataFrame, edges: DataFrame, most: int = MOST, steps: tuple[int, ...] = CUTS) -> DataFrame:
    """(node, root) of components of which none has more than about ``most`` nodes."""
    for least in (*steps, None):
        every = materialise(every, "components")
        sizes = every.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > most)
        big = materialise(sizes, "large")
        if big.isEmpty():
            return every
        inside, rest = every.join(big, "root"), every.join(big, "root", "left_anti").select("node", "root")
        if least is None:
            part = F.pmod(F.xxhash64("node", F.lit("part")), F.ceil(F.col("size") / most))
            return rest.union(inside.select("node", F.xxhash64("root", part)))
        held = edges.where((F.col("a") < F.col("b")) & (F.col("w") >= least)).join(inside.select(F.col("node").alias("a")), "a").select("a", "b")
        roots = components(held)
        again = roots.union(roots.select("root", "root")).distinct()
        every = rest.union(inside.select("node").join(again, "node", "left").select("node", F.coalesce("root", "node")))
    return every


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, nodes, near = None, [], []

    def done() -> pa.RecordBatch:
        own = set(nodes)
        path = walk(nodes, [[e for e in x if e[0] in own] for x in near])
        return pa.record_batch([pa.array(path, pa.int64()), pa.array(range(len(path)), pa.int32())], names=["node", "step"])

    for b in batches:
        for root, node, es in zip(*[b.column(c).to_pylist() for c in ("root", "node", "near")]):
            if root != now and nodes:
                yield done()
                nodes, near = [], []
            now = root
            nodes.append(node)
            near.append([(e["b"], e["w"]) for e in es])
    if nodes:
        yield done()


def _fill(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, seq = None, 0, 0
        for b in batches:
            rows: list[tuple] = []
            for stream, doc, t in zip(*[b.column(c).to_pylist() for c in ("stream", "doc_id", "t")]):
                if stream != now:
                    now, at, seq = stream, 0, 0
                start = 0
                while start < t:
                    w, inside = divmod(at, window)
                    if inside == 0:
                        seq = 0
                    n = min(t - start, window - inside)
                    rows.append(((stream << 32) | w, seq, doc, start, n))
                    start, at, seq = start + n, at + n, seq + 1
            if rows:
                cols = list(zip(*rows))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["window_id", "seq", "doc_id", "start", "n_tokens"])

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, per_stream: int = PER_STREAM, most: int = MOST) -> DataFrame:
    """(window_id, seq, doc_id, start, n_tokens): the pieces of every window in order; ``start`` and
    ``n_tokens`` count words between white space."""
    texts = as_text(docs, id_col, text_col).withColumn("node", F.xxhash64("doc_id", "text"))
    rows = materialise(texts.mapInArrow(_scan, "node long, doc_id long, t long, heads binary, sketch binary"), "sketches").where("t > 0")
    nodes = rows.groupBy("node").agg(F.first("doc_id").alias("doc_id"), F.first("t").alias("t"), F.count("*").alias("n"), F.first("heads").alias("heads"), F.first("sketch").alias("sketch"))
    nodes = materialise(nodes, "nodes")
    edges = graph(nodes)
    roots = components(edges.where("a < b"))
    every = cut_components(roots.union(roots.select("root", "root")).distinct(), edges, most)
    near = edges.groupBy("a").agg(F.collect_list(F.struct("b", "w")).alias("near"))
    joined = near.withColumnRenamed("a", "node").join(every, "node")
    paths = joined.repartition("root").sortWithinPartitions("root", "node").mapInArrow(_paths, "node long, step int")
    total = nodes.agg(F.sum(F.col("t") * F.col("n"))).first()[0] or 0
    streams = max(1, int(total) // (window * per_stream))
    placed = nodes.select("node", "doc_id", "t", "n").join(every.join(paths, "node"), "node", "left")
    placed = placed.select("node", "doc_id", "t", F.coalesce("root", "node").alias("root"), F.coalesce("step", F.lit(0)).alias("step"), F.explode(F.expr("sequence(1L, n)")).alias("copy"))
    placed = placed.withColumn("stream", F.pmod(F.xxhash64("root", "copy"), F.lit(streams)))
    ordered = placed.repartition("stream").sortWithinPartitions("stream", F.xxhash64("root"), "root", "copy", "step")
    return ordered.select("stream", "doc_id", "t").mapInArrow(_fill(window), "window_id long, seq int, doc_id long, start long, n_tokens long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
