"""Nearest neighbours of a set of queries among all vectors by a block matrix join.

Vectors are scaled to length one and rounded to 8-bit integers with one scale a vector; the length of the
rounding error is kept. A tile is the product of a block of queries and a block of rows, both of integers
(in float32, which holds sums of up to 1,000 such products exactly). It gives every cosine within

    |e_a| + |e_b| (1 + |e_a|)

of the true one. A pair survives if its upper bound reaches the ``k``-th cosine found so far, or, while a
heap isn't full, the ``k``-th lower bound of the tile; survivors are recomputed from the floats in double
precision and merged into the heap of their query. No neighbour is lost, so recall is 1.

Queries are broadcast in blocks of at most about ``QUERY_BYTES``, as many as their table needs; the rows are
scanned once a block, where they lie, and only ``k`` rows a query leave a task. The work is the number of
queries times that of rows, as it is for any exact search.

Defined results: null and zero vectors, vectors with a null, NaN or infinite entry, and null ids have no neighbours and
are none; vectors are compared with those of their dimension; rows of a query's own id are left out; an id
that stands on several rows can be found once for each, and a query repeated in id and vector counts once;
ties (cosines equal to nine digits) go to the smaller id; fewer than ``k`` neighbours are given where
there are no more. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, BLOCK, EXACT_DIM, QUERY_BYTES, EVERY = 10, 1024, 1000, 8 << 20, 50


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit values, scales, and lengths of the rounding errors of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-12


class Block:
    """Vectors of one dimension: ids, floats, their lengths, and the rounded form."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray):
        self.ids, self.raw = ids, raw
        self.norm = np.linalg.norm(raw, axis=1)
        self.q, self.scale, self.err = quantise(raw / self.norm[:, None])

    def tile(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind = np.float32 if self.q.shape[1] <= EXACT_DIM else np.float64
        return self.q[s:e].astype(kind), self.scale[s:e], self.err[s:e]


def blocks(ids: pa.Array, lists: pa.Array) -> Iterator[Block]:
    """Usable vectors of a batch, by dimension."""
    lists = lists.cast(pa.list_(pa.float64()))
    offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    ids, size = ids.to_numpy(zero_copy_only=False), np.diff(offs)
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        raw = flat[offs[at][:, None] + np.arange(dim)[None, :]]
        with np.errstate(all="ignore"):
            norm = np.linalg.norm(raw, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        if ok.any():
            yield Block(ids[at][ok].astype(np.int64), raw[ok])


class Heaps:
    """The best ``k`` of every query of a block: cosine (nine digits) and id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.cos = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def merge(self, row: np.ndarray, cos: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(row)
        r = np.r_[np.repeat(touched, self.k), row]
        c = np.r_[self.cos[touched].ravel(), cos]
        i = np.r_[self.ids[touched].ravel(), ids]
        order = np.lexsort((i, -c, r))
        r = r[order]
        first = np.searchsorted(r, touched)
        at = order[(first[:, None] + np.arange(self.k)[None, :])]
        self.cos[touched], self.ids[touched] = c[at], i[at]

    def add(self, a: Block, b: Block, size: int = BLOCK) -> int:
        """Merge the tiles of all queries and some rows; the number of pairs recomputed."""
        return sum(self._tile(a, s, b, t, size) for s in range(0, len(a.ids), size) for t in range(0, len(b.ids), size))

    def _tile(self, a: Block, s: int, b: Block, t: int, size: int) -> int:
        e, f = min(s + size, len(a.ids)), min(t + size, len(b.ids))
        (qa, sa, ea), (qb, sb, eb) = a.tile(s, e), b.tile(t, f)
        near = (qa @ qb.T) * (sa[:, None] * sb[None, :])
        slack = ea[:, None] + eb[None, :] * (1 + ea[:, None])
        own = np.isin(b.ids[t:f], a.ids[s:e])
        if own.any():
            near[:, own] = np.where(a.ids[s:e][:, None] == b.ids[t:f][own][None, :], -np.inf, near[:, own])
        floor = self.cos[s:e, -1] - 1e-9
        if near.shape[1] > self.k and np.isinf(floor).any():
            floor = np.maximum(floor, np.partition(near - slack, -self.k, axis=1)[:, -self.k] - 1e-9)
        row, col = np.nonzero(near + slack >= np.maximum(floor, -2.0)[:, None])
        if len(row):
            cos = np.empty(len(row))
            for x in range(0, len(row), 1 << 16):
                r, c = row[x : x + (1 << 16)] + s, col[x : x + (1 << 16)] + t
                cos[x : x + (1 << 16)] = np.einsum("ij,ij->i", a.raw[r], b.raw[c]) / (a.norm[r] * b.norm[c])
            self.merge(row + s, np.round(cos, 9), b.ids[col + t])
        return len(row)


def _search(shared, k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, Block] = shared.value
        heaps = {dim: Heaps(len(q.ids), k) for dim, q in asked.items()}
        for batch in batches:
            for b in blocks(batch.column("id"), batch.column("v")):
                dim = b.raw.shape[1]
                if dim in asked:
                    heaps[dim].add(asked[dim], b, size)
        for dim, h in heaps.items():
            row, at = np.nonzero(np.isfinite(h.cos))
            if len(row):
                yield pa.record_batch([pa.array(np.full(len(row), dim, np.int32)), pa.array(row.astype(np.int32)), pa.array(asked[dim].ids[row]), pa.array(h.ids[row, at]), pa.array(h.cos[row, at])], names=["dim", "row", "vec_id", "neighbour_id", "cosine"])

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    if rows.schema["v"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")


def nearest(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine): the ``k`` vectors of largest cosine of every row of ``queries``
    (of the same columns), or of ``vectors`` itself."""
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col)
    asked = _usable(vectors if queries is None else queries, id_col, vector_col).distinct()
    total = asked.agg(F.sum(F.size("v").cast("long") * 8)).first()[0] or 0
    parts = max(1, -(-int(total) // query_bytes))
    out = spark.createDataFrame([], "part int, dim int, row int, vec_id long, neighbour_id long, cosine double")
    for n in range(parts):
        own = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("id", F.to_json("v")), F.lit(parts)) == n)
        table = own.orderBy("id", "v").toArrow().combine_chunks()  # about query_bytes
        held: dict[int, list[Block]] = {}
        for b in table.to_batches():
            for x in blocks(b.column("id"), b.column("v")):
                held.setdefault(x.raw.shape[1], []).append(x)
        if not held:
            continue
        whole = {d: Block(np.concatenate([x.ids for x in xs]), np.concatenate([x.raw for x in xs])) for d, xs in held.items()}
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast(whole), k, block), "dim int, row int, vec_id long, neighbour_id long, cosine double")
        out = out.union(found.select(F.lit(n).alias("part"), "*"))
    rank = F.row_number().over(Window.partitionBy("part", "dim", "row").orderBy(F.desc("cosine"), "neighbour_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "cosine")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by ``EVERY``, against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
    return found.withColumn("cosine", F.round("cosine", 6))


OP6_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
p AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 9) AS c
  FROM n a JOIN n b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour_id) AS rank FROM p)
SELECT vec_id, rank::INTEGER AS rank, neighbour_id, round(c, 6) AS cosine FROM r WHERE rank <= {K}
"""
