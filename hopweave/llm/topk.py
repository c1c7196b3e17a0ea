"""Exact top-k search by score at a time over an impact-ordered index.

Documents are scored by BM25 over the distinct words of a query, with document frequencies and mean
length of the whole corpus. A segment of the index holds the documents of a task's share whose impact
for a word, quantised to ``LEVELS`` steps, is the same; for a query the segments of its words are
read by descending impact, whichever words they belong to. Every document keeps what its segments have
given and how many words it has met, which bounds its score from both sides: words not met yet can give no
more than the level now reached, or their own highest impact. The search of a share stops as soon as this
proves that all but a few documents can't be among its best ``k``: when scoring these few exactly, by
looking each of them up in the words' postings, costs less than reading on. The segments left are not read.
The candidates are scored in double precision, and the best of all shares are merged. Nothing is
approximate: results are those of scoring every document with every query.

Every id of the query table is a query. Words of the queries are broadcast in blocks of at most
``QUERY_BYTES``, as many as the table needs; an index of a block's words is made once a block.

Defined results: words are lower-cased, split at white space and ASCII punctuation; null or empty
queries and texts, and rows without id, have no results; equal scores (to nine digits) rank by
doc_id; query rows of one id are one query of all their words; repeated documents are found each, as are
several texts of one doc_id; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import as_text, documents, materialise
from .textnum import U, Words, chunks

K, K1, B, LEVELS, QUERY_BYTES, SHARE = 10, 1.2, 0.75, 256, 8 << 20, 1 << 21
#: What a document's lookup for a word costs, in postings read; a word met counts as this much of a level.
LOOKUP, MET = 8, 2.0**-24


class Queries:
    """Distinct words of a block of queries: ``terms`` (sorted hashes), and the terms of each query."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = Words(pa.array(texts, pa.large_string()), strip_punct=True, lower=True)
        self.terms, inv = np.unique(w.hash, return_inverse=True)
        of: dict[int, list[np.ndarray]] = {}
        for i, (a, b) in zip(ids, zip(w.first[:-1], w.first[1:])):
            if b > a:
                of.setdefault(i, []).append(inv[a:b])
        self.ids, self.of = list(of), [np.unique(np.concatenate(x)) for x in of.values()]


def _postings(shared):
    """Per chunk: its documents with their lengths, and the postings of the queries' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        for b in chunks(batches):
            w = Words(b.column("text"), strip_punct=True, lower=True)
            at = np.minimum(np.searchsorted(terms, w.hash), max(0, len(terms) - 1))
            hit = terms[at] == w.hash if len(terms) else np.zeros(len(w), bool)
            pair, tf = np.unique(at[hit] * (1 << 32) + w.doc[hit], return_counts=True)
            term = (pair >> 32).astype(np.uint32)
            size = np.diff(w.first)
            df = np.bincount(term, minlength=len(terms))
            some = np.flatnonzero(df)
            cols = [b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), size.astype(np.int32), term, (pair & 0xFFFFFFFF).astype(np.uint32), tf.astype(np.uint32), some.astype(np.uint32), df[some].astype(np.uint32)]
            yield pa.record_batch([*[pa.array([c.tobytes()], pa.binary()) for c in cols], pa.array([int((size > 0).sum())]), pa.array([int(size.sum())])], names=["ids", "sizes", "term", "doc", "tf", "df_term", "df", "n", "words"])

    return run


POSTINGS = "ids binary, sizes binary, term binary, doc binary, tf binary, df_term binary, df binary, n long, words long"


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for t, n in zip(b.column("df_term").to_pylist(), b.column("df").to_pylist()):
            t, n = np.frombuffer(t, np.uint32), np.frombuffer(n, np.uint32)
            if len(t) and t[-1] >= len(total):
                total = np.r_[total, np.zeros(int(t[-1]) + 1 - len(total), np.int64)]
            np.add.at(total, t, n)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["term", "df"])


class Share:
    """Impact-ordered segments of some documents: per word, documents by descending level."""

    def __init__(self, parts: list[tuple], idf: np.ndarray, mean: float):
        base, self.ids, sizes, term, doc, tf = 0, [], [], [], [], []
        for ids, size, t, d, f in parts:
            ids = np.frombuffer(ids, np.int64)
            self.ids.append(ids)
            sizes.append(np.frombuffer(size, np.int32))
            term.append(np.frombuffer(t, np.uint32))
            doc.append(np.frombuffer(d, np.uint32).astype(np.int64) + base)
            tf.append(np.frombuffer(f, np.uint32))
            base += len(ids)
        self.ids, size = np.concatenate(self.ids), np.concatenate(sizes)
        term, doc, tf = np.concatenate(term).astype(np.int64), np.concatenate(doc), np.concatenate(tf).astype(np.float64)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
        self.step = float(idf.max(initial=0.0)) * (K1 + 1) / LEVELS
        level = np.minimum((impact / self.step).astype(np.int64), LEVELS - 1) if self.step else np.zeros(len(impact), np.int64)
        key = term << 32 | doc  # for looking documents up
        order = np.argsort(key, kind="stable")
        self.key, self.impact = key[order], impact[order]
        kind = term * LEVELS + (LEVELS - 1 - level)
        order = np.argsort(kind << 32 | doc)
        kind, self.doc = kind[order], doc[order].astype(np.int32)
        first = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, np.int64)
        self.start, self.end = first, np.r_[first[1:], len(kind)]
        self.level = LEVELS - 1 - kind[first] % LEVELS
        self.head = np.searchsorted(kind[first] // LEVELS, np.arange(len(idf) + 1))
        #: Postings that searches have read, and those of their words.
        self.read = self.held = 0

    def search(self, terms: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of all that can be among the best ``k`` and above ``floor``."""
        terms = terms[self.head[terms + 1] > self.head[terms]]
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(terms):
            return none
        seg = np.concatenate([np.arange(a, b) for a, b in zip(self.head[terms], self.head[terms + 1])])
        seg = seg[np.argsort(-self.level[seg], kind="stable")]
        level, tops = self.level[seg], np.sort(self.level[self.head[terms]])
        read = np.cumsum(self.end[seg] - self.start[seg])
        total = int(read[-1])
        self.held += total
        last = np.flatnonzero(np.r_[level[1:] != level[:-1], True])  # last segment of every level
        sums = np.zeros(len(self.ids))
        at, done, found, step = 0, 0, none[0], self.step
        while at < len(seg):
            # read on by a third, up to the end of a level; then look whether the proof holds
            to = int(last[min(np.searchsorted(read[last], max(2048, done * 4 // 3)), len(last) - 1)]) + 1
            to = max(to, int(last[np.searchsorted(last, at)]) + 1)
            part = seg[at:to]
            size = self.end[part] - self.start[part]
            docs = np.concatenate([self.doc[s:e] for s, e in zip(self.start[part].tolist(), self.end[part].tolist())])
            sums += np.bincount(docs, np.repeat(level[at:to] + MET, size), minlength=len(sums))
            at, done = to, int(read[to - 1])
            # a word not met gives less than the level above the next segment, and than its own top
            nxt = int(level[at]) + 1 if at < len(seg) else 0
            below = int(np.searchsorted(tops, nxt - 1))
            rest = float((tops[:below] + 1).sum() + nxt * (len(tops) - below)) if nxt else 0.0
            if at < len(seg) and len(sums) <= k and floor <= 0:
                continue
            low = np.floor(sums)
            best = np.partition(low, -k)[-k] * step if len(low) > k else 0.0
            need = max(best, floor) - 1e-6
            if at < len(seg) and rest * step >= need:
                continue  # documents not met at all could still be among the best
            met = (sums - low) / MET
            found = np.flatnonzero(((low + met + np.maximum(0.0, rest - met * nxt)) * step >= need) & (sums > 0))
            if len(found) * len(terms) * LOOKUP <= total - done:
                break
        self.read += done
        # each word in the order of its hash, as the sum has to be the same everywhere
        score = np.zeros(len(found))
        for t in terms.tolist() if len(found) else ():
            want = (t << 32) | found
            i = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            score += np.where(self.key[i] == want, self.impact[i], 0.0)
        return found[score > 0], score[score > 0]


def _search(shared, idf_shared, mean: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, idf = shared.value, idf_shared.value
        held: list[tuple] = []
        floor = np.zeros(len(q.ids))
        best: list[np.ndarray] = [np.zeros(0) for _ in q.ids]
        size = 0

        def results() -> pa.RecordBatch:
            share = Share(held, idf, mean)
            item, doc, score = [], [], []
            for i, terms in enumerate(q.of):
                d, s = share.search(terms, k, floor[i])
                s = np.round(s, 9)
                top = np.lexsort((share.ids[d], -s))[:k]
                best[i] = np.sort(np.r_[best[i], s[top]])[::-1][:k]
                if len(best[i]) == k:
                    floor[i] = best[i][-1]
                item.append(np.full(len(top), q.ids[i]))
                doc.append(share.ids[d[top]])
                score.append(s[top])
            return pa.record_batch([pa.array(np.concatenate(item).astype(np.int64)), pa.array(np.concatenate(doc).astype(np.int64)), pa.array(np.concatenate(score))], names=["item_id", "doc_id", "score"])

        if not q.ids:
            return
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("ids", "sizes", "term", "doc", "tf")]):
                held.append(row)
                size += len(row[2]) // 4
                if size >= SHARE:
                    yield results()
                    held, size = [], 0
        if held:
            yield results()

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest BM25 of every query."""
    spark = docs.sparkSession
    asked = queries.select(F.col(f"`{query_id}`").cast("long").alias("item_id"), F.col(f"`{query_text}`").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(total) // query_bytes) or 1
    texts = as_text(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    out = None
    for n in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n)
        rows = part.orderBy("item_id", "text").collect()  # about query_bytes of text
        q = spark.sparkContext.broadcast(Queries([r.item_id for r in rows], [r.text for r in rows]))
        index = materialise(texts.mapInArrow(_postings(q), POSTINGS), "postings")
        size = index.agg(F.sum("n"), F.sum("words")).first()
        count, mean = int(size[0] or 0), (size[1] or 0) / max(1, size[0] or 0)
        df = np.zeros(len(q.value.terms))
        for r in index.select("df_term", "df").mapInArrow(_df, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df  # one row per word of the queries at most
        idf = spark.sparkContext.broadcast(np.log(1 + (count - df + 0.5) / (df + 0.5)))
        found = index.select("ids", "sizes", "term", "doc", "tf").mapInArrow(_search(q, idf, max(mean, 1e-9), k), "item_id long, doc_id long, score double")
        out = found if out is None else out.union(found)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = "regexp_extract_all(lower(text), '[^\\x09-\\x0d\\x1c-\\x2f:-@\\[-`{-~]+')"
OP1_SQL = f"""
WITH w AS (SELECT doc_id, unnest({_SPLIT}) AS word FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, count(*) AS size FROM w GROUP BY doc_id),
c AS (SELECT count(*) AS n, avg(size) AS mean FROM d),
p AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
f AS (SELECT word, count(*) AS df FROM p GROUP BY word),
q AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS word FROM benchmark),
s AS (
  SELECT item_id, p.doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * size / mean))), 9) AS score
  FROM q JOIN p USING (word) JOIN f USING (word) JOIN d ON d.doc_id = p.doc_id CROSS JOIN c
  GROUP BY ALL
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s)
SELECT item_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= {K}
"""
