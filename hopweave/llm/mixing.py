"""Mixing sources to target weights by entropy balancing.

Every document d with t_d tokens gets a rate w_d, the expected number of its copies. Among all rates
that give every source its share of the tokens, leave the tokens of every language as they are and keep
the mean length (a bounded score of log length) of a token, the rates are those nearest to one in
relative entropy weighted by tokens. They are exponentially tilted, w_d = exp(lambda . x_d), and lambda
minimises the convex dual

    D(lambda) = sum_d t_d exp(lambda . x_d) - lambda . m

by damped Newton steps. Gradient and Hessian are sums over documents, taken by the cluster in each
step over the table of distinct (source, language, length) cells, so only a K x K matrix reaches the
driver, K being the number of sources and languages. Rates are rounded to copies by a hash of the
document: floor(w) copies and one more with the probability of the rest.

Targets default to shares in proportion to (share of the tokens) ** ``temper``, which raises small
sources; the total stays as it is. A target for a source without tokens is ignored and the others are
scaled up to one; a source without a target gets no copies.

Defined results: null and empty texts have no tokens, rate 1 and one copy if their source has a target;
null source or language is a value of its own; repeated rows are rounded alike; an empty table stays so;
texts of any length count whole; added columns get other names where the table has theirs. The dual has
a variable a source and language: it is meant for up to some thousand of them, not for web domains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, fresh, materialise
from .textnum import chunks, word_counts

TEMPER, STEPS, TOLERANCE = 0.7, 50, 1e-9


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        yield pa.record_batch([pa.array(word_counts(b.column("text"))), b.column("source"), b.column("lang")], names=["t", "source", "lang"])


def tokens(text):
    """Column of the words of a text column without nulls."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        parts = [word_counts(b.column("text")) for b in chunks([pa.record_batch([texts], names=["text"])])]
        return pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]))

    return run.asNondeterministic()(text)  # so that it isn't run anew for every use of the result


def score(t):
    """Length of a document between -1 and 1, of a column of its number of tokens."""
    return F.tanh((F.log2(t.cast("double")) - 8) / 4)


class Balance:
    """Dual solution: tilt of every source and language, and of the length."""

    def __init__(self, sources: list, langs: list, tilt: np.ndarray, error: float):
        self.sources, self.langs, self.tilt, self.error = sources, langs, tilt, error

    def rate(self, source, lang, t):
        """Column of the rate; 0 for a source without a target, 1 for texts without tokens."""
        s = len(self.sources)
        total = score(t) * F.lit(float(self.tilt[-1]))
        for x, value, keys in ((source, self.tilt[:s], self.sources), (lang, self.tilt[s:-1], self.langs)):
            if keys:
                pairs = [F.lit(y) for k, v in zip(keys, value) for y in ("=" + k if k is not None else "", float(v))]
                total = total + F.coalesce(F.create_map(*pairs)[F.coalesce(F.concat(F.lit("="), x), F.lit(""))], F.lit(0.0))
        known = F.coalesce(F.concat(F.lit("="), source), F.lit("")).isin(["=" + k if k is not None else "" for k in self.sources])
        return F.when(~known, 0.0).when(t == 0, 1.0).otherwise(F.exp(total))


def newton(moments, target: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """Minimum of the dual. ``moments(tilt)`` gives the sums of t w, t w x and t w x x'."""
    k = len(target)
    tilt = np.zeros(k)
    mass, grad, hess = moments(tilt)
    value = mass - tilt @ target
    for _ in range(STEPS):
        gap = grad - target
        if np.abs(gap).max() <= TOLERANCE * total:
            break
        step = np.linalg.lstsq(hess + 1e-12 * total * np.eye(k), gap, rcond=1e-11)[0]
        size = 1.0
        while True:
            trial = tilt - size * step
            mass, grad, hess = moments(trial)
            now = mass - trial @ target
            if now <= value - 1e-4 * size * (gap @ step) + 1e-12 * abs(value) or size < 1e-6:
                break
            size /= 2
        tilt, value = trial, now
    return tilt, float(np.abs(grad - target).max() / max(total, 1.0))


def balance(cells: DataFrame, targets: dict | None = None, temper: float = TEMPER) -> Balance | None:
    """Solution for a table (source, lang, t, n) of the numbers n of documents; None without any tokens."""
    cells = cells.where("t > 0")
    by = cells.groupBy("source", "lang").agg(F.sum(F.col("t") * F.col("n")).cast("double").alias("y"), F.sum(score(F.col("t")) * F.col("t") * F.col("n")).alias("z")).collect()
    sums: dict = {}
    for r in by:
        sums[r.source] = sums.get(r.source, 0.0) + r.y
    if targets is not None:
        sums = {k: v for k, v in sums.items() if targets.get(k, 0) > 0}
    if not sums:
        return None
    sources = sorted(sums, key=lambda x: (x is not None, x))
    inside = [r for r in by if r.source in sums]
    langs = sorted({r.lang for r in inside}, key=lambda x: (x is not None, x))
    total = sum(sums.values())
    want = np.array([targets[s] if targets is not None else sums[s] ** temper for s in sources], float)
    want = want / want.sum() * total
    tongue = np.array([sum(r.y for r in inside if r.lang == x) for x in langs])
    target = np.r_[want, tongue, sum(r.z for r in inside)]
    s, k = len(sources), len(sources) + len(langs) + 1
    place, tongue_at = ({x: i for i, x in enumerate(names)} for names in (sources, langs))
    rows = cells.withColumn("z", score(F.col("t"))).withColumn("y", (F.col("t") * F.col("n")).cast("double"))

    def moments(tilt: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        b = Balance(sources, langs, tilt, 0.0)
        w = rows.withColumn("w", F.col("y") * b.rate(F.col("source"), F.col("lang"), F.col("t"))).where("w > 0")
        got = w.groupBy("source", "lang").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("z")).alias("wz"), F.sum(F.col("w") * F.col("z") * F.col("z")).alias("wzz")).collect()
        mass, grad, hess = 0.0, np.zeros(k), np.zeros((k, k))
        for r in got:
            i, j, e = place[r.source], s + tongue_at[r.lang], k - 1
            mass += r.w
            grad[[i, j]] += r.w
            grad[e] += r.wz
            hess[[i, j], [i, j]] += r.w
            hess[[i, j], [j, i]] += r.w
            hess[[i, j], e] += r.wz
            hess[e, [i, j]] += r.wz
            hess[e, e] += r.wzz
        return mass, grad, hess

    tilt, error = newton(moments, target, total)
    return Balance(sources, langs, tilt, error)


def rates(docs: DataFrame, targets: dict | None = None, temper: float = TEMPER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """``docs`` with the columns named by ``added``: tokens, rate and copies."""
    c = lambda x: F.col(f"`{x}`").cast("string")
    small = docs.select(c(text_col).alias("text"), c(source_col).alias("source"), c(lang_col).alias("lang"))
    cells = materialise(small.mapInArrow(_lengths, "t long, source string, lang string").groupBy("source", "lang", "t").agg(F.count("*").alias("n")), "lengths")
    b = balance(cells, targets, temper)
    n, rate, copies = added(docs)
    unit = F.pmod(F.xxhash64(F.lit("copies"), F.col(f"`{id_col}`"), c(text_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    out = docs.withColumn(n, tokens(F.coalesce(c(text_col), F.lit(""))))
    out = out.withColumn(rate, F.lit(1.0) if b is None else b.rate(c(source_col), c(lang_col), F.col(n)))
    return out.withColumn(copies, (F.floor(rate) + (unit < F.col(rate) - F.floor(rate)).cast("int")).cast("int"))


def added(docs: DataFrame) -> list[str]:
    """Names of the columns that ``rates`` adds: n_tokens, rate and copies, longer where ``docs`` has them."""
    return fresh(docs, "n_tokens", "rate", "copies")


def mixed(docs: DataFrame, targets: dict | None = None, temper: float = TEMPER, **cols: str) -> DataFrame:
    """Rows of ``docs``, each as often as it has copies."""
    many = rates(docs, targets, temper, **cols)
    copies, nth = added(docs)[2], fresh(many, "nth")[0]
    many = many.where(F.col(copies) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return many.select(*[F.col(f"`{x}`") for x in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(documents(spark, sf_dir)).select("doc_id", "source", "n_tokens", F.round("rate", 9).alias("rate"), "copies")
