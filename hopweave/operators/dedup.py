"""De-duplication of URLs and pages: exact, by URL shape, by structural fingerprint."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.html import fingerprint
from hopweave.sources.storage import cut, workspace


def unseen(new: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows of new keys, one a key, that aren't in ``seen``."""
    return new.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def fingerprints(html: Column, limit: int = 4096, shingle: int = 2, whole: bool = False) -> Column:
    """64-bit structural SimHash of a page column."""

    @F.arrow_udf("long")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if h is None else fingerprint(h, limit, shingle, whole) for h in x.to_pylist()], pa.int64())

    return run(html)


def classes(items: DataFrame, id_col: str, fp: str) -> DataFrame:
    """(id, class_id, n) of every item with a fingerprint: the smallest id of its fingerprint, and their number.
    Fingerprints are taken once and written."""
    items = cut(items.select(id_col, fp))
    by = items.where(F.col(fp).isNotNull()).groupBy(fp).agg(F.min(id_col).alias("class_id"), F.count("*").alias("n"))
    return items.join(by, fp).select(F.col(id_col).alias("id"), "class_id", "n")


def _blocks(n: int, radius: int, bits: int) -> tuple[int, int]:
    """Number of blocks of bits, and how many of them two values have in common that differ in ``radius`` bits at most:
    the least expected work for n values, of writing a value's keys and of comparing what meets. Bits of
    fingerprints aren't independent: a key parts values as about 0.6 times its bits would."""
    if radius >= bits:
        return bits, 0

    def work(same: int) -> float:
        blocks = radius + same
        return comb(blocks, same) * (1 + n / 2 ** (1 + 0.6 * bits * same / blocks) / 20)

    same = min((k for k in range(1, bits - radius + 1) if k == 1 or comb(radius + k, k) <= 5000), key=work)
    return radius + same, same


def _dealt(reps: DataFrame, blocks: int, bits: int) -> list[int]:
    """Masks of blocks, the bits dealt out in order of how evenly they part the values, so that no block has the dull ones."""
    ones = reps.agg(F.count("*"), *[F.sum(F.shiftrightunsigned("f", i).bitwiseAND(F.lit(1))) for i in range(bits)]).first()
    order = sorted(range(bits), key=lambda i: abs(2 * (ones[i + 1] or 0) - ones[0]))
    out = [0] * blocks
    for rank, i in enumerate(order):
        turn, at = divmod(rank, blocks)
        out[at if turn % 2 == 0 else blocks - 1 - at] |= 1 << i
    return out


def _long(x: int) -> Column:
    """64 bits as a signed number."""
    return F.lit(x if x < 1 << 63 else x - (1 << 64)).cast("long")


def similar_pairs(items: DataFrame, id_col: str, fp: str, radius: int, bits: int = 64) -> DataFrame:
    """(a, b, distance), a < b, of classes of equal fingerprints at most ``radius`` bits apart, each told by
    its smallest id; ``classes`` gives the members.

    Values so near have k of ``radius + k`` blocks of their bits in common, so pairs meet in an equi-join of the values'
    bits in any k blocks, k by the number of values; a pair is taken from the first k blocks that it has in common.
    Members of a bucket are never gathered: the join compares them as they stream by. Fingerprints are taken
    once and written."""
    reps = cut(items.where(F.col(fp).isNotNull()).groupBy(F.col(fp).alias("f")).agg(F.min(id_col).alias("id")))
    blocks, same = _blocks(reps.count(), radius, bits)
    masks = _dealt(reps, blocks, bits)
    chosen = list(combinations(range(blocks), same))
    keys = F.array(*[_long(sum(masks[i] for i in c)) for c in chosen])
    # blocks before the last of a choice that aren't in it: where a pair has one in common, another choice is its first
    skipped = F.array(*[F.array(*[_long(masks[i]) for i in range(max(c, default=0)) if i not in c]).cast("array<bigint>") for c in chosen])
    keyed = reps.select("id", "f", F.posexplode(keys).alias("t", "m")).select("id", "f", "t", F.col("f").bitwiseAND(F.col("m")).alias("v"))
    a, b = keyed.alias("a"), keyed.alias("b")
    x = F.col("a.f").bitwiseXOR(F.col("b.f"))
    d = F.bit_count(x)
    # a plan sees the values before they are multiplied: it would broadcast far more than it means to
    met = a.join(b.hint("merge"), (F.col("a.t") == F.col("b.t")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.id") < F.col("b.id")) & (d <= radius))
    near = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.cast("int").alias("distance"), x.alias("x"), F.col("a.t").alias("t"))
    first = F.forall(F.element_at(skipped, F.col("t") + 1), lambda m: F.col("x").bitwiseAND(m) != 0)
    return near.where(first).select("a", "b", "distance")


def keep_exact(items: DataFrame, order: str, fp: str) -> DataFrame:
    """``items`` with ``kept``: whether it is the first of its fingerprint; fingerprint 0 and null are never kept.
    Fingerprints are taken once and written, with what else ``items`` hold."""
    items = cut(items)
    first = items.where(F.col(fp) != 0).groupBy(F.col(fp).alias("__fp")).agg(F.min(order).alias("__first"))
    met = items.join(first, F.col(fp) == F.col("__fp"), "left")
    return met.withColumn("kept", F.coalesce(F.col(order) == F.col("__first"), F.lit(False))).drop("__fp", "__first")


def keep_similar(items: DataFrame, order: str, fp: str, radius: int, zero_node: bool = True) -> DataFrame:
    """``items`` with ``kept``: in order, an item is kept unless a kept one is at most ``radius`` bits away.

    With ``zero_node`` fingerprints within the radius of 0 are never kept. Rounds decide all items whose
    earlier neighbours are decided; there are as many as the longest chain of them."""
    spark = items.sparkSession
    path = f"{workspace(spark)}/kept-{uuid.uuid4().hex}"
    items = cut(items)
    pairs = cut(similar_pairs(items, order, fp, radius).select("a", "b"))
    near_zero = F.bit_count(F.col(fp)) <= radius if zero_node else F.lit(False)
    # of equal fingerprints only the first can be kept
    first = cut(items.where(F.col(fp).isNotNull()).groupBy(fp).agg(F.min(order).alias("id")).select("id", F.when(near_zero, 2).otherwise(0).alias("state")))
    # those without an earlier neighbour are kept or not at once; rounds are for the others and what they hang on
    later = pairs.select(F.col("b").alias("id")).distinct()
    alone = first.join(later, "id", "left_anti").select("id", F.when(F.col("state") == 0, 1).otherwise(2).alias("state"))
    decided = alone.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    state = first.join(later, "id", "left_semi").unionByName(decided)
    n = 0
    while True:
        state.write.parquet(f"{path}/state{n}")
        state = spark.read.parquet(f"{path}/state{n}")
        if state.where("state = 0").isEmpty():
            break
        n += 1
        earlier = pairs.join(state.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.max((F.col("state") == 1).cast("int")).alias("near_kept"), F.max((F.col("state") == 0).cast("int")).alias("open"))
        state = state.join(earlier, "id", "left").select(
            "id", F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("near_kept", F.lit(0)) == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0).alias("state")
        )
    met = state.join(later, "id", "left_semi").unionByName(alone)
    kept = met.select(F.col("id").alias(order), (F.col("state") == 1).alias("kept"))
    return items.join(kept, order, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


STEP = "array<struct<kind:string,depth:int,text:string>>"


def shape(url: Column) -> Column:
    """Steps of a URL down the shape tree, array<struct(kind, depth, text)>: every path segment ("/"), empty
    ones too, at depths from 1 on, then the decoded query pairs in order of key and value, key ("?") and value
    ("=") of a pair at one depth."""
    segments = F.split(F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1), "/")
    path = F.transform(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), lambda x, i: F.struct(F.lit("/").alias("kind"), (i + 1).cast("int").alias("depth"), x.alias("text")))
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pair = lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("k"), plain(F.when(x.contains("="), F.substring(x, F.locate("=", x) + 1, F.length(x))).otherwise("")).alias("v"))
    given = F.filter(F.split(F.regexp_extract(url, "\\?([^#]*)", 1), "&"), lambda x: x != "")
    pairs = F.array_sort(F.transform(given, pair))
    depth = lambda i: (F.size(path) + i + 1).cast("int")
    query = F.flatten(F.transform(pairs, lambda p, i: F.array(F.struct(F.lit("?").alias("kind"), depth(i).alias("depth"), p["k"].alias("text")), F.struct(F.lit("=").alias("kind"), depth(i).alias("depth"), p["v"].alias("text")))))
    return F.concat(path.cast(STEP), query.cast(STEP))


def threshold(depth: int) -> int:
    """Children a node of the shape tree may have: 14 down to 2 as it gets deeper."""
    d = 0 if depth <= 2 else min(depth, 6)
    return 14 if d == 0 else 14 - 2 * d


def _node(prefix: Column, step: Column) -> Column:
    """Name of the node that a step leads to."""
    return F.concat(prefix, F.lit("\x00"), step["kind"], step["text"])


def admit_shapes(items: DataFrame, host: str, url: str, seq: str, limit: Callable[[int], int] | None = threshold) -> DataFrame:
    """``items`` with ``admitted``: in order of ``seq``, a URL is turned down where it would be a new child of a
    node that has its number of children, ``limit`` of the child's depth; segments, query keys and values of a
    node count apart. None admits all.

    Level by level, down to the deepest step of the table: the children that a node admits are the first to
    come of those reached. They are found from one row a child, and URLs under others are out."""
    spark, root = items.sparkSession, f"{workspace(items.sparkSession)}/shapes-{uuid.uuid4().hex}"
    own, rows = "__row", items.withColumn("__row", F.expr("uuid()"))
    rows.write.parquet(f"{root}/items")
    rows = spark.read.schema(rows.schema).parquet(f"{root}/items")
    if limit is None:
        return rows.drop(own).withColumn("admitted", F.lit(True))
    alive = rows.select(own, F.col(seq).alias("seq"), F.coalesce(F.col(host), F.lit("")).alias("at"), F.coalesce(shape(F.col(url)), F.array().cast(STEP)).alias("steps"))
    d = 0
    while True:
        alive.write.parquet(f"{root}/{d}")
        alive = spark.read.parquet(f"{root}/{d}")
        deepest = alive.agg(F.max(F.get("steps", F.lit(d))["depth"])).first()[0]
        if deepest is None:  # no step left
            break
        step = F.get("steps", F.lit(d))
        going = alive.where(F.size("steps") > d).withColumn("step", step)
        child = going.groupBy("at", "step").agg(F.min("seq").alias("first"))
        rank = F.row_number().over(Window.partitionBy("at", F.col("step.kind")).orderBy("first", "step.text"))
        most = F.element_at(F.array(*[F.lit(int(limit(i))) for i in range(1, deepest + 1)]), F.col("step.depth"))
        open_ = child.withColumn("rank", rank).where(F.col("rank") <= most).select("at", "step")
        passed = going.join(open_, ["at", "step"], "left_semi").select(own, "seq", _node(F.col("at"), F.col("step")).alias("at"), "steps")
        alive = passed.unionByName(alive.where(F.size("steps") <= d))
        d += 1
    out = rows.join(alive.select(own, F.lit(True).alias("admitted")), own, "left")
    return out.withColumn("admitted", F.coalesce("admitted", F.lit(False))).drop(own)


def has_shape(items: DataFrame, known: DataFrame, host: str, url: str, limit: Callable[[int], int] | None = threshold) -> DataFrame:
    """``items`` with ``found``: every step is in the tree of ``known``, or the first that isn't is a segment or a
    value under a node, or key, that has its number of children."""
    walk = lambda f: F.aggregate(F.col("steps"), F.struct(f.alias("at"), F.array().cast("array<struct<at:string,step:struct<kind:string,depth:int,text:string>>>").alias("out")), lambda acc, x: F.struct(_node(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias("step")))).alias("out")))["out"]
    stepped = known.select(F.coalesce(F.col(host), F.lit("")).alias("host"), shape(F.col(url)).alias("steps"))
    nodes = stepped.select(F.explode(walk(F.col("host"))).alias("w")).select("w.at", F.col("w.step.kind").alias("kind"), F.col("w.step.text").alias("text")).distinct()
    fan = nodes.groupBy("at", "kind").agg(F.count("*").alias("n"))
    rows = items.withColumn("__row", F.expr("uuid()"))
    path = f"{workspace(items.sparkSession)}/lookup-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = items.sparkSession.read.schema(rows.schema).parquet(path)
    asked = rows.select("__row", F.coalesce(F.col(host), F.lit("")).alias("host"), shape(F.col(url)).alias("steps"))
    each = asked.select("__row", F.posexplode(walk(F.col("host"))).alias("d", "w")).select("__row", "d", "w.at", F.col("w.step.kind").alias("kind"), F.col("w.step.depth").alias("depth"), F.col("w.step.text").alias("text"))
    missing = each.join(nodes, ["at", "kind", "text"], "left_anti").groupBy("__row").agg(F.min_by(F.struct("at", "kind", "depth"), "d").alias("m")).select("__row", "m.*")
    missing = missing.join(fan, ["at", "kind"], "left")
    if limit is None:
        full = F.lit(False)
    else:
        deepest = asked.agg(F.max(F.size("steps"))).first()[0] or 1
        most = F.element_at(F.array(*[F.lit(int(limit(i))) for i in range(1, deepest + 1)]), F.col("depth"))
        full = (F.col("kind") != "?") & (F.coalesce("n", F.lit(0)) >= most) & F.col("n").isNotNull()
    return rows.join(missing.select("__row", full.alias("found")), "__row", "left").withColumn("found", F.coalesce("found", F.lit(True))).drop("__row")
