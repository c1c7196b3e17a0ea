"""Freshness of HTTP responses, as column expressions over header columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hopweave.sources.storage import cut

CACHEABLE = (200, 203, 206, 300, 301)
NONE, NORMAL, VALIDATE = 0, 1, 2


def directive(header: Column, name: str) -> Column:
    """Value of a Cache-Control directive, "" if it has none, null if it is absent."""
    parts = F.transform(F.split(header, ","), lambda x: F.trim(x))
    hit = F.filter(parts, lambda x: (x == name) | x.startswith(name + "="))
    return F.when(F.size(hit) > 0, F.substring_index(F.when(hit[0].contains("="), hit[0]).otherwise(F.concat(hit[0], F.lit("="))), "=", -1))


def control(status: Column, cache_control: Column, date: Column | None = None, expires: Column | None = None, compat: bool = False) -> Column:
    """struct(cacheable, max_age seconds, cache_type).

    The longer of max-age and s-maxage; without them Expires minus Date; no-store forbids, no-cache and
    must-revalidate ask for validation. ``compat``: Expires counts only beside a Cache-Control header."""
    seconds = lambda n: F.try_to_number(directive(cache_control, n), F.lit("999999999999")).cast("long")
    age = F.greatest(seconds("max-age"), seconds("s-maxage"))
    cache_control = F.coalesce(cache_control, F.lit(""))
    left = F.lit(None).cast("long") if date is None or expires is None else F.greatest(F.lit(0), F.unix_timestamp(expires) - F.unix_timestamp(date))
    if compat:
        left = F.when(cache_control != "", left)
    has = lambda n: directive(cache_control, n).isNotNull()
    known = F.coalesce(age, left)
    kind = (
        F.when(~status.isin(*CACHEABLE) | has("no-store"), NONE)
        .when(has("no-cache"), VALIDATE)
        .when(has("must-revalidate"), VALIDATE)
        .when(known.isNotNull(), NORMAL)
        .otherwise(NONE)
    )
    return F.struct((kind != NONE).alias("cacheable"), F.when(kind == NORMAL, known).when(kind == VALIDATE, 0).alias("max_age"), kind.alias("cache_type"))


def age(date: Column, received: Column, age_header: Column, now: Column) -> Column:
    """Seconds a response is old."""
    apparent = F.greatest(F.lit(0), F.unix_timestamp(received) - F.unix_timestamp(date))
    return F.greatest(apparent, F.coalesce(age_header, F.lit(0))) + F.unix_timestamp(now) - F.unix_timestamp(received)


def needs_validation(cache_type: Column, max_age: Column, age_s: Column) -> Column:
    return (cache_type == VALIDATE) | (age_s > max_age)


def _fold(rows: DataFrame, key: str, order: list[str], columns: list[str], schema: str, start: Callable[[], object], step: Callable[[object, dict], dict]) -> DataFrame:
    """Rows of a key in order, each given to ``step`` with the key's state; a row at a time, so that a key of any
    number of rows holds one state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row[key] != now:
                    now, state = row[key], start()
                out.append(step(state, row))
            if out:
                names = list(out[0])
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out]) if any(r[n] is not None for r in out) else pa.nulls(len(out)) for n in names], names=names).cast(want)

    want = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return rows.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def cache_hits(requests: DataFrame, key: str, ts: str, order: str, max_age_s: int) -> DataFrame:
    """Requests with ``server_hit``: whether they went to the server, the copy of the last such request
    of the key being older than ``max_age_s`` or absent."""
    limit = max_age_s * 1_000_000
    rows = requests.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).alias("nth"))

    def step(state: dict, row: dict) -> dict:
        hit = "last" not in state or row["at"] - state["last"] > limit
        if hit:
            state["last"] = row["at"]
        return {"key": row["key"], "nth": row["nth"], "server_hit": hit}

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return _fold(rows, "key", ["at", "nth"], rows.columns, f"key {kinds['key']}, nth {kinds['nth']}, server_hit boolean", dict, step).toDF(key, order, "server_hit")


SERVED = "key string, nth long, server_hit boolean, not_modified boolean, served string"


def revalidated(requests: DataFrame, pool: bool = True) -> DataFrame:
    """What a client with a cache does for requests (key, nth, at_ms, method, etag, cache_control, status, age):
    the last four are what the server answers at that time. (key, nth, server_hit, not_modified, served):
    whether the server is asked, whether it answers 304, and the ETag of the copy that is served.

    GET only. A copy that is fresh is served; one that is stale, or was marked no-cache, is asked for by its ETag: a
    server that has the same answers 304, which renews the copy's time and keeps the headers that a 304 doesn't send;
    else its new answer is stored, or the copy dropped where that may not be stored. Bad statuses leave the copy."""
    rows = requests.select("key", F.col("nth").cast("long").alias("nth"), F.col("at_ms").cast("long").alias("at_ms"), "method", "etag", control(F.col("status"), F.col("cache_control")).alias("c"), "status", F.coalesce("age", F.lit(0)).cast("long").alias("age"))
    rows = rows.select("*", "c.cacheable", "c.max_age", "c.cache_type").drop("c")

    def step(state: dict, row: dict) -> dict:
        said = {"key": row["key"], "nth": row["nth"], "server_hit": True, "not_modified": False, "served": row["etag"]}
        if row["method"] != "GET" or not pool:
            return said
        held = state.get("held")
        if held is not None:
            old = held["age"] * 1000 + row["at_ms"] - held["at_ms"]
            if held["cache_type"] == NORMAL and old <= held["max_age"] * 1000:
                return said | {"server_hit": False, "served": held["etag"]}
            if held["etag"] is not None and held["etag"] == row["etag"]:
                state["held"] = held | {"at_ms": row["at_ms"], "age": 0}
                return said | {"not_modified": True, "served": held["etag"]}
        if row["status"] is not None and 200 <= row["status"] < 300:
            state["held"] = {k: row[k] for k in ("etag", "at_ms", "age", "max_age", "cache_type")} if row["cacheable"] else None
        return said

    return _fold(rows, "key", ["at_ms", "nth"], rows.columns, SERVED, dict, step)


def replaced(entries: DataFrame, key: str, date: str) -> DataFrame:
    """Of several responses of a key the one a pool ends up with: an older Date never replaces a newer one."""
    return entries.groupBy(key).agg(F.max_by(F.struct(*[c for c in entries.columns if c != key]), date).alias("r")).select(key, "r.*")


def evicted(entries: DataFrame, key: str, size: str, used: str, limit: int) -> DataFrame:
    """Entries of a pool of ``limit`` bytes with ``kept``: the last used ones that fit together.

    Running sums of a sorted table: of each sorted part on its own, after the sums of the parts before, of which
    the driver gets one number a part."""
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(entries.repartitionByRange(parts, F.desc(used), F.asc(key)).withColumn("__part", F.spark_partition_id()))
    sums = {r["__part"]: r["n"] or 0 for r in ordered.groupBy("__part").agg(F.sum(size).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sums):
        before[p], total = total, total + sums[p]
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "__part int, __before long")
    w = Window.partitionBy("__part").orderBy(F.desc(used), key).rowsBetween(Window.unboundedPreceding, 0)
    return ordered.join(F.broadcast(offsets), "__part").withColumn("kept", F.sum(size).over(w) + F.col("__before") <= limit).drop("__part", "__before")
