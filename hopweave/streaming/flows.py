"""Streaming twins of the event-driven operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hopweave.operators.pacing import Bucket, micros
from hopweave.sources.storage import workspace


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of the files of a table, which may be one file or a folder."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Everything a stream has now, by way of a table in the shared folder."""
    root = f"{workspace(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def distinct_stream(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """First event of every key; state is kept for ``late`` after it."""
    return events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late).dropDuplicatesWithinWatermark(keys).select(*keys)


def spaced_stream(events: DataFrame, host: str, ts: str, seq: str, interval_us: int, late: str = "60 days") -> DataFrame:
    """(host, seq, pop_us): visits of every host at least ``interval_us`` apart. The time of a host's last
    visit is its state, so items may come while others are already out; it goes once no event less than ``late``
    behind can be held up by it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        last = state.get[0] if state.exists else None
        out = []
        for at in rows["at"]:
            last = int(at) if last is None else max(int(at), last + interval_us)
            out.append(last)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + interval_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({host: [key[0]] * len(rows), seq: rows["seq"].to_numpy(), "pop_us": out})

    src = events.withColumn("t", F.col(ts).cast("timestamp")).withWatermark("t", late).select(F.col(host), F.col(seq).cast("long").alias("seq"), micros(F.col("t")).alias("at"), "t")
    kind = events.schema[host].dataType.simpleString()
    return src.groupBy(host).applyInPandasWithState(step, f"{host} {kind}, {seq} long, pop_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def limited_stream(events: DataFrame, host: str, ts: str, seq: str, limits: Callable[[object, int], tuple[int, int]], every: int) -> DataFrame:
    """(host, seq, wait_us): delays by a token bucket whose interval may change. ``limits`` of a host and of how often
    it was asked before gives (interval in microseconds, burst); it is asked at a host's first event and after
    every ``every`` events more, of which only the interval counts. The stateful twin of ``pacing.updatable_wait``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        bucket = Bucket(key[0], limits, every, state.get if state.exists else None)
        out = [bucket.wait(int(at)) for at in rows["at"]]
        state.update(bucket.state())
        yield pd.DataFrame({host: [key[0]] * len(rows), seq: rows["seq"].to_numpy(), "wait_us": out})

    src = events.select(F.col(host), F.col(seq).cast("long").alias("seq"), micros(F.col(ts)).alias("at"))
    kind = events.schema[host].dataType.simpleString()
    return src.groupBy(host).applyInPandasWithState(step, f"{host} {kind}, {seq} long, wait_us long", "asked int, count int, interval long, burst int, tokens double, at long", "append", GroupStateTimeout.NoTimeout)


def cut_off_stream(responses: DataFrame, host: str, order: str, similar: str, more_than: int = 500) -> DataFrame:
    """(host, order, cancelled): running twin of the similar-page cut-off. A host that is given up stays so, so its
    three numbers are kept for good."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("o")
        seen, alike, over = state.get if state.exists else (0, 0, False)
        out = []
        for s in rows["s"]:
            out.append(over)
            seen, alike = seen + 1, alike + bool(s)
            over = over or (seen > more_than and alike * 2 > seen)
        state.update((int(seen), int(alike), bool(over)))
        yield pd.DataFrame({host: [key[0]] * len(rows), order: rows["o"].to_numpy(), "cancelled": out})

    src = responses.select(F.col(host), F.col(order).cast("long").alias("o"), F.col(similar).cast("boolean").alias("s"))
    kind = responses.schema[host].dataType.simpleString()
    return src.groupBy(host).applyInPandasWithState(step, f"{host} {kind}, {order} long, cancelled boolean", "seen long, alike long, over boolean", "append", GroupStateTimeout.NoTimeout)
