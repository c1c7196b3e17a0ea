"""Order of visits: priorities, host spacing and token buckets as window functions.

The sequential rules (a host's next visit is no earlier than its last plus the interval) have closed
forms as running maxima, so a host's queue is one sort and one scan, partitioned by host.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def order_columns(next_at: str, score: str, seq: str, order: str = "exact") -> list[Column]:
    """Sort keys of a queue. exact: time, then falling score; clamped: milliseconds, then score held
    between 0 and 999; fifo: milliseconds, then order of arrival."""
    n, s = F.col(next_at), F.col(score)
    ms = F.floor(micros(n) / 1000)
    if order == "exact":
        return [n.asc(), s.desc(), F.col(seq).asc()]
    if order == "clamped":
        return [ms.asc(), (F.lit(999) - F.greatest(F.lit(0), F.least(F.lit(999), s))).asc(), F.col(seq).asc()]
    if order == "fifo":
        return [ms.asc(), F.col(seq).asc()]
    raise ValueError(order)


def due(items: DataFrame, now: Column, next_at: str, score: str, seq: str, most: int | None = None, order: str = "exact") -> DataFrame:
    """Items strictly before ``now`` in queue order, the first ``most`` of them."""
    out = items.where(F.col(next_at) < now).orderBy(*order_columns(next_at, score, seq, order))
    return out if most is None else out.limit(most)


def ranked(items: DataFrame, by: str, next_at: str, score: str, seq: str, order: str = "exact") -> DataFrame:
    """``items`` with ``position`` in the queue of each ``by``."""
    return items.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order_columns(next_at, score, seq, order))))


def spaced(items: DataFrame, host: str, next_at: str, score: str, seq: str, interval_us: int | Column) -> DataFrame:
    """``items`` with ``pop_us``: when each leaves its host's queue, at least ``interval_us`` apart; a column of
    it has one value a host."""
    interval_us = interval_us if isinstance(interval_us, Column) else F.lit(interval_us)
    keys = order_columns(next_at, score, seq)
    w = Window.partitionBy(host).orderBy(*keys)
    numbered = items.withColumn("__k", F.row_number().over(w))
    ahead = micros(F.col(next_at)) - F.col("__k") * interval_us
    run = Window.partitionBy(host).orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("pop_us", F.max(ahead).over(run) + F.col("__k") * interval_us).drop("__k")


def bucket_wait(events: DataFrame, host: str, ts: str, seq: str, interval_us: int, burst: int) -> DataFrame:
    """``events`` with ``wait_us``: delay by a bucket of ``burst`` tokens, one more every interval. No
    interval means no limit, no burst that an event never passes (null)."""
    if interval_us <= 0:
        return events.withColumn("wait_us", F.lit(0).cast("long"))
    if burst <= 0:
        return events.withColumn("wait_us", F.lit(None).cast("long"))
    numbered = events.withColumn("__k", F.row_number().over(Window.partitionBy(host).orderBy(ts, seq)))
    t = micros(F.col(ts))
    run = Window.partitionBy(host).orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    arrival = F.max(t - (F.col("__k") - 1) * F.lit(interval_us)).over(run) + F.col("__k") * F.lit(interval_us)
    return numbered.withColumn("wait_us", F.greatest(F.lit(0), arrival - t - F.lit(burst * interval_us)).cast("long")).drop("__k")


class Bucket:
    """Token bucket of one host whose interval is asked for anew after so many events."""

    def __init__(self, host, limits: Callable[[object, int], tuple[int, int]], every: int, state: tuple | None = None):
        self.host, self.limits, self.every = host, limits, every
        self.asked, self.count, self.interval, self.burst, self.tokens, self.at = state or (0, 0, 0, 0, 0.0, None)

    def state(self) -> tuple:
        return self.asked, self.count, self.interval, self.burst, self.tokens, self.at

    def _fill(self, at: int) -> None:
        if self.interval > 0 and self.at is not None:
            self.tokens = min(float(self.burst), self.tokens + (at - self.at) / self.interval)
        self.at = at

    def wait(self, at: int) -> int | None:
        """Microseconds that an event at the time ``at`` waits; None if it never passes."""
        if self.asked == 0:
            self.interval, self.burst = self.limits(self.host, 0)
            self.tokens, self.asked = float(self.burst), 1
        elif self.count >= self.every:
            self._fill(at)
            self.interval, _ = self.limits(self.host, self.asked)
            self.asked, self.count = self.asked + 1, 0
        self.count += 1
        if self.interval <= 0:
            return 0
        if self.burst <= 0:
            return None
        self._fill(at)
        self.tokens -= 1
        return round(max(0.0, -self.tokens) * self.interval)


def updatable_wait(events: DataFrame, host: str, ts: str, seq: str, limits: Callable[[object, int], tuple[int, int]], every: int) -> DataFrame:
    """(host, seq, wait_us): delays by a token bucket whose interval may change (``streaming.flows.limited_stream``).
    The closed form of ``bucket_wait`` needs one interval, so a host's events are folded in order."""
    rows = events.select(F.col(host).alias("host"), F.col(seq).alias("seq"), micros(F.col(ts)).alias("at"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for b in batches:
            out = []
            for h, at in zip(b.column("host").to_pylist(), b.column("at").to_pylist()):
                if bucket is None or bucket.host != h:
                    bucket = Bucket(h, limits, every)
                out.append(bucket.wait(at))
            yield pa.record_batch([b.column("host"), b.column("seq"), pa.array(out, pa.int64())], names=["host", "seq", "wait_us"])

    return rows.repartition("host").sortWithinPartitions("host", "at", "seq").mapInArrow(run, f"host {kinds['host']}, seq {kinds['seq']}, wait_us long").toDF(host, seq, "wait_us")
