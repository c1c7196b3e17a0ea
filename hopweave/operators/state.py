"""Visits of URLs: outcome classes, retries, completion and the table of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopweave.functions.urls import part

RETRY_DELAY_S, RETRY_MOST, MIN_DELAY_S = 10, 4, 10


def outcome(status: Column, error: Column | None = None) -> Column:
    """ok, retry, error or fatal of an HTTP status (none at all, no answer, is to be tried again) and of what
    handling the response said: a class of these, or null."""
    of = F.when(status.isNull(), "retry").when(status.between(200, 299), "ok").when((status >= 500) | (status.between(400, 499) & (status != 404)), "retry").otherwise("error")
    return of if error is None else F.when(error.isin("retry", "error", "fatal"), error).otherwise(of)


def visited(row: DataFrame, outcome: str, at: str, again: Column | None = None, retry_delay_s: int = RETRY_DELAY_S, most: int = RETRY_MOST, min_delay_s: int = MIN_DELAY_S, wanted: Column | None = None) -> DataFrame:
    """URL states (URL_STATE) after a visit at the time ``at``, by the column ``outcome``.

    ok: one more visit, no retries, and done unless ``again`` says that the URL is to be visited anew: at ``wanted``,
    but no earlier than ``min_delay_s`` after the visit before this one. retry: one more retry, and done at the
    ``most``-th, else due after ``retry_delay_s`` with score 0. error and cancelled: done. Completion is a state, so it
    can't be counted twice."""
    ok, retry = F.col(outcome) == "ok", F.col(outcome) == "retry"
    again = F.lit(False) if again is None else again
    tries = F.col("num_retry") + 1
    later = F.col(at) + F.make_dt_interval(secs=F.lit(retry_delay_s))
    next_ = F.greatest(F.col(at) if wanted is None else wanted, F.col("last") + F.make_dt_interval(secs=F.lit(min_delay_s)))
    new = {
        "done": F.when(ok, ~again).when(retry, tries >= most).otherwise(True),
        "last": F.when(ok, F.col(at)).otherwise(F.col("last")),
        "num_visit": F.col("num_visit") + ok.cast("int"),
        "num_retry": F.when(ok, 0).when(retry, tries).otherwise(F.col("num_retry")),
        "num_error": F.col("num_error") + F.col(outcome).isin("retry", "error", "fatal").cast("int"),
        "next_at": F.when(ok & again, next_).when(retry & (tries < most), later),
        "score": F.when(retry, 0).otherwise(F.col("score")),
    }
    return row.select(*[new[c].alias(c) if c in new else F.col(c) for c in row.columns])


def retries(log: DataFrame, key: str, order: list[str], failed: Column, most: int = RETRY_MOST) -> DataFrame:
    """``log`` with ``retry``: failures since the last success of the key, and ``completed``: whether this
    one was the last; rows after it are cut, as the key is no longer visited."""
    w = Window.partitionBy(key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    marked = log.withColumn("__f", failed.cast("int")).withColumn("__island", F.sum(1 - F.col("__f")).over(run))
    own = Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("retry", F.sum("__f").over(own)).withColumn("completed", (F.col("__f") == 1) & (F.col("retry") >= most))
    before = F.coalesce(F.sum(F.col("completed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("__cut", before).where("__cut = 0").drop("__f", "__island", "__cut")


def rescheduled(log: DataFrame, key: str, ts: str, order: list[str], wanted: Column, min_delay: int = MIN_DELAY_S) -> DataFrame:
    """``log`` with ``next_at``: the wanted time, but no earlier than ``min_delay`` seconds after the visit
    before this one."""
    last = F.lag(ts).over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("next_at", F.greatest(wanted, last + F.make_dt_interval(secs=F.lit(min_delay))))


def visits_left(log: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` visits of every key."""
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def put_new(state: DataFrame, new: DataFrame) -> DataFrame:
    """``state`` and the rows of ``new`` whose URL it doesn't have, the shallowest of each."""
    first = new.groupBy("url").agg(F.min("depth").alias("depth"))
    fresh = first.join(state.select("url"), "url", "left_anti")
    return state.unionByName(fresh, allowMissingColumns=True)


def exists(urls: DataFrame, state: DataFrame) -> DataFrame:
    return urls.join(state.select("url"), "url", "left_semi")


def get(urls: DataFrame, state: DataFrame) -> DataFrame:
    """States of ``urls``; a URL without one is an error."""
    found = urls.select("url").distinct().join(state.withColumn("__there", F.lit(True)), "url", "left")
    there = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no state of "), F.col("url"))).cast("boolean")).otherwise(F.lit(True))
    return found.where(there).select(*state.columns)


def depths(urls: DataFrame, state: DataFrame) -> DataFrame:
    """(url, depth) of ``urls``; a URL without a state is an error."""
    return get(urls, state).select("url", "depth")


def context(items: DataFrame, state: DataFrame) -> DataFrame:
    """Queue items with what calls for them may ask: depth, num_visit, num_error and last."""
    return items.join(state.select("url", "depth", "num_visit", "num_error", "last"), "url")


def encode(state: DataFrame) -> DataFrame:
    """(url, record): states as JSON."""
    return state.select("url", F.to_json(F.struct(*state.columns), {"ignoreNullFields": "false", "timestampFormat": _TIME}).alias("record"))


def decode(records: DataFrame, schema: str) -> DataFrame:
    """The states that ``encode`` made text of."""
    return records.select(F.from_json("record", schema, {"timestampFormat": _TIME}).alias("r")).select("r.*")


_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def four_part(state: DataFrame) -> DataFrame:
    """States keyed by (scheme, host, path, query), the parameters of the query in order, as SQL stores keep them;
    of URLs that differ only in that order the first counts."""
    query = F.array_join(F.array_sort(F.filter(F.split(part(F.col("url"), "query"), "&"), lambda x: x != "")), "&")
    keyed = state.select(part(F.col("url"), "scheme").alias("scheme"), part(F.col("url"), "host").alias("host"), part(F.col("url"), "path").alias("path"), query.alias("query"), F.struct("url", *[c for c in state.columns if c not in ("url", "host")]).alias("r"))
    return keyed.groupBy("scheme", "host", "path", "query").agg(F.min_by("r", "r.url").alias("r")).select("scheme", "host", "path", "query", *[f"r.{c}" for c in state.columns if c not in ("url", "host")])


def updated(state: DataFrame, changes: DataFrame) -> DataFrame:
    """``state`` with num_retry, num_visit, last and status of ``changes`` (one row a URL) where given."""
    names = [c for c in ("num_retry", "num_visit", "num_error", "last", "status") if c in changes.columns]
    right = changes.select("url", *[F.col(c).alias("__" + c) for c in names])
    joined = state.join(right, "url", "left")
    return joined.select(*[F.coalesce("__" + c, c).alias(c) if c in names else F.col(c) for c in state.columns])


def completed(state: DataFrame, urls: DataFrame) -> DataFrame:
    """``state`` with ``urls`` done, however often that is said."""
    hit = urls.select("url").distinct().withColumn("__done", F.lit(True))
    return state.join(hit, "url", "left").withColumn("done", F.col("done") | F.coalesce("__done", F.lit(False))).drop("__done").select(*state.columns)


def counters(state: DataFrame) -> DataFrame:
    """One row of the totals: urls, finished, visits, errors."""
    return state.agg(F.count("*").alias("url_count"), F.count_if("done").alias("finish_count"), F.coalesce(F.sum("num_visit"), F.lit(0)).alias("visit_count"), F.coalesce(F.sum("num_error" if "num_error" in state.columns else "num_retry"), F.lit(0)).alias("error_count"))


def is_finished(state: DataFrame) -> bool:
    return state.where("NOT done").isEmpty()
