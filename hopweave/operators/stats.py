"""Counters of hosts and the cut-off of hosts full of similar pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def host_counts(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """(host, urls, responses, similar) of tables (host, depth) and (host, depth, similar)."""
    a = urls.groupBy("host").agg(F.count("*").alias("urls"))
    b = responses.groupBy("host").agg(F.count("*").alias("responses"), F.count_if("similar").alias("similar"))
    return a.join(b, "host", "full_outer").na.fill(0, ["urls", "responses", "similar"])


def depth_histogram(rows: DataFrame) -> DataFrame:
    """(host, depth, n)."""
    return rows.groupBy("host", "depth").agg(F.count("*").alias("n"))


def histogram_map(rows: DataFrame) -> DataFrame:
    """(host, depths): the same as a map."""
    return depth_histogram(rows).groupBy("host").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("depth", "n")))).alias("depths"))


def host_profile(urls: DataFrame, responses: DataFrame, marks: DataFrame) -> DataFrame:
    """(host, urls, depths, marks, responses, response_depths) of tables (host, depth), (host, depth) and (host, key):
    counters of a host, with maps of how many URLs and responses are at every depth, and of its keys."""

    def total(rows: DataFrame, key: str, name: str, count: str | None) -> DataFrame:
        each = rows.groupBy("host", key).agg(F.count("*").alias("n"))
        out = [F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name)]
        return each.where(F.col(key).isNotNull()).groupBy("host").agg(*out, *([F.sum("n").alias(count)] if count else []))

    parts = [total(urls, "depth", "depths", "urls"), total(responses, "depth", "response_depths", "responses"), total(marks, "key", "marks", None)]
    out = parts[0].join(parts[1], "host", "full_outer").join(parts[2], "host", "full_outer").na.fill(0, ["urls", "responses"])
    return out.select("host", "urls", "depths", "marks", "responses", "response_depths")


def cut_off(responses: DataFrame, host: str, order: list[str], similar: str, more_than: int = 500) -> DataFrame:
    """``responses`` with running ``seen`` and ``alike`` and ``cancelled``: whether the host had been given up
    before, after more than ``more_than`` responses of which over half were similar."""
    w = Window.partitionBy(host).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = responses.withColumn("seen", F.count("*").over(run)).withColumn("alike", F.sum(F.col(similar).cast("int")).over(run))
    over = ((F.col("seen") > more_than) & (F.col("alike") * 2 > F.col("seen"))).cast("int")
    return out.withColumn("__o", over).withColumn("cancelled", F.coalesce(F.max("__o").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1).drop("__o")
