"""Inputs: seed lists, sitemaps, page tables; outputs: saved pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions.urls import download_path, normalized

FREQUENCIES = {"": 0, "always": 1, "hourly": 3600, "daily": 86400, "weekly": 7 * 86400, "monthly": 30 * 86400, "yearly": 365 * 86400, "never": (1 << 63) - 1}
_TIMES = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd", "yyyy-MM", "yyyy")


def seed_file(spark: SparkSession, path: str, offset: int = 1, limit: int | None = None) -> DataFrame:
    """URLs of a text file, one a line, without comments and empty lines; ``limit`` of them from the
    ``offset``-th (from 1) on, in the order of the file's lines (of several files, of their paths)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    lines = lines.where("trim(value) <> '' AND NOT startswith(value, '#')").select(F.trim("value").alias("url"), "f", "at", "n")
    if offset == 1 and limit is None:
        return lines.select("url")
    ordered = lines.orderBy("f", "at", "n").offset(offset - 1)
    return (ordered if limit is None else ordered.limit(limit)).select("url")


def seeds(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct normalized seeds at depth 0; a seed that isn't a URL, and a table without seeds, is an error."""
    if urls.isEmpty():
        raise ValueError("no seeds")
    n = normalized(F.col(url))
    return urls.select(F.when(n.isNull(), F.raise_error(F.concat(F.lit("bad seed "), F.coalesce(F.col(url), F.lit("null"))))).otherwise(n).alias("url"), F.lit(0).alias("depth")).dropDuplicates(["url"])


def frequency(text: Column) -> Column:
    """Nanoseconds between changes; never is the largest number, an unknown word an error."""
    table = F.create_map(*[F.lit(x) for k, v in FREQUENCIES.items() for x in (k, v if k == "never" else v * 1_000_000_000)])
    got = table[F.lower(F.trim(F.coalesce(text, F.lit(""))))]
    return F.when(got.isNull(), F.raise_error(F.concat(F.lit("unknown frequency "), text)).cast("long")).otherwise(got)


def w3c_time(text: Column) -> Column:
    """Timestamp of a date of any W3C precision, null where it is none."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in _TIMES])


def sitemap_rows(xml: DataFrame) -> DataFrame:
    """(loc, priority, changefreq ns, lastmod) of the columns of url elements."""
    return xml.select(F.trim("loc").alias("loc"), F.col("priority").cast("double").alias("priority"), frequency(F.col("changefreq")).alias("changefreq"), w3c_time(F.col("lastmod")).alias("lastmod"))


ELEMENT = "loc string, priority double, changefreq string, lastmod string"


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """URLs of sitemap files."""
    return sitemap_rows(spark.read.format("xml").option("rowTag", "url").schema(ELEMENT).load(path))


def sitemap_texts(rows: DataFrame, xml: str) -> DataFrame:
    """The same of a column of url elements."""
    parsed = rows.withColumn("__u", F.from_xml(F.col(xml), ELEMENT))
    return sitemap_rows(parsed.select("__u.*"))


def answers(pages: DataFrame) -> DataFrame:
    """(key, status, fails, error, html): what a table of pages answers for every normal URL.

    Of several pages with one normal URL the one whose URL is written first counts, of several with that the least
    ``page_id``, then the least row, so that every reading of a table gives the same. Columns that ``pages`` may have:
    ``page_id``, ``status`` (200 where null), ``fails``: how often a fetch gets 503 before that, and ``error``: the
    class (retry, error, fatal) of the error that handling the page ends in."""
    have = lambda c, kind, other: (F.coalesce(F.col(c).cast(kind), F.lit(other)) if c in pages.columns else F.lit(other).cast(kind)).alias(c)
    own = [F.col("page_id")] if "page_id" in pages.columns else []
    rows = pages.select(normalized(F.col("url")).alias("key"), F.struct("url", *own, have("status", "int", 200), have("fails", "int", 0), have("error", "string", None), F.col("html")).alias("r"))
    return rows.where("key IS NOT NULL").groupBy("key").agg(F.min("r").alias("r")).select("key", "r.status", "r.fails", "r.error", "r.html")


def fetch(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """``frontier`` (url, ...) with (status, html) of a page table; 404 where it has none."""
    held = answers(pages).select(F.col("key").alias("url"), "status", "html")
    return frontier.join(held, "url", "left").withColumn("status", F.coalesce("status", F.lit(404)))


def save_pages(pages: DataFrame, root: str, url: str = "url", html: str = "html") -> int:
    """Write every page once under its download path; pages saved before stay. The number written.

    The table of a run is partitioned by host; the path is a column, as stores of many small files
    serve no reader."""
    spark = pages.sparkSession
    rows = pages.select(F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1).alias("host"), download_path(F.col(url)).alias("path"), F.col(html).alias("html")).dropDuplicates(["path"])
    target = spark._jvm.org.apache.hadoop.fs.Path(root)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        rows = rows.join(spark.read.parquet(root).select("path"), "path", "left_anti")
    from hopweave.sources.storage import cut

    rows = cut(rows)
    rows.write.mode("append").partitionBy("host").parquet(root)
    return rows.count()
