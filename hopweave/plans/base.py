"""Registration of queries, and SQL that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hopweave.operators import links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000_000


def query(sql: str | None = None):
    """Register a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
NORMAL = "rtrim(regexp_replace(url, '#.*$', ''), '?')"
_CHARS = "array_to_string(list_transform(string_split(path, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9_.~$&+,/:;=@-]$') THEN c ELSE url_encode(c) END), '')"
LINKS = f"""
refs AS (
  SELECT page_id, url, unnest(range(len(r))) AS nth, unnest(r) AS href
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS r FROM pages)
),
plain AS (
  SELECT page_id, url, nth, replace(replace(replace(replace(href, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS h FROM refs
),
cut AS (SELECT *, regexp_extract(h, '^[^?#]*') AS path, regexp_extract(h, '^[^?#]*\\?([^#]*)', 1) AS q FROM plain),
links AS (
  SELECT page_id, url, nth,
         regexp_extract(url, '^[a-z]+://[^/?#]*')
         || CASE WHEN regexp_matches(path, '^([A-Za-z0-9_.~!$&''()*+,;=:@/\\[\\]-]|%[0-9A-Fa-f][0-9A-Fa-f])*$') THEN path ELSE {_CHARS} END
         || CASE WHEN q = '' THEN '' ELSE '?' || q END AS link
  FROM cut WHERE NOT regexp_matches(path, '%([^0-9A-Fa-f]|$|.([^0-9A-Fa-f]|$))')
)"""
#: Letter pairs whose numbers of occurrences, odd or even, make up 64 bits of a text.
LETTERS = "etaoinsr"
PAIRS = [x + y for x in LETTERS for y in LETTERS]


def _half(k: int) -> str:
    return " + ".join(f"(((length(text) - length(replace(text, '{g}', ''))) // 2) % 2) * {1 << i}" for i, g in enumerate(PAIRS[32 * k : 32 * k + 32]))


#: Documents with the lower and the upper half of these bits.
BITS = f"bits AS (SELECT doc_id, {_half(0)} AS lo, {_half(1)} AS hi FROM documents)"


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages."""
    return links.page_links(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
