"""Queries of the crawl's state, its responses and its rules."""

from __future__ import annotations

import gzip
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions import content, freshness, urls
from hopweave.operators import dedup, frontier, links, pacing, state, stats
from hopweave.operators.rules import PAGE_FILES, Pattern, Routes, depth_score
from hopweave.plans.base import HOST, HOUR, LINKS, NORMAL, PATH, linked, query, table
from hopweave.sources import readers
from hopweave.sources.storage import URL_STATE, StateStore, workspace
from hopweave.streaming import flows

DAY = 24 * HOUR


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _store(spark: SparkSession) -> StateStore:
    return StateStore(spark, f"{workspace(spark)}/states-{uuid.uuid4().hex}")


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that answer in all ways: well, after two failures, always with an error of either kind, and with
    handling that ends in an error."""
    n = F.col("page_id") % 10
    return _pages(spark, sf_dir).select("page_id", "url", "html", F.when(n == 3, 500).when(n == 4, 404).when(n == 6, 403).otherwise(200).alias("status"), F.when(n == 5, 2).otherwise(0).alias("fails"), F.when(n == 7, "error").alias("error"))


#: State of every URL after a crawl of ``_site``, in columns that tell the rules apart.
STATES = f"""
WITH first_pages AS (SELECT *, page_id % 10 AS n FROM pages QUALIFY row_number() OVER (PARTITION BY {NORMAL} ORDER BY url) = 1),
good AS (SELECT * FROM first_pages WHERE n NOT IN (3, 4, 6)),
{LINKS.replace("FROM pages", "FROM good")},
k AS (SELECT {NORMAL} AS url, n FROM first_pages),
s AS (
  SELECT url, 0 AS depth, CASE n WHEN 3 THEN 500 WHEN 4 THEN 404 WHEN 6 THEN 403 ELSE 200 END AS status, (n NOT IN (3, 4, 6, 7))::INTEGER AS num_visit,
         CASE WHEN n IN (3, 6) THEN 4 ELSE 0 END AS num_retry, CASE WHEN n IN (3, 6) THEN 4 WHEN n = 5 THEN 2 WHEN n IN (4, 7) THEN 1 ELSE 0 END AS num_error,
         CASE WHEN n = 5 THEN 20 WHEN n NOT IN (3, 4, 6, 7) THEN 0 END AS last_s
  FROM k
  UNION ALL SELECT url, 1, 404, 0, 0, 1, NULL FROM (SELECT DISTINCT link AS url FROM links) WHERE url NOT IN (SELECT url FROM k)
)
SELECT url, depth, true AS done, status, num_visit, num_retry, num_error, epoch_us(TIMESTAMP '2024-01-01' + to_seconds(last_s)) AS last_us FROM s"""


def _told(states: DataFrame) -> DataFrame:
    return states.select("url", "depth", "done", "status", "num_visit", "num_retry", "num_error", F.unix_micros("last").alias("last_us"))


@query(STATES)
def crawl_states(spark, sf_dir):
    site = _site(spark, sf_dir)
    return _told(frontier.crawl(spark, site, site.select("url")))


@query(STATES + " UNION ALL SELECT 'http://old.example.org/', 3, true, 200, 7, 0, 0, NULL")
def crawl_resume(spark, sf_dir):
    """The same crawl, stopped after one wave and again after the next, beside a URL that was done before."""
    site, store = _site(spark, sf_dir), _store(spark)
    store.save(spark.createDataFrame([("http://old.example.org/", "old.example.org", 3, True, 200, 7, 0, 0)], "url string, host string, depth int, done boolean, status int, num_visit int, num_retry int, num_error int"))
    frontier.crawl(spark, site, site.select("url"), store=store, waves=1)
    frontier.crawl(spark, site, None, store=store, resume=True, waves=1)
    return _told(frontier.crawl(spark, site, None, store=store, resume=True))


class _Twice(frontier.Controller):
    """Pages of even length are visited twice, an hour after the first visit was due; of hosts of an odd length none."""

    def prepare(self, url: Column) -> Column:
        return F.length(urls.part(url, "host")) % 2 == 1

    def resched(self, url: Column, num_visit: Column) -> Column:
        return (F.length(url) % 2 == 0) & (num_visit < 2)

    def wanted(self, url: Column, at: Column) -> Column:
        return at + F.expr("INTERVAL 1 HOUR")

    def sched(self, url: Column, depth: Column) -> Column:
        return depth_score(depth)


@query(f"WITH k AS (SELECT DISTINCT {NORMAL} AS url FROM pages), s AS (SELECT url, length({HOST}) % 2 = 0 AS sent, length(url) % 2 = 0 AS twice FROM k) SELECT url, true AS done, CASE WHEN sent THEN 200 END AS status, CASE WHEN NOT sent THEN 0 WHEN twice THEN 2 ELSE 1 END AS num_visit, CASE WHEN sent THEN epoch_us(CASE WHEN twice THEN TIMESTAMP '2024-01-01 01:00:00' ELSE TIMESTAMP '2024-01-01' END) END AS last_us, 1000 AS score FROM s")
def crawl_revisits(spark, sf_dir):
    p = _pages(spark, sf_dir).select("page_id", "url", "html")
    out = frontier.crawl(spark, p, p.select("url"), ctrl=_Twice(), max_depth=0)
    return _told(out.withColumn("depth", F.col("score"))).select("url", "done", "status", "num_visit", "last_us", F.col("depth").alias("score"))


@query(f"SELECT DISTINCT {NORMAL} AS url, 0 AS depth FROM pages")
def seed_urls(spark, sf_dir):
    return readers.seeds(_pages(spark, sf_dir).select("url"))


@query("SELECT url FROM pages QUALIFY row_number() OVER (ORDER BY page_id) >= 11")
def seed_lines(spark, sf_dir):
    """A written seed file from its 11th line on."""
    path = f"{workspace(spark)}/seeds-{uuid.uuid4().hex}"
    _pages(spark, sf_dir).orderBy("page_id").select("url").coalesce(1).write.text(path)
    return readers.seed_file(spark, path, offset=11)


@query(f"SELECT url, min(depth)::INTEGER AS depth FROM (SELECT {NORMAL} AS url, CASE WHEN page_id % 2 = 0 THEN 5 ELSE 0 END AS depth FROM pages) GROUP BY url HAVING max(depth) = 0 UNION ALL SELECT DISTINCT {NORMAL}, 5 FROM pages WHERE page_id % 2 = 0")
def enqueued_urls(spark, sf_dir):
    """All pages enqueued where those of even ids are stored at depth 5 already."""
    p, store = _pages(spark, sf_dir), _store(spark)
    store.save(p.where("page_id % 2 = 0").select(urls.normalized(F.col("url")).alias("url"), F.lit(5).alias("depth"), F.lit(False).alias("done")).distinct())
    frontier.enqueue(store, p.select("url"))
    return store.load().select("url", "depth")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state of every page's URL, with values of its id."""
    p = _pages(spark, sf_dir).groupBy(urls.normalized(F.col("url")).alias("url")).agg(F.min("page_id").alias("i"))
    i = F.col("i")
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + i)
    return p.select("url", urls.part(F.col("url"), "host").alias("host"), (i % 7).cast("int").alias("depth"), (i % 2 == 0).alias("done"), F.lit(200).alias("status"), F.when(i % 3 > 0, stamp).alias("last"), (i % 3).cast("int").alias("num_visit"), (i % 5).cast("int").alias("num_retry"), (i % 4).cast("int").alias("num_error"), stamp.alias("next_at"), (i % 9).cast("int").alias("score"))


_I = f"i AS (SELECT {NORMAL} AS url, min(page_id) AS i FROM pages GROUP BY 1)"


@query(f"WITH {_I}, {LINKS}, q AS (SELECT DISTINCT {NORMAL} AS url FROM links) SELECT url, (i % 7)::INTEGER AS depth, (i % 3)::INTEGER AS num_visit, (i % 4)::INTEGER AS num_error, CASE WHEN i % 3 > 0 THEN (1700000000 + i) * 1000000 END AS last_us FROM q JOIN i USING (url)")
def call_context(spark, sf_dir):
    """What calls for the pages that have links may ask."""
    items = linked(spark, sf_dir).select(urls.normalized(F.col("url")).alias("url")).distinct()
    return state.context(items, _states(spark, sf_dir)).withColumn("last_us", F.unix_micros("last")).drop("last")


@query(f"WITH {_I} SELECT url, (i % 7)::INTEGER AS depth FROM i")
def state_depths(spark, sf_dir):
    return state.depths(_pages(spark, sf_dir).select(urls.normalized(F.col("url")).alias("url")), _states(spark, sf_dir))


@query(f"WITH {LINKS} SELECT DISTINCT link AS url FROM links")
def known_urls(spark, sf_dir):
    """Which of all pages and links are in a store of the links."""
    found = linked(spark, sf_dir).select(F.col("link").alias("url")).distinct()
    every = found.union(_pages(spark, sf_dir).select(urls.normalized(F.col("url")))).distinct()
    return state.exists(every, found)


@query(f"WITH {_I} SELECT bool_and(i % 2 = 0) AS all_done, true AS even_done FROM i")
def finished(spark, sf_dir):
    s = _states(spark, sf_dir)
    return spark.createDataFrame([(state.is_finished(s), state.is_finished(s.where("done")))], "all_done boolean, even_done boolean")


@query(f"WITH {_I} SELECT url, (i % 7)::INTEGER AS depth, i % 2 = 0 AS done, (i % 3)::INTEGER AS num_visit, CASE WHEN i % 3 > 0 THEN (1700000000 + i) * 1000000 END AS last_us FROM i")
def state_records(spark, sf_dir):
    """States to JSON and back."""
    back = state.decode(state.encode(_states(spark, sf_dir)), URL_STATE)
    return back.select("url", "depth", "done", "num_visit", F.unix_micros("last").alias("last_us"))


@query(f"WITH {_I}, q AS (SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {HOST} AS host, {PATH} AS path, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')), '&') AS query, i, url FROM i) SELECT scheme, host, path, query, (arg_min(i, url) % 7)::INTEGER AS depth FROM q GROUP BY ALL")
def state_keys(spark, sf_dir):
    return state.four_part(_states(spark, sf_dir)).select("scheme", "host", "path", "query", "depth")


@query(f"SELECT page_id, replace({NORMAL}, '.example.', '.xn--exmple-cua.') AS url FROM pages")
def host_names(spark, sf_dir):
    """Hosts of other letters."""
    return _pages(spark, sf_dir).select("page_id", urls.normalized(F.replace(F.col("url"), F.lit(".example."), F.lit(".exämple."))).alias("url"))


@query("SELECT page_id, ['text/html; charset=utf-8', 'text/plain; charset=utf-8', 'application/pdf', 'text/xml; charset=utf-8', NULL][page_id % 5 + 1] AS content_type, CASE WHEN page_id % 5 = 4 THEN 'error' END AS error FROM pages")
def content_sniff(spark, sf_dir):
    """Types by the first bytes of whole pages, bare, after a word, as a document's, and of none."""
    body = F.expr("CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN 'text ' || html WHEN 2 THEN '%PDF-1.7' || html WHEN 3 THEN '<?xml version=\"1.0\"?>' || html ELSE '' END").cast("binary")
    return _pages(spark, sf_dir).select("page_id", body.alias("b")).select("page_id", content.sniffed(content.previewed(F.col("b"))).alias("content_type"), content.preview_error(F.col("b")).alias("error"))


_TYPES = "array('Text/HTML; Charset=GBK', 'text/html;b=2;  a=1', 'application/XHTML+xml', 'text/plain; name=\"a b\"', 'no type; x')"


@query("SELECT page_id, ['text/html; charset=GBK', 'text/html; a=1; b=2', 'application/xhtml+xml', 'text/plain; name=\"a b\"', 'no type; x'][page_id % 5 + 1] AS content_type, page_id % 5 < 3 AS is_html FROM pages")
def media_types(spark, sf_dir):
    t = F.expr(f"{_TYPES}[page_id % 5]")
    return _pages(spark, sf_dir).select("page_id", content.canonical_type(t).alias("content_type"), content.is_html(t).alias("is_html"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/html; charset=gbk' WHEN 1 THEN 'text/html; charset=gbk' WHEN 2 THEN 'text/html; charset=utf-8' ELSE 'application/octet-stream' END AS content_type, page_id % 4 <> 3 AS certain FROM pages")
def page_types(spark, sf_dir):
    """A page's own type against one that is certain or not, and with a character set or not."""
    known = F.expr("array('text/html', 'text/html', 'text/html; charset=utf-8', 'application/octet-stream')[page_id % 4]")
    meta = F.expr("CASE WHEN page_id % 4 < 3 THEN '<meta http-equiv=\"Content-Type\" content=\"Text/HTML;charset=GBK\">' ELSE '' END || html")
    rows = _pages(spark, sf_dir).select("page_id", known.alias("t"), (F.col("page_id") % 4).isin(1, 2).alias("sure"), content.page_meta(meta).alias("m"))
    return rows.select("page_id", content.page_type(F.col("t"), F.col("sure"), F.col("m.content_type")).alias("p")).select("page_id", "p.*")


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/index' || page_id || '.html' AS content_location, 30::INTEGER AS refresh_seconds, CASE WHEN page_id % 3 > 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || '/en/next?p=' || page_id END AS refresh_url FROM pages")
def location_scan(spark, sf_dir):
    """Content-Location and Refresh headers, against where a request was redirected to for some."""
    i = F.col("page_id").cast("string")
    to = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.concat(F.lit("; url=next?p="), i)).otherwise(F.concat(F.lit(", URL = /en/next?p="), i))
    heads = F.create_map(F.lit("content-location"), F.concat(F.lit("/./x/../index"), i, F.lit(".html")), F.lit("refresh"), F.concat(F.lit("30"), to))
    new = F.when(F.col("page_id") % 3 == 1, F.concat(urls.site(F.col("url"), "/en/here")))
    return _pages(spark, sf_dir).select("page_id", content.locations(heads, F.col("url"), new).alias("l")).select("page_id", "l.*")


@query("SELECT page_id, ['utf-8', 'gbk', 'utf-16be', 'utf-8', 'koi8-r', 'utf-8'][page_id % 6 + 1] AS charset, page_id % 6 NOT IN (0, 3) AS certain FROM pages")
def charset_decide(spark, sf_dir):
    """By meta tag, media type, byte order mark, the bytes alone, and what the crawl says of a host where nothing is known."""
    body = F.expr("CASE page_id % 6 WHEN 0 THEN encode(html, 'UTF-8') WHEN 1 THEN encode(html, 'UTF-8') WHEN 2 THEN encode(html, 'UTF-16') WHEN 3 THEN encode('<html>für ' || page_id, 'UTF-8') ELSE encode('<html>plain ' || page_id, 'UTF-8') END")
    kind = F.expr("CASE page_id % 6 WHEN 1 THEN 'text/html; charset=GB2312' ELSE 'text/html' END")
    asked = F.expr("CASE WHEN page_id % 6 = 4 THEN 'koi8-r' ELSE 'utf-8' END")
    return _pages(spark, sf_dir).select("page_id", content.charset(body, kind, asked).alias("c")).select("page_id", "c.*")


@query("SELECT page_id, md5(html) AS text_md5, length(html) AS n_chars FROM pages")
def body_decode(spark, sf_dir):
    """Whole pages back from bodies that are zipped, deflated or plain, in UTF-8 or UTF-16 with its mark."""

    @F.arrow_udf("binary")
    def packed(b: pa.Array, how: pa.Array) -> pa.Array:
        ways = {"gzip": gzip.compress, "deflate": zlib.compress, "raw": lambda x: zlib.compress(x)[2:-4]}
        return pa.array([ways.get(h, bytes)(x) for x, h in zip(b.to_pylist(), how.to_pylist())], pa.binary())

    how = F.expr("array('gzip', 'deflate', 'raw', 'identity')[page_id % 4]")
    body = F.expr("CASE WHEN page_id % 3 = 0 THEN encode(html, 'UTF-16') ELSE encode(html, 'UTF-8') END")
    sent = F.when(how == "raw", "deflate").otherwise(how)
    text = content.body_text(packed(body, how), sent, F.lit("utf-8"))
    return _pages(spark, sf_dir).select("page_id", text.alias("t")).select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query(f"WITH {LINKS} SELECT {HOST} AS host, 900::INTEGER AS score, count(*) AS n FROM links GROUP BY 1")
def depth_scores(spark, sf_dir):
    return linked(spark, sf_dir).select(urls.part(F.col("url"), "host").alias("host"), depth_score(F.lit(1)).alias("score")).groupBy("host", "score").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/go/' || page_id AS link FROM pages")
def script_locations(spark, sf_dir):
    """Assignments in scripts of whole pages. The pages have none, so a last script makes one."""
    html = F.concat("html", F.lit("<script>var a = 1; window.location.href = '/go/"), F.col("page_id").cast("string"), F.lit("'</script><p>location = '/no'</p>"))
    found = links.extracted(_pages(spark, sf_dir).select("page_id", "url", html.alias("html")), scripts=True)
    return found.where("tag = 'script'").select("page_id", "link")


_MOVED = "r AS (SELECT url, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '/new' END AS new_url, CASE WHEN page_id % 3 = 0 THEN url || '/next' END AS refresh_url FROM pages)"


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("url", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/new"))).alias("new_url"), F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/next"))).alias("refresh_url"))


@query(f"WITH {_MOVED} SELECT url, new_url AS link FROM r WHERE new_url <> url UNION ALL SELECT url, refresh_url FROM r WHERE refresh_url IS NOT NULL")
def redirect_links(spark, sf_dir):
    return links.redirects(_moved(spark, sf_dir))


@query(f"WITH {_MOVED} SELECT url, new_url AS link FROM r UNION ALL SELECT url, refresh_url FROM r WHERE refresh_url IS NOT NULL")
def redirects_extracted(spark, sf_dir):
    return links.redirects(_moved(spark, sf_dir), always=True)


@query(f"WITH h AS (SELECT page_id, url, {HOST} AS host FROM pages), l AS (SELECT page_id, url, host, unnest(['www.' || host, 'www.example.org', 'm.other.example.net', 'x.' || regexp_extract(host, '[^.]+[.][^.]+$')]) AS other, unnest(['/a', '/b', '/c', '/d']) AS path FROM h) SELECT page_id, other AS link_host FROM l WHERE (other = host OR regexp_extract(other, '[^.]+[.][^.]+$') = regexp_extract(host, '[^.]+[.][^.]+$') OR regexp_matches(other, '^m[.]')) AND path <> '/a'")
def scope_rules(spark, sf_dir):
    """Links to other hosts: of the same domain, or accepted by a host rule; then the directory rules."""
    host = urls.part(F.col("url"), "host")
    others = F.array(F.concat(F.lit("www."), host), F.lit("www.example.org"), F.lit("m.other.example.net"), F.concat(F.lit("x."), F.regexp_extract(host, "[^.]+[.][^.]+$", 0)))
    rows = _pages(spark, sf_dir).select("page_id", "url", F.posexplode(others).alias("i", "link_host"))
    link = F.concat(urls.part(F.col("url"), "scheme"), F.lit("://"), F.col("link_host"), F.lit("/"), F.element_at(F.array(*map(F.lit, "abcd")), F.col("i") + 1))
    rule = Pattern(exclude_file=["a"])
    by_host = Pattern(host=["m.**"])
    ok = links.in_scope(F.col("url"), F.col("link"), F.lit(0), rule, span_hosts=True, sub_domains=True, shared_address=by_host.part(F.col("link"), "host"))
    # the rule of the scope itself has no host part, so hosts that it would accept are those of by_host
    related = (urls.part(F.col("url"), "host") == F.col("link_host")) | urls.same_domain(urls.part(F.col("url"), "host"), F.col("link_host")) | by_host.part(F.col("link"), "host")
    return rows.withColumn("link", link).where(ok & related).select("page_id", "link_host")


@query(f"SELECT page_id, regexp_matches({HOST}, '^blog[.]') AS host_ok, regexp_matches({PATH}, '^/en/') AS dir_ok, true AS file_ok, false AS other_ok FROM pages")
def match_parts(spark, sf_dir):
    p, u = Pattern(host=["blog.**"], dir=["/en/**"]), F.col("url")
    return _pages(spark, sf_dir).select("page_id", *[p.part(u, x).alias(f"{x}_ok") for x in ("host", "dir", "file", "other")])


def _routes() -> Routes:
    r = Routes()
    r.allow("http*/en/*")
    r.disallow("~ [?]page=")
    r.allow("= https://none.example.com/")
    r.nofollow.add("http*/de/*", True)
    r.depth.add("http*/es/*", 2)
    r.depth.add("http*/en/*", 3)
    r.score.add("http*/fr/*", 7)
    r.visits.add("http*/en/*", 3)
    r.interval.add("blog.*", HOUR)
    r.client.add("https*", "tls")
    return r


@query(f"WITH u AS (SELECT page_id, {NORMAL} AS url FROM pages), r AS (SELECT *, regexp_matches(url, '/en/') AS en, regexp_matches(url, '/de/') AS de, regexp_matches(url, '/es/') AS es FROM u) SELECT page_id, en AND NOT regexp_matches(url, '[?]page=') AS admitted, NOT de AND CASE WHEN es THEN page_id % 4 < 2 WHEN en THEN page_id % 4 < 3 ELSE true END AS followed, CASE WHEN regexp_matches(url, '/fr/') THEN 7 ELSE 0 END AS score, en AND page_id % 5 < 3 AS visited_again, CASE WHEN starts_with({HOST}, 'blog.') THEN {HOUR} ELSE 5 END::BIGINT AS interval_us, CASE WHEN starts_with(url, 'https') THEN 'tls' END AS client FROM r")
def crawl_routes(spark, sf_dir):
    """All tables of a crawl's routes."""
    r, u = _routes(), F.col("url")
    p = _pages(spark, sf_dir).select("page_id", urls.normalized(u).alias("url"))
    return p.select(
        "page_id", r.admit.allowed(u).alias("admitted"), r.follows(u, (F.col("page_id") % 4).cast("int")).alias("followed"), r.ticket(u).alias("score"), r.again(u, (F.col("page_id") % 5).cast("int")).alias("visited_again"),
        r.spacing(urls.part(u, "host"), 5).alias("interval_us"), r.request(u)["client"].alias("client"),
    )


@query(f"WITH f AS (SELECT page_id, regexp_extract({PATH}, '[^/]*$') AS file FROM pages) SELECT page_id, NOT contains(file, '.') OR regexp_matches(file, '[.]html?$') AS is_page FROM f")
def page_files(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", PAGE_FILES.part(F.col("url"), "file").alias("is_page"))


@query(f"WITH h AS (SELECT {HOST} AS host, page_id FROM pages) SELECT host, count(*) AS urls, count(*) FILTER (page_id % 3 = 0) AS depth_0, count(*) FILTER (page_id % 3 = 1) AS depth_1, count(*) FILTER (page_id % 2 = 0) AS responses, count(*) FILTER (page_id % 2 = 0 AND page_id % 3 = 1) AS responses_1, count(*) FILTER (page_id % 5 = 0) AS marks_x FROM h GROUP BY host")
def host_profiles(spark, sf_dir):
    h = _pages(spark, sf_dir).select(urls.part(F.col("url"), "host").alias("host"), (F.col("page_id") % 3).cast("int").alias("depth"), "page_id")
    out = stats.host_profile(h, h.where("page_id % 2 = 0"), h.select("host", F.when(F.col("page_id") % 5 == 0, "x").otherwise("y").alias("key")))
    of = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0).cast("long"))
    return out.select("host", "urls", of(F.col("depths"), 0).alias("depth_0"), of(F.col("depths"), 1).alias("depth_1"), "responses", of(F.col("response_depths"), 1).alias("responses_1"), of(F.col("marks"), "x").alias("marks_x"))


@query(f"WITH {LINKS} SELECT link, count(*) AS n FROM links GROUP BY link")
def link_multiset(spark, sf_dir):
    return linked(spark, sf_dir).groupBy("link").agg(F.count("*").alias("n"))


@query(f"SELECT 'site/' || {HOST} AS root, count(*) AS n, sum(length(html)) AS n_chars FROM pages GROUP BY 1")
def saved_pages(spark, sf_dir):
    """Pages saved in two goes, of which the second finds some saved; then read back."""
    root = f"{workspace(spark)}/saved-{uuid.uuid4().hex}"
    p = _pages(spark, sf_dir).withColumn("url", F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&i=").otherwise("?i="), F.col("page_id").cast("string")))
    readers.save_pages(p.where("page_id % 3 = 0"), root)
    readers.save_pages(p, root)
    back = spark.read.parquet(root)
    return back.groupBy(F.concat(F.lit("site/"), "host").alias("root")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("n_chars"))


_HEADS = "CASE event_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN '' WHEN 2 THEN 'max-age=7' ELSE 'no-cache' END"


@query(f"""
WITH e AS (SELECT event_id, {_HEADS} AS cc, event_id % 100 - 20 AS left_s FROM events),
c AS (SELECT *, CASE event_id % 4 WHEN 2 THEN 7 WHEN 3 THEN 0 ELSE greatest(0, left_s) END AS life, CASE WHEN event_id % 4 = 1 THEN NULL ELSE true END AS headed FROM e)
SELECT event_id, life::BIGINT AS max_age, (greatest(5, event_id % 9) + 30)::BIGINT AS age_s, event_id % 4 = 3 OR greatest(5, event_id % 9) + 30 > life AS stale, headed IS NOT NULL AS cacheable_compat FROM c
""")
def response_freshness(spark, sf_dir):
    """Lifetime with Expires, age and validity; ``compat`` leaves Expires out where there is no Cache-Control."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_HEADS).alias("cc"), F.col("ts").cast("timestamp").alias("date"))
    after = lambda c, s: c + F.make_dt_interval(secs=s)
    expires = after(F.col("date"), F.col("event_id") % 100 - 20)
    received = after(F.col("date"), F.lit(5))
    now = after(received, F.lit(30))
    c = freshness.control(F.lit(200), F.col("cc"), F.col("date"), expires)
    old = freshness.control(F.lit(200), F.col("cc"), F.col("date"), expires, compat=True)
    rows = e.select("event_id", c.alias("c"), freshness.age(F.col("date"), received, (F.col("event_id") % 9).cast("long"), now).alias("age_s"), old["cacheable"].alias("cacheable_compat"))
    return rows.select("event_id", "c.max_age", "age_s", freshness.needs_validation(F.col("c.cache_type"), F.col("c.max_age"), F.col("age_s")).alias("stale"), "cacheable_compat")


_ASKED = f"""
o AS (
  SELECT user_id::VARCHAR AS key, event_id AS nth, epoch_ms(ts) AS at_ms, 'v' || (epoch_ms(ts) // {DAY * 10 // 1000}) AS etag, user_id % 3 AS kind,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k, event_type <> 'error' AS ok, event_type <> 'click' AS got
  FROM events
)"""


@query(f"""
WITH RECURSIVE {_ASKED},
r AS (
  SELECT key, nth, k, true AS server_hit, false AS not_modified, etag AS served, CASE WHEN ok AND got AND kind <> 2 THEN etag END AS held, at_ms AS held_at FROM o WHERE k = 1
  UNION ALL
  SELECT o.key, o.nth, o.k,
         NOT (got AND held IS NOT NULL AND kind = 0 AND at_ms - held_at <= {DAY // 1000}),
         got AND held IS NOT NULL AND held = etag AND NOT (kind = 0 AND at_ms - held_at <= {DAY // 1000}),
         CASE WHEN got AND held IS NOT NULL AND kind = 0 AND at_ms - held_at <= {DAY // 1000} THEN held ELSE etag END,
         CASE WHEN NOT got OR held IS NOT NULL AND (kind = 0 AND at_ms - held_at <= {DAY // 1000} OR held = etag) OR NOT ok THEN held WHEN kind = 2 THEN NULL ELSE etag END,
         CASE WHEN NOT got OR held IS NOT NULL AND kind = 0 AND at_ms - held_at <= {DAY // 1000} OR (held IS NULL OR held <> etag) AND NOT ok THEN held_at ELSE at_ms END
  FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1
)
SELECT key, nth, server_hit, not_modified, served FROM r
""")
def http_revalidate(spark, sf_dir):
    """Users as URLs: a day fresh, to be asked for each time, or not to be stored; clicks aren't GET, errors are 500."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("user_id") % 3
    asked = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("nth"), ms.alias("at_ms"), F.when(F.col("event_type") == "click", "POST").otherwise("GET").alias("method"), F.concat(F.lit("v"), F.floor(ms / (DAY * 10 // 1000)).cast("string")).alias("etag"),
        F.when(kind == 0, f"max-age={24 * 3600}").when(kind == 1, "no-cache").otherwise("no-store").alias("cache_control"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.lit(0).alias("age"),
    )
    return freshness.revalidated(asked)


@query("SELECT user_id, max(ts) AS date, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def pool_update(spark, sf_dir):
    """The response of every URL that stays where an older Date never replaces a newer one."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("date"), "event_id")
    return freshness.replaced(e, "user_id", "date").select("user_id", "date", "event_id")


def limits(host, asked: int) -> tuple[int, int]:
    """Interval and burst of a host, asked for the so manieth time."""
    return (6 + 3 * (asked % 3)) * HOUR, 2


@query()
def updatable_limit(spark, sf_dir):
    """Delays by a bucket whose interval is asked for anew after every 20 events of a host."""
    return pacing.updatable_wait(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", limits, 20)


@query()
def stream_limit(spark, sf_dir):
    """The same as a stream."""
    return flows.drain(flows.limited_stream(flows.table_stream(spark, sf_dir, "events"), "user_id", "ts", "event_id", limits, 20), spark)
