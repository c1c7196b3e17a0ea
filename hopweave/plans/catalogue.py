"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopweave.functions import content, freshness, urls
from hopweave.functions.html import ABSOLUTE
from hopweave.functions.letters import pair_bits
from hopweave.operators import dedup, frontier, links, pacing, requests, state, stats
from hopweave.operators.rules import Pattern, Router
from hopweave.plans.base import BITS, HOST, HOUR, LETTERS, LINKS, NORMAL, ORACLE_SQL, PATH, QUERIES, linked, query, table
from hopweave.sources import readers
from hopweave.streaming import flows


@query(f"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {HOST} AS host, {PATH} AS path, regexp_extract({PATH}, '^(.*/)?([^/]*)$', 1) AS dir, regexp_extract({PATH}, '^(.*/)?([^/]*)$', 2) AS file, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", *[urls.part(u, p).alias(p) for p in ("scheme", "host", "path", "dir", "file", "query")])


@query(f"SELECT page_id, {NORMAL} AS url FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized(F.col("url")).alias("url"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/robots.txt' AS robots, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/sitemap.xml' AS sitemap FROM pages")
def site_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.site(F.col("url")).alias("robots"), urls.site(F.col("url"), "/sitemap.xml").alias("sitemap"))


@query(f"WITH {LINKS} SELECT page_id, nth::INTEGER AS nth, link FROM links")
def pagelinked(spark, sf_dir):
    return linked(spark, sf_dir).select("page_id", "nth", "link")


@query(f"WITH {LINKS} SELECT {HOST} AS host, count(*) AS n_links, count(DISTINCT link) AS n_distinct FROM links GROUP BY 1")
def host_link_counts(spark, sf_dir):
    return linked(spark, sf_dir).groupBy(urls.part(F.col("url"), "host").alias("host")).agg(F.count("*").alias("n_links"), F.countDistinct("link").alias("n_distinct"))


@query(f"WITH {LINKS} SELECT page_id, nth::INTEGER AS nth, 'a' AS tag, link FROM links WHERE length(regexp_extract(link, '[^/]*$')) BETWEEN 2 AND 3")
def extractedlinked(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = links.extracted(pages)
    fits = links.in_scope(F.col("url"), F.col("link"), F.lit(0), Pattern(file=["??", "???"]), max_depth=2)
    return found.where(fits).select("page_id", "nth", "tag", "link")


@query(f"SELECT page_id, url FROM pages WHERE regexp_matches({PATH}, '^/(en|de)/') AND NOT regexp_matches({PATH}, '^/de/[^/]*$') AND NOT regexp_matches({PATH}, '[.]html$')")
def dir_pattern_filter(spark, sf_dir):
    p = Pattern(dir=["/{en,de}/**"], exclude_file=["/[.]html$/"], reject=["*//*/de/*"])
    return table(spark, sf_dir, "pages").where(p.match(F.col("url"))).select("page_id", "url")


@query(f"SELECT page_id, {HOST} AS host FROM pages WHERE (regexp_matches({HOST}, '^blog[.][^.]*[.]example[.](net|org)$') OR regexp_matches({HOST}, '^m[.]')) AND NOT regexp_matches({HOST}, 'th$|^m[.]a')")
def host_glob_filter(spark, sf_dir):
    p = Pattern(host=["blog.*.example.{net,org}", "/^m[.]/"], exclude_host=["/th$/", "m.a**"])
    return table(spark, sf_dir, "pages").where(p.match(F.col("url"))).select("page_id", urls.part(F.col("url"), "host").alias("host"))


@query(f"SELECT page_id, CASE WHEN {PATH} = '/en/25' THEN 9 WHEN regexp_matches({PATH}, '^/fr/8.*$') THEN 7 WHEN regexp_matches({PATH}, '[.]html$') THEN 5 WHEN regexp_matches({PATH}, '^/en/.*$') THEN 3 WHEN regexp_matches({PATH}, '^/.*$') THEN 1 END AS score FROM pages")
def router_score(spark, sf_dir):
    r = Router().add("/*", 1).add("/en/*", 3).add("~ [.]html$", 5).add("^~ /fr/8*", 7).add("= /en/25", 9)
    return table(spark, sf_dir, "pages").select("page_id", r.get(urls.part(F.col("url"), "path")).cast("int").alias("score"))


@query(f"WITH h AS (SELECT DISTINCT {HOST} AS host FROM pages), s AS (SELECT host, string_split(host, '.') AS l FROM h) SELECT a.host AS a, b.host AS b FROM s a JOIN s b ON a.host < b.host AND len(a.l) > 1 AND len(b.l) > 1 AND a.l[-2:] = b.l[-2:]")
def subdomain_pairs(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select(urls.part(F.col("url"), "host").alias("host")).distinct()
    keyed = h.select("host", F.split("host", "\\.").alias("l")).where(F.size("l") > 1).select("host", F.slice("l", -2, 2).alias("d"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.d") == F.col("b.d")) & (F.col("a.host") < F.col("b.host"))).where(urls.same_domain(F.col("a.host"), F.col("b.host")))
    return met.select(F.col("a.host").alias("a"), F.col("b.host").alias("b"))


@query(f"WITH h AS (SELECT DISTINCT {HOST} AS host FROM pages) SELECT host AS page_host, regexp_replace(host, '^[^.]*[.]', '') AS link_host, length(host) % 7 = length(regexp_replace(host, '^[^.]*[.]', '')) % 7 AS same_ip FROM h")
def same_ip(spark, sf_dir):
    """Whether hosts share an address with the domain above them, as links between the two are judged."""
    h = table(spark, sf_dir, "pages").select(urls.part(F.col("url"), "host").alias("page_host")).distinct().withColumn("link_host", F.regexp_replace("page_host", "^[^.]*[.]", ""))
    hosts = h.select(F.col("page_host").alias("host")).union(h.select("link_host")).distinct()
    return links.same_address(h, hosts.select("host", (F.length("host") % 7).cast("string").alias("ip")), "page_host", "link_host")


@query(f"WITH {LINKS} SELECT DISTINCT link AS url FROM links WHERE link NOT IN (SELECT {NORMAL} FROM pages)")
def seen_anti_join(spark, sf_dir):
    seen = table(spark, sf_dir, "pages").select(urls.normalized(F.col("url")).alias("url"))
    return dedup.unseen(linked(spark, sf_dir).select(F.col("link").alias("url")), seen)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, (value)::INTEGER DESC, event_id)::INTEGER AS position FROM (SELECT event_id, user_id, ts, floor(value) AS value FROM events)")
def priority_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("score", F.floor("value"))
    return pacing.ranked(e, "user_id", "ts", "score", "event_id").select("event_id", "position")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, 999 - greatest(0, least(999, floor(value * 20)::BIGINT)), event_id)::INTEGER AS position FROM events")
def clamped_priority(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("score", F.floor(F.col("value") * 20))
    return pacing.ranked(e, "user_id", "ts", "score", "event_id", "clamped").select("event_id", "position")


@query("SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15' AND value > 5 ORDER BY epoch_us(ts) // 1000, event_id LIMIT 500")
def due_wave(spark, sf_dir):
    """The next 500 due items, a worker pool's wave."""
    e = table(spark, sf_dir, "events").where("value > 5").withColumn("score", F.lit(0))
    return pacing.due(e, F.lit("2024-01-15").cast("timestamp_ntz"), "ts", "score", "event_id", most=500, order="fifo").select("event_id", "ts")


_K = "k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, floor(value) DESC, event_id) AS k, epoch_us(ts) AS t FROM events)"
SPACING = f"WITH {_K} SELECT user_id, event_id, (max(t - k * {10 * HOUR}) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) + k * {10 * HOUR})::BIGINT AS pop_us FROM k"


@query(SPACING)
def host_spacing(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("score", F.floor("value"))
    return pacing.spaced(e, "user_id", "ts", "score", "event_id", 10 * HOUR).select("user_id", "event_id", "pop_us")


@query(
    f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS t FROM events) SELECT event_id, greatest(0, max(t - (k - 1) * {10 * HOUR}) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) + k * {10 * HOUR} - t - 3 * {10 * HOUR})::BIGINT AS wait_us FROM k"
)
def token_bucket(spark, sf_dir):
    return pacing.bucket_wait(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 10 * HOUR, 3).select("event_id", "wait_us")


@query("""
WITH m AS (SELECT *, (event_type IN ('error', 'view'))::INTEGER AS f FROM events),
i AS (SELECT *, sum(1 - f) OVER w AS island FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS retry FROM i),
c AS (SELECT *, f = 1 AND retry >= 4 AS completed FROM r),
b AS (SELECT *, coalesce(sum(completed::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT user_id, event_id, retry::BIGINT AS retry, completed FROM b WHERE before = 0
""")
def retry_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return state.retries(e, "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view")).select("user_id", "event_id", "retry", "completed")


@query("SELECT event_id, epoch_us(greatest(ts + INTERVAL 1 HOUR, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR)) AS next_us FROM events")
def resched_floor(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = state.rescheduled(e, "user_id", "ts", ["ts", "event_id"], F.col("ts") + F.expr("INTERVAL 1 HOUR"), 6 * 3600)
    return out.select("event_id", pacing.micros(F.col("next_at")).alias("next_us"))


@query("WITH s AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 200 + (event_id % 4) * 100 + event_id % 7 END AS status FROM events) SELECT event_id, CASE WHEN status IS NULL THEN 'retry' WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status >= 500 OR (status BETWEEN 400 AND 499 AND status <> 404) THEN 'retry' ELSE 'error' END AS outcome FROM s")
def status_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 11 != 0, 200 + (F.col("event_id") % 4) * 100 + F.col("event_id") % 7)
    return e.select("event_id", state.outcome(status).alias("outcome"))


@query(f"WITH {LINKS}, a AS (SELECT {HOST} AS host, 0 AS depth FROM pages UNION ALL SELECT regexp_extract(link, '^[a-z]+://([^/?#]*)', 1), 1 FROM (SELECT DISTINCT link FROM links)) SELECT host, depth, count(*) AS n FROM a GROUP BY ALL")
def host_stats(spark, sf_dir):
    first = table(spark, sf_dir, "pages").select(urls.part(F.col("url"), "host").alias("host"), F.lit(0).alias("depth"))
    next_ = linked(spark, sf_dir).select("link").distinct().select(urls.part(F.col("link"), "host").alias("host"), F.lit(1).alias("depth"))
    return stats.depth_histogram(first.union(next_))


@query(f'''WITH u AS (SELECT {HOST} AS host, page_id FROM pages), r AS (SELECT host, page_id % 3 = 0 AS alike FROM u WHERE page_id % 2 = 0), a AS (SELECT host, count(*) AS urls FROM u GROUP BY 1), b AS (SELECT host, count(*) AS responses, count(*) FILTER (alike) AS "similar" FROM r GROUP BY 1) SELECT host, urls, coalesce(responses, 0) AS responses, coalesce("similar", 0) AS "similar" FROM a LEFT JOIN b USING (host)''')
def host_report(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select(urls.part(F.col("url"), "host").alias("host"), "page_id")
    return stats.host_counts(u, u.where("page_id % 2 = 0").select("host", (F.col("page_id") % 3 == 0).alias("similar")))


_CUT = "c AS (SELECT user_id, event_id, count(*) OVER w AS seen, sum((event_type IN ('view', 'click', 'error'))::INTEGER) OVER w AS alike FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"
CUT = f"WITH {_CUT} SELECT user_id, event_id, coalesce(bool_or(seen > 20 AND alike * 2 > seen) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cancelled FROM c"


def _similar(events: DataFrame) -> DataFrame:
    return events.withColumn("similar", F.col("event_type").isin("view", "click", "error"))


@query(CUT)
def host_cutoff(spark, sf_dir):
    return stats.cut_off(_similar(table(spark, sf_dir, "events")), "user_id", ["event_id"], "similar", 20).select("user_id", "event_id", "cancelled")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5")
def visit_limit(spark, sf_dir):
    return state.visits_left(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id")


def _admission(levels: int, base: int) -> str:
    """Levels of the shape tree one after the other: a step is {kind, depth, text}, ``base`` and its depth are a
    node's number of children."""
    steps = "list_transform(segs, lambda x, i: {'k': '/', 'd': i, 't': x}) || flatten(list_transform(list_sort(pairs), lambda p, i: [{'k': '?', 'd': len(segs) + i, 't': p[1]}, {'k': '=', 'd': len(segs) + i, 't': p[2]}]))"
    out = [
        f"u AS (SELECT page_id, {HOST} AS host, string_split({PATH}, '/')[2:] AS segs, list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: [split_part(x, '=', 1), regexp_replace(x, '^[^=]*=?', '')]) AS pairs FROM pages)",
        f"l0 AS (SELECT page_id, host AS node, {steps} AS s, true AS ok FROM u)",
    ]
    for d in range(1, levels + 1):
        out.append(f"f{d} AS (SELECT *, CASE WHEN ok AND len(s) >= {d} THEN min(page_id) FILTER (ok AND len(s) >= {d}) OVER (PARTITION BY node, s[{d}].k, s[{d}].t) END AS f FROM l{d - 1})")
        out.append(f"l{d} AS (SELECT page_id, node || chr(1) || coalesce(s[{d}].k || s[{d}].t, '') AS node, s, CASE WHEN f IS NULL THEN ok ELSE dense_rank() OVER (PARTITION BY node, s[{d}].k, f IS NULL ORDER BY f) <= {base} + s[{d}].d END AS ok FROM f{d})")
    return "WITH " + ",\n".join(out) + f"\nSELECT page_id, ok AS admitted FROM l{levels}"


@query(_admission(8, 1))
def url_shape_admission(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.part(F.col("url"), "host").alias("host"))
    return dedup.admit_shapes(p, "host", "url", "page_id", lambda d: 1 + d).select("page_id", "admitted")


@query()
def url_shape_lookup(spark, sf_dir):
    """Pages against the shapes of pages with an even id."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", urls.part(F.col("url"), "host").alias("host"))
    return dedup.has_shape(p, p.where("page_id % 2 = 0"), "host", "url", lambda d: 3).select("page_id", "found")


@query("SELECT page_id, CASE WHEN n <= 2 THEN 14 WHEN n > 6 THEN 2 ELSE 14 - 2 * n END::INTEGER AS most FROM (SELECT page_id, len(string_split(html, '<li>')) AS n FROM pages)")
def shape_thresholds(spark, sf_dir):
    n = F.size(F.split("html", "<li>"))
    deepest = 7
    most = F.element_at(F.array(*[F.lit(dedup.threshold(d)) for d in range(1, deepest + 1)]), F.least(n, F.lit(deepest)))
    return table(spark, sf_dir, "pages").select("page_id", most.alias("most"))


@query()
def structural_fingerprint(spark, sf_dir):
    """Of whole pages; 0 for those of 4,096 tokens or more, as the reference has it."""
    return table(spark, sf_dir, "pages").select("page_id", dedup.fingerprints(F.col("html"), whole=True).alias("fingerprint"))


def _bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 bits of every document: whether letter pairs occur an odd number of times."""
    return table(spark, sf_dir, "documents").select("doc_id", pair_bits(F.col("text"), LETTERS).alias("fp"))


@query(f"WITH {BITS}, r AS (SELECT lo, hi, min(doc_id) AS id FROM bits GROUP BY 1, 2), p AS (SELECT a.id AS a, b.id AS b, (bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)))::INTEGER AS distance FROM r a JOIN r b ON a.id < b.id) SELECT * FROM p WHERE distance <= 3")
def near_dup_pairs(spark, sf_dir):
    """Pairs of classes of equal fingerprints; near_dup_classes has their members."""
    return dedup.similar_pairs(_bits(spark, sf_dir), "doc_id", "fp", 3)


@query(f"WITH {BITS} SELECT doc_id AS id, min(doc_id) OVER w AS class_id, count(*) OVER w AS n FROM bits WINDOW w AS (PARTITION BY lo, hi)")
def near_dup_classes(spark, sf_dir):
    return dedup.classes(_bits(spark, sf_dir), "doc_id", "fp")


@query(f"WITH {BITS} SELECT doc_id, row_number() OVER (PARTITION BY lo, hi ORDER BY doc_id) = 1 AND (lo <> 0 OR hi <> 0) AS kept FROM bits")
def near_dup_keep(spark, sf_dir):
    return dedup.keep_exact(_bits(spark, sf_dir), "doc_id", "fp").select("doc_id", "kept")


@query()
def near_dup_keep_radius(spark, sf_dir):
    return dedup.keep_similar(_bits(spark, sf_dir), "doc_id", "fp", 3).select("doc_id", "kept")


@query()
def near_dup_keep_pages(spark, sf_dir):
    """The store of structural fingerprints: the first page of every one."""
    p = table(spark, sf_dir, "pages").select("page_id", dedup.fingerprints(F.col("html"), whole=True).alias("fp"))
    return dedup.keep_exact(p, "page_id", "fp").select("page_id", "kept")


@query("""
WITH RECURSIVE e AS (
  SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL
),
r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 4)
SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY node
""")
def bfs_depth(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst IS NOT NULL").distinct()
    return frontier.reach(spark, edges, spark.createDataFrame([(1,)], "src long"), "src", "dst", 4)


@query(f"WITH first_pages AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY {NORMAL} ORDER BY url) = 1), {LINKS.replace('FROM pages', 'FROM first_pages')}, k AS (SELECT DISTINCT {NORMAL} AS url FROM pages) SELECT url, {HOST} AS host, 0 AS depth, 200 AS status, true AS done, 1 AS num_visit FROM k UNION ALL SELECT l.url, {HOST.replace('url', 'l.url')}, 1, 404, true, 0 FROM (SELECT DISTINCT link AS url FROM links WHERE NOT contains(link, '*')) l WHERE l.url NOT IN (SELECT url FROM k)")
def frontier_waves(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return frontier.crawl(spark, pages, pages.select("url"), accept=lambda page, link: ~link.contains("*"), max_depth=1).select("url", "host", "depth", "status", "done", "num_visit")


@query(f"WITH {LINKS}, k AS (SELECT DISTINCT {NORMAL} AS url FROM pages), s AS (SELECT url, true AS done FROM k UNION ALL SELECT DISTINCT link, false FROM links WHERE link NOT IN (SELECT url FROM k)) SELECT count(*) AS url_count, count(*) FILTER (done) AS finish_count, sum(done::INTEGER)::BIGINT AS visit_count, 0::BIGINT AS error_count FROM s")
def crawl_counters(spark, sf_dir):
    """Put, complete and count: the store's life in one plan."""
    known = table(spark, sf_dir, "pages").select(urls.normalized(F.col("url")).alias("url")).distinct()
    empty = spark.createDataFrame([], "url string, depth int, done boolean, num_visit int, num_retry int")
    s = state.put_new(empty, known.withColumn("depth", F.lit(0)))
    s = state.put_new(s, linked(spark, sf_dir).select(F.col("link").alias("url"), F.lit(1).alias("depth")))
    s = s.withColumn("done", F.lit(False)).fillna(0, ["num_visit", "num_retry"])
    s = state.updated(state.completed(s, known), known.withColumn("num_visit", F.lit(1)))
    return state.counters(s)


_CC = "CASE event_type WHEN 'click' THEN 'max-age=100' WHEN 'view' THEN 'no-cache, max-age=100' WHEN 'error' THEN 'no-store' WHEN 'purchase' THEN 's-maxage=30, max-age=20' ELSE 'public, max-age=5, must-revalidate' END"


@query("""
SELECT event_id, cacheable,
       CASE WHEN NOT cacheable THEN NULL WHEN event_type = 'click' THEN 100 WHEN event_type = 'purchase' THEN 30 ELSE 0 END::BIGINT AS max_age,
       CASE WHEN NOT cacheable THEN 0 WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 2 END AS cache_type
FROM (SELECT *, event_id % 3 <> 0 AND event_type <> 'error' AS cacheable FROM events)
""")
def cache_control_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, 404).otherwise(200)
    return e.select("event_id", freshness.control(status, F.expr(_CC)).alias("c")).select("event_id", "c.*")


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (
  SELECT user_id, event_id, k, t AS last, true AS server_hit FROM o WHERE k = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.k, CASE WHEN o.t - r.last > 86400000000 THEN o.t ELSE r.last END, o.t - r.last > 86400000000 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1
)
SELECT user_id, event_id, server_hit FROM r
""")
def http_cache_hits(spark, sf_dir):
    return freshness.cache_hits(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 86400)


@query("SELECT page_id, sum(strlen(html)) OVER (ORDER BY page_id DESC ROWS UNBOUNDED PRECEDING) <= 200000 AS kept FROM pages")
def cache_pool(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("bytes"))
    return freshness.evicted(p.withColumn("used", F.col("page_id")), "page_id", "bytes", "used", 200_000).select("page_id", "kept")


_FREQ = "['weekly', 'never', '', 'hourly', 'always', 'daily', 'monthly', 'yearly']"
_TIMES = "['2024-03-01', '2024-03-01T12:30:00+02:00', '', '2024-03-01T12:30+02:00', '2024-03-01T10:30:00.250Z', '2024-03', '2024']"


@query(f"SELECT url AS loc, (page_id % 10) / 10.0::DOUBLE AS priority, [604800000000000, 9223372036854775807, 0, 3600000000000, 1000000000, 86400000000000, 2592000000000000, 31536000000000000][page_id % 8 + 1]::BIGINT AS changefreq, [TIMESTAMP '2024-03-01', TIMESTAMP '2024-03-01 10:30:00', NULL, TIMESTAMP '2024-03-01 10:30:00', TIMESTAMP '2024-03-01 10:30:00.25', TIMESTAMP '2024-03-01', TIMESTAMP '2024-01-01'][page_id % 7 + 1] AS lastmod FROM (SELECT page_id, rtrim(url) AS url FROM pages)")
def sitemap_decode(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    esc = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    freq, mod = (F.expr(f"array({x[1:-1]})[page_id % {n}]") for x, n in ((_FREQ, 8), (_TIMES, 7)))
    xml = F.concat(F.lit("<url><loc>"), esc, F.lit("</loc><priority>"), (F.col("page_id") % 10 / 10).cast("string"), F.lit("</priority><changefreq>"), freq, F.lit("</changefreq><lastmod>"), mod, F.lit("</lastmod></url>"))
    out = readers.sitemap_texts(p.select(xml.alias("xml")), "xml")
    return out.withColumn("lastmod", F.col("lastmod").cast("timestamp_ntz"))


@query(f"""
WITH p AS (SELECT page_id, {HOST} AS host, {PATH} AS path, list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')) AS q FROM pages)
SELECT page_id, 'site/' || host || CASE WHEN ends_with(path, '/') OR path = '' THEN rtrim(path, '/') || '/index.html' WHEN NOT contains(regexp_extract(path, '[^/]*$'), '.') THEN path || '/index.html' ELSE path END
       || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS path
FROM p
""")
def download_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.download_path(F.col("url"), "site").alias("path"))


@query(f"SELECT page_id, CASE WHEN ends_with({PATH}, '.html') THEN 'text/html; charset=utf-8' WHEN ends_with({PATH}, '/') THEN 'text/html' ELSE 'application/octet-stream' END AS content_type, ends_with({PATH}, '.html') AS certain FROM pages")
def content_type_guess(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", content.guess_type(F.lit(""), urls.part(F.col("url"), "path")).alias("g")).select("page_id", "g.*")


@query("SELECT page_id, lower(regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1)) AS charset FROM pages")
def meta_charset(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", content.page_meta(F.col("html")).alias("m")).select("page_id", "m.charset")


@query("SELECT page_id, (page_id % 60)::INTEGER AS seconds, CASE WHEN page_id % 2 = 0 THEN url END AS url FROM pages")
def refresh_parse(spark, sf_dir):
    v = F.concat((F.col("page_id") % 60).cast("string"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("; url="), F.col("url"))).otherwise(F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", content.refresh(v).alias("r")).select("page_id", "r.*")


@query(f"WITH t AS (SELECT page_id, html || '<p>see ' || url || ' , http://e.com/x?' || page_id || ' (https://f.org) </p>' AS html FROM pages) SELECT page_id, unnest(regexp_extract_all(html, '{ABSOLUTE.pattern}', 0)) AS link FROM t")
def sniff_absolute_urls(spark, sf_dir):
    """Absolute URLs in the running text of whole pages. The pages have none, so a last paragraph names some."""
    esc = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    html = F.concat("html", F.lit("<p>see "), esc, F.lit(" , http://e.com/x?"), F.col("page_id").cast("string"), F.lit(" (https://f.org) </p>"))
    return links.sniffed_urls(table(spark, sf_dir, "pages").select("page_id", html.alias("html"))).select("page_id", "link")


@query("SELECT page_id, url, 'GET' AS method, 'hopweave' AS agent, 'Basic dTpw' AS auth, CASE WHEN page_id % 5 = 0 THEN true ELSE false END AS cancelled FROM pages")
def request_build(spark, sf_dir):
    r = requests.user_agent(requests.request(F.col("url"), "get"), "hopweave")
    r = requests.cancel(requests.basic_auth(r, "u", "p"), F.col("page_id") % 5 == 0)
    out = table(spark, sf_dir, "pages").select("page_id", r.alias("r"))
    return out.select("page_id", "r.url", "r.method", F.col("r.headers")["User-Agent"][0].alias("agent"), F.col("r.headers")["Authorization"][0].alias("auth"), "r.cancelled")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return flows.drain(flows.distinct_stream(flows.table_stream(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "60 days"), spark)


@query(f"WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS t FROM events) SELECT user_id, event_id, (max(t - k * {10 * HOUR}) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) + k * {10 * HOUR})::BIGINT AS pop_us FROM k")
def stream_spacing(spark, sf_dir):
    return flows.drain(flows.spaced_stream(flows.table_stream(spark, sf_dir, "events"), "user_id", "ts", "event_id", 10 * HOUR), spark)


@query(CUT)
def stream_cutoff(spark, sf_dir):
    return flows.drain(flows.cut_off_stream(_similar(flows.table_stream(spark, sf_dir, "events")), "user_id", "event_id", "similar", 20), spark)


from hopweave.plans import crawling  # noqa: E402, F401  (registers its queries)
