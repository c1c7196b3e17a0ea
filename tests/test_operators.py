from __future__ import annotations

import random
from urllib.parse import parse_qsl, urlsplit

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopweave.operators import dedup, frontier, links, pacing, state, stats
from hopweave.operators.rules import Pattern
from hopweave.functions import freshness
from hopweave.sources import readers
from hopweave.sources.storage import URL_STATE, StateStore, save_jdbc
from hopweave.streaming import flows

EVENTS = "host string, seq long, ts timestamp, score int"


def events(spark, n=120, seed=0):
    r = random.Random(seed)
    rows = [(r.choice("abc"), i, r.randrange(40), r.randrange(3)) for i in range(n)]
    df = spark.createDataFrame(rows, "host string, seq long, s long, score int").select("host", "seq", F.timestamp_seconds("s").alias("ts"), "score")
    return rows, df


@pytest.mark.parametrize("seed", [0, 1])
def test_spacing_is_the_sequential_rule(spark, seed):
    rows, df = events(spark, seed=seed)
    d, want = 3_000_000, {}
    for h in "abc":
        last = None
        for _, seq, s, _ in sorted((x for x in rows if x[0] == h), key=lambda x: (x[2], -x[3], x[1])):
            last = s * 1_000_000 if last is None else max(s * 1_000_000, last + d)
            want[seq] = last
    assert {r.seq: r.pop_us for r in pacing.spaced(df, "host", "ts", "score", "seq", d).collect()} == want


@pytest.mark.parametrize("burst", [1, 3])
def test_bucket_is_the_sequential_rule(spark, burst):
    rows, df = events(spark, seed=2)
    d, want = 2_000_000, {}
    for h in "abc":
        tokens, at = float(burst), None
        for _, seq, s, _ in sorted((x for x in rows if x[0] == h), key=lambda x: (x[2], x[1])):
            t = s * 1_000_000
            tokens = burst if at is None else min(burst, tokens + (t - at) / d)
            at = t
            tokens -= 1
            want[seq] = round(max(0.0, -tokens) * d)
    assert {r.seq: r.wait_us for r in pacing.bucket_wait(df, "host", "ts", "seq", d, burst).collect()} == want
    assert {r.wait_us for r in pacing.bucket_wait(df, "host", "ts", "seq", 0, 1).collect()} == {0}
    assert {r.wait_us for r in pacing.bucket_wait(df, "host", "ts", "seq", d, 0).collect()} == {None}


def test_queue_orders(spark):
    rows = [("a", 1, 0, 300), ("a", 2, 0, 100), ("a", 3, 0, 200), ("a", 4, 1, 5000), ("a", 5, 1, 999), ("a", 6, 1, -4)]
    df = spark.createDataFrame(rows, "host string, seq long, s long, score int").select("host", "seq", F.timestamp_seconds("s").alias("ts"), "score")
    order = lambda o: [r.seq for r in pacing.due(df, F.timestamp_seconds(F.lit(2)), "ts", "score", "seq", order=o).collect()]
    assert order("exact") == [1, 3, 2, 4, 5, 6] and order("clamped") == [1, 3, 2, 4, 5, 6] and order("fifo") == [1, 2, 3, 4, 5, 6]
    assert pacing.due(df, F.timestamp_seconds(F.lit(1)), "ts", "score", "seq").count() == 3
    with pytest.raises(ValueError):
        pacing.order_columns("ts", "score", "seq", "other")


def test_many_items_of_one_time_come_out_once(spark):
    df = spark.range(2000).select(F.lit("h").alias("host"), F.col("id").alias("seq"), F.timestamp_seconds(F.lit(5)).alias("ts"), F.lit(0).alias("score"))
    pops = [r.pop_us for r in pacing.spaced(df, "host", "ts", "score", "seq", 10).orderBy("pop_us").collect()]
    assert pops == [5_000_000 + 10 * i for i in range(2000)]


class Tree:
    """URL by URL: nodes with children by segment, and by query key and value."""

    def __init__(self):
        self.child, self.query = {}, {}

    def steps(self, url):
        u = urlsplit(url)
        return u.path.split("/")[1:], sorted(parse_qsl(u.query, keep_blank_values=True))

    def add(self, url, limit):
        node, (segments, pairs) = self, self.steps(url)
        made = []
        for depth, s in enumerate(segments, 1):
            if s not in node.child:
                if len(node.child) >= limit(depth):
                    return False
                made.append((node.child, s))
            node = node.child.get(s) or Tree()
            if made:
                made[-1][0].setdefault(made[-1][1], node)
        keys = node.query
        for depth, (k, v) in enumerate(pairs, len(segments) + 1):
            if k not in keys and len(keys) >= limit(depth):
                return False
            values = keys.setdefault(k, {})
            if v not in values and len(values) >= limit(depth):
                return False
            keys = values.setdefault(v, {})
        return True

    def has(self, url, limit):
        node, (segments, pairs) = self, self.steps(url)
        for depth, s in enumerate(segments, 1):
            if s not in node.child:
                return 0 < len(node.child) and len(node.child) >= limit(depth)
            node = node.child[s]
        keys = node.query
        for depth, (k, v) in enumerate(pairs, len(segments) + 1):
            if k not in keys:
                return False
            if v not in keys[k]:
                return len(keys[k]) >= limit(depth)
            keys = keys[k][v]
        return True


@pytest.mark.parametrize("seed", [7, 8])
def test_shape_admission_and_lookup_are_the_sequential_rules(spark, seed):
    r = random.Random(seed)
    query = lambda: "&".join(f"{r.choice('kl')}={r.choice('uvw')}" for _ in range(r.randrange(4)))
    url = lambda h: f"http://{h}" + "".join("/" + r.choice(["a", "b", "c", "d", "e", ""]) for _ in range(r.randrange(4))) + r.choice(["", "?" + query()])
    rows = [(i, h, url(h)) for i in range(250) for h in [r.choice("xy")]]
    limit = lambda d: 3 - (d > 1)
    df = spark.createDataFrame(rows, "seq long, host string, url string")
    trees = {"x": Tree(), "y": Tree()}
    want = {i: trees[h].add(u, limit) for i, h, u in rows}
    assert 30 < sum(want.values()) < 220
    admitted = dedup.admit_shapes(df, "host", "url", "seq", limit)
    assert {x.seq: x.admitted for x in admitted.collect()} == want
    asked = [(i, h, url(h)) for i in range(1000, 1200) for h in [r.choice("xy")]]
    found = dedup.has_shape(spark.createDataFrame(asked, "seq long, host string, url string"), admitted.where("admitted"), "host", "url", limit)
    assert {x.seq: x.found for x in found.collect()} == {i: trees[h].has(u, limit) for i, h, u in asked}


def test_shape_vectors(spark):
    data = ["/pkg/net/", "/pkg/net/http/", "/pkg/", "/doc/", "", "/", "/src/", "/src/?page=1&id=1", "/src/?page=1", "/src/?id=1", "/src/?id=2&page=1", "?hello=world", "/?hello=world"]
    df = spark.createDataFrame([(i, "localhost", "http://localhost" + u) for i, u in enumerate(data)], "seq long, host string, url string")
    assert all(r.admitted for r in dedup.admit_shapes(df, "host", "url", "seq", None).collect())
    assert all(r.found for r in dedup.has_shape(df, df, "host", "url", None).collect())
    steps = [("/pkg/net/http/httptest", True), ("/pkg/net/url", True), ("/pkg/net/hello", False), ("/pkg/net/url?hello=world", True), ("/pkg/net/url?hello=foo", True), ("/pkg/net/url?hello=bar", False), ("/pkg/net/url?foo=world", True), ("/pkg/net/url?bar=world", False)]
    ask = lambda rows, n: {r.seq: r.admitted for r in dedup.admit_shapes(spark.createDataFrame([(i, "localhost", "http://localhost" + u) for i, (u, _) in enumerate(rows)], "seq long, host string, url string"), "host", "url", "seq", lambda d: n).collect()}
    assert ask(steps[:2], 1) == {0: True, 1: False}
    assert ask(steps, 2) == {i: ok for i, (_, ok) in enumerate(steps)}


def test_shape_steps_and_thresholds(spark):
    df = spark.createDataFrame([("http://h/pkg//net/?b=2&a=%31&a",), ("http://h",), ("http://h/",)], "url string")
    assert [[tuple(x) for x in r.s] for r in df.select(dedup.shape(F.col("url")).alias("s")).collect()] == [
        [("/", 1, "pkg"), ("/", 2, ""), ("/", 3, "net"), ("/", 4, ""), ("?", 5, "a"), ("=", 5, ""), ("?", 6, "a"), ("=", 6, "1"), ("?", 7, "b"), ("=", 7, "2")], [], [("/", 1, "")],
    ]
    assert [dedup.threshold(d) for d in range(1, 8)] == [14, 14, 8, 6, 4, 2, 2]


def test_similar_pairs_and_greedy_keep(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = [b ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for b in base for _ in range(6)] + [0, 1, 3]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    first = {f: min(i for i, g in enumerate(fps) if g == f) for f in fps}
    for radius in (0, 3, 8):
        want = sorted((min(i, j), max(i, j), (f ^ g).bit_count()) for f, i in first.items() for g, j in first.items() if i < j and (f ^ g).bit_count() <= radius)
        assert sorted(tuple(x) for x in dedup.similar_pairs(df, "id", "fp", radius).collect()) == want
    assert {(r.id, r.class_id, r.n) for r in dedup.classes(df, "id", "fp").collect()} == {(i, first[f], fps.count(f)) for i, f in enumerate(fps)}
    for zero in (True, False):
        kept: list[int] = [0] if zero else []
        out = {}
        for i, f in enumerate(fps):
            out[i] = all((f ^ k).bit_count() > 3 for k in kept)
            if out[i]:
                kept.append(f)
        assert {x.id: x.kept for x in dedup.keep_similar(df, "id", "fp", 3, zero).collect()} == out
    same = spark.createDataFrame([(1, 5), (2, 5), (3, 0)], "id long, fp long")
    assert {x.id: x.kept for x in dedup.keep_exact(same, "id", "fp").collect()} == {1: True, 2: False, 3: False}


def test_similar_pairs_stay_few_where_bits_are_dull(spark):
    """Values whose bits are mostly alike in three quarters of the number don't all meet; all that are near are found."""
    r = random.Random(7)
    fps = sorted({sum((r.random() < (0.5 if i % 16 < 4 else 0.03)) << i for i in range(63)) for _ in range(1500)})
    df = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    want = {(i, j, (fps[i] ^ fps[j]).bit_count()) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3}
    for n in (100, 300_000, 3_000_000):
        blocks, same = dedup._blocks(n, 3, 64)
        assert blocks == same + 3 and same >= (2 if n > 100 else 1)
    masks = dedup._dealt(df.select(F.col("fp").alias("f")), 4, 64)
    assert sum(masks) == (1 << 64) - 1 and max(sum(m >> i & 1 for i in range(64) if i % 16 < 4) for m in masks) <= 5
    got = [tuple(x) for x in dedup.similar_pairs(df, "id", "fp", 3).collect()]
    assert len(got) == len(set(got)) and {(max(a, b), min(a, b), d) for a, b, d in got} == want


@pytest.mark.parametrize("query", ["near_dup_classes", "near_dup_keep", "near_dup_keep_radius", "near_dup_pairs"])
def test_fingerprints_are_taken_once(spark, query):
    """What a query returns reads written fingerprints: no plan goes back to the texts."""
    from hopweave.plans import catalogue
    from tests.conftest import SF

    plan = catalogue.QUERIES[query](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "replace(" not in plan


def test_retries_reset_and_complete(spark):
    log = spark.createDataFrame([("u", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0, 1])], "url string, n int, failed int")
    out = [(r.n, r.retry, r.completed) for r in state.retries(log, "url", ["n"], F.col("failed") == 1, 3).orderBy("n").collect()]
    assert out == [(0, 1, False), (1, 2, False), (2, 0, False), (3, 1, False), (4, 2, False), (5, 3, True)]


def test_outcomes(spark):
    rows = {200: "ok", 204: "ok", 301: "error", 404: "error", 403: "retry", 500: "retry", None: "retry"}
    df = spark.createDataFrame([(k,) for k in rows], "s int")
    assert {r.s: r.o for r in df.select("s", state.outcome(F.col("s")).alias("o")).collect()} == rows


def test_state_store(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    assert store.load().count() == 0
    store.save(state.put_new(store.load(), spark.createDataFrame([("u", 3), ("u", 1), ("v", 2)], "url string, depth int")).fillna({"done": False, "num_visit": 0, "num_retry": 0}))
    s = store.load()
    assert {(r.url, r.depth) for r in s.collect()} == {("u", 1), ("v", 2)}
    assert state.put_new(s, spark.createDataFrame([("u", 0)], "url string, depth int")).count() == 2
    # a version holds what has changed; the rest stays
    store.save(state.updated(s, spark.createDataFrame([("u", 4, 2)], "url string, num_visit int, num_error int")).where("url = 'u'"))
    one = spark.createDataFrame([("u",), ("u",), ("x",)], "url string")
    store.save(state.completed(store.load(), one))
    s = store.load()
    assert tuple(state.counters(s).first()) == (2, 1, 4, 2) and not state.is_finished(s)
    assert [r.url for r in store.unfinished().collect()] == ["v"] and [r.url for r in state.exists(one.distinct(), s).collect()] == ["u"]
    assert state.is_finished(state.completed(s, spark.createDataFrame([("v",)], "url string")))
    assert [tuple(r) for r in state.depths(spark.createDataFrame([("v",)], "url string"), s).collect()] == [("v", 2)]
    with pytest.raises(Exception, match="no state of x"):
        state.get(one, s).collect()
    assert {tuple(r) for r in state.decode(state.encode(s), URL_STATE).collect()} == {tuple(r) for r in s.collect()}
    before = {tuple(r) for r in s.collect()}
    store.compact()
    assert {tuple(r) for r in store.read(store.versions()[-1]).collect()} == before


def test_states_in_a_database(spark, tmp_path):
    rows = [("http://h/a?y=2&x=1", "h", 1), ("http://h/a?x=1&y=2", "h", 0), ("https://h/", "h", 2)]
    keyed = state.four_part(spark.createDataFrame(rows, "url string, host string, depth int"))
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    save_jdbc(keyed, url, "urls", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    back = spark.read.jdbc(url, "urls", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    assert {tuple(r) for r in back.collect()} == {("http", "h", "/a", "x=1&y=2", 0), ("https", "h", "/", "", 2)}


def site():
    page = lambda *ls: "".join(f'<a href="{x}">.</a>' for x in ls)
    return [("http://h/", page("/pkg/", "http://o/")), ("http://h/pkg/", page("a", "b", "/", "mailto:x")), ("http://h/pkg/a", page("b")), ("http://h/pkg/b", page("/pkg/a#top", "gone"))]


def test_crawl_of_three_levels(spark, tmp_path):
    pages = spark.createDataFrame(site(), "url string, html string")
    seeds = spark.createDataFrame([("HTTP://h:80/",)], "url string")
    got = {r.url: (r.depth, r.status, r.num_visit) for r in frontier.crawl(spark, pages, seeds, max_depth=5).collect()}
    assert got == {"http://h/": (0, 200, 1), "http://h/pkg/": (1, 200, 1), "http://o/": (1, 404, 0), "http://h/pkg/a": (2, 200, 1), "http://h/pkg/b": (2, 200, 1), "http://h/pkg/gone": (3, 404, 0)}
    own = frontier.crawl(spark, pages, seeds, accept=lambda p, l: l.startswith("http://h/"), max_depth=1, store=StateStore(spark, str(tmp_path / "s")))
    assert {r.url for r in own.collect()} == {"http://h/", "http://h/pkg/"}
    old = StateStore(spark, str(tmp_path / "r"))
    old.save(spark.createDataFrame([("http://old.com/", "old.com", 0, True, 200, 1, 0), ("http://h/pkg/b", "h", 5, False, None, 0, 2)], "url string, host string, depth int, done boolean, status int, num_visit int, num_retry int"))
    again = {r.url: (r.depth, r.done, r.num_visit, r.num_retry) for r in frontier.crawl(spark, pages, None, max_depth=5, store=old, resume=True).collect()}
    assert again == {"http://old.com/": (0, True, 1, 0), "http://h/pkg/b": (5, True, 1, 0)}  # at the greatest depth no links are followed
    for bad in ([], [("no url",)], [(None,)]):
        with pytest.raises(Exception, match="seed"):
            frontier.crawl(spark, pages, spark.createDataFrame(bad, "url string")).collect()


def states(df):
    return sorted(tuple(r) for r in df.select("url", "depth", "done", "status", "last", "num_visit", "num_retry", "num_error", "next_at", "score").collect())


def test_steps_give_what_one_run_gives(spark, tmp_path):
    """A crawl that stops after every wave, with failures, retries, late links and small waves."""
    rows = [(u, h, {"http://h/pkg/": 2, "http://h/pkg/b": 9}.get(u, 0), {"http://h/pkg/a": "error"}.get(u)) for u, h in site()]
    pages = spark.createDataFrame(rows, "url string, html string, fails int, error string")
    seeds = spark.createDataFrame([("http://h/",)], "url string")
    whole = frontier.crawl(spark, pages, seeds, max_depth=5)
    by = {r.url: r for r in whole.collect()}
    assert (by["http://h/pkg/"].num_visit, by["http://h/pkg/"].num_error, by["http://h/pkg/"].last.second) == (1, 2, 20)
    assert by["http://h/pkg/b"].status == 503 and by["http://h/pkg/b"].num_retry == 4 and by["http://h/pkg/b"].done
    # handling a ended in an error, but its links were followed all the same
    assert by["http://h/pkg/a"].num_visit == 0 and by["http://h/pkg/a"].depth == 2 and "http://h/pkg/gone" not in by
    store = StateStore(spark, str(tmp_path / "steps"))
    frontier.crawl(spark, pages, seeds, max_depth=5, store=store, waves=2)
    frontier.crawl(spark, pages, None, max_depth=5, store=store, resume=True, waves=1)
    out = frontier.crawl(spark, pages, None, max_depth=5, store=store, resume=True)
    assert states(out) == states(whole)
    assert states(frontier.crawl(spark, pages, seeds, max_depth=5, wave_size=2)) == states(whole)
    # another seed given to a crawl that has ended: what is stored isn't visited again
    more = frontier.crawl(spark, pages, spark.createDataFrame([("http://h/",), ("http://n/",)], "url string"), store=store, resume=True)
    assert states(more.where("url <> 'http://n/'")) == states(whole) and more.where("url = 'http://n/'").first().status == 404


def test_the_same_page_answers_at_every_reading(spark):
    """Of pages with one URL written alike the least id counts, without ids the least row, in whatever order they are read."""
    rows = [(i, "http://h/", 200 + i, None if i % 2 else f"<a href='/{i}'>") for i in range(1, 9)]
    for given in (rows, rows[::-1], rows[4:] + rows[:4]):
        pages = spark.createDataFrame(given, "page_id long, url string, status int, html string").repartition(3)
        assert [tuple(r) for r in readers.answers(pages).select("key", "status", "html").collect()] == [("http://h/", 201, None)]
        assert readers.answers(pages.drop("page_id")).first().status == 201
    late = spark.createDataFrame(rows[::-1] + [(9, "HTTP://h/", 404, "")], "page_id long, url string, status int, html string")
    assert readers.answers(late).first().status == 404  # the URL as written comes first


def test_states_do_not_hang_on_the_order_of_pages(spark, tmp_path):
    from hopweave.plans import catalogue

    rows = [(i, f"http://h/{i % 6}", f'<a href="/x{i}">') for i in range(24)]
    for name, given in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(given, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / name / "pages.parquet"))
    for query in ("crawl_states", "frontier_waves"):
        a, b = (sorted(tuple(r) for r in catalogue.QUERIES[query](spark, str(tmp_path / d)).select("url", "status", "num_visit").collect()) for d in "ab")
        assert a == b and ("http://h/x0", 404, 0) in a and not any(u == "http://h/x6" for u, *_ in a), query


def test_fatal_errors_end_the_run(spark):
    pages = spark.createDataFrame([("http://h/", "", "fatal")], "url string, html string, error string")
    with pytest.raises(RuntimeError, match="http://h/"):
        frontier.crawl(spark, pages, pages.select("url"))


def test_http_cache_sequence(spark):
    """Two paths of a server, one fresh for a second and one to be asked for each time; its answer changes midway."""
    asked = [("/normal", 0, "0"), ("/normal", 1, "0"), ("/revalidate", 2, "0"), ("/revalidate", 3, "0"), ("/normal", 500, "2"), ("/revalidate", 501, "2"), ("/normal", 1001, "2"), ("/normal", 1002, "2"), ("/revalidate", 1003, "2"), ("/revalidate", 1004, "2")]
    rows = [(k, i, at, "GET", tag, "max-age=1" if k == "/normal" else "no-cache", 200, None) for i, (k, at, tag) in enumerate(asked)]
    df = spark.createDataFrame(rows, "key string, nth long, at_ms long, method string, etag string, cache_control string, status int, age long")
    got = [(r.server_hit, r.not_modified, r.served) for r in freshness.revalidated(df).orderBy("nth").collect()]
    want = [(True, False, "0"), (False, False, "0"), (True, False, "0"), (True, True, "0"), (False, False, "0"), (True, False, "2"), (True, False, "2"), (False, False, "2"), (True, True, "2"), (True, True, "2")]
    assert got == want
    assert all(r.server_hit and not r.not_modified for r in freshness.revalidated(df, pool=False).collect())


@pytest.mark.parametrize("burst", [1, 3])
def test_updatable_bucket_is_the_sequential_rule(spark, burst):
    rows, df = events(spark, seed=5)
    limits = lambda host, asked: ((1 + asked % 3) * 1_000_000, burst)
    want = {}
    for h in "abc":
        tokens, at, count, asked, d = float(burst), None, 0, 1, 1_000_000
        for _, seq, s, _ in sorted((x for x in rows if x[0] == h), key=lambda x: (x[2], x[1])):
            t = s * 1_000_000
            tokens = burst if at is None else min(burst, tokens + (t - at) / d)
            if count >= 4:
                d, asked, count = limits(h, asked)[0], asked + 1, 0
            at, count, tokens = t, count + 1, tokens - 1
            want[seq] = round(max(0.0, -tokens) * d)
    assert {r.seq: r.wait_us for r in pacing.updatable_wait(df, "host", "ts", "seq", limits, 4).collect()} == want


def test_a_stream_waits_as_the_table_does(spark):
    from hopweave.plans import crawling
    from tests.conftest import SF

    both = [sorted(tuple(r) for r in f(spark, SF).collect()) for f in (crawling.updatable_limit, crawling.stream_limit)]
    assert both[0] == both[1] and any(w for *_, w in both[0])


def test_pool_keeps_the_last_that_fit(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(50), r.randrange(20)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, n long, used long")
    total, want = 0, {}
    for i, n, _ in sorted(rows, key=lambda x: (-x[2], x[0])):
        total += n
        want[i] = total <= 1500
    assert {x.id: x.kept for x in freshness.evicted(df, "id", "n", "used", 1500).collect()} == want
    assert freshness.evicted(df.limit(0), "id", "n", "used", 5).count() == 0


def test_no_global_window_or_cross_join(spark):
    from hopweave.plans import catalogue
    from tests.conftest import SF

    for name in ("cache_pool", "near_dup_pairs", "near_dup_keep", "same_ip", "http_cache_hits", "seen_anti_join"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
        assert not ("Window" in plan and "SinglePartition" in plan), name


def test_seed_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#x\n" + "".join(f"http://h/{i}\n" for i in range(3000)))
    (tmp_path / "b.txt").write_text("\nhttp://h/b\n")
    got = [r.url for r in readers.seed_file(spark, str(tmp_path), offset=2999, limit=3).collect()]
    assert got == ["http://h/2998", "http://h/2999", "http://h/b"]


def test_pages_of_a_batch_are_held_one_at_a_time():
    import tracemalloc

    pages = pa.array([("x%d" % i) * 50_000 for i in range(300)])
    tracemalloc.start()
    out = links._each(pa.list_(pa.int64()), lambda h: [len(h)] * 3, pages)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [[len(h)] * 3 for h in pages.to_pylist()] and most < 2_000_000
    assert links._each(pa.list_(pa.int64()), lambda h: [1], pages.slice(0, 0)).to_pylist() == []


def test_references_are_read_and_resolved_in_one_step(spark):
    """One Python worker a task, and what a base tag says of the references behind it."""
    html = '<a href="/x"><a href="y?"><base href="/d/e"/><a href="y"><a href="/%zz"><a href="//o/#f"><a href="/q?a=b#c">'
    pages = spark.createDataFrame([(1, "http://h/a/b", html), (2, "http://h/", None), (3, None, "<a href='/x'>")], "page_id int, url string, html string")
    for found in (links.page_links(pages), links.extracted(pages)):
        assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        assert [(r.page_id, r.link) for r in found.orderBy("page_id", "nth").collect()] == [(1, x) for x in ("http://h/x", "http://h/a/y", "http://h/d/y", "http://o/", "http://h/q?a=b")]


def test_link_filters(spark):
    df = spark.createDataFrame([("http://a.e.com/", "http://b.e.com/x"), ("http://a.e.com/", "https://a.e.com/x"), ("http://a.e.com/", "http://a.e.com/x.mp3"), ("http://a.e.com/", "http://z.org/x")], "p string, l string")
    ask = lambda **k: [r.ok for r in df.select(links.in_scope(F.col("p"), F.col("l"), F.lit(1), Pattern(exclude_file=["*.mp3"], host=k.pop("host", [])), **k).alias("ok")).collect()]
    assert ask() == [False, False, False, False]
    assert ask(span_hosts=True, sub_domains=True, host=["*.com"]) == [False, False, False, False]
    assert ask(span_hosts=True, host=["**.com"]) == [True, False, False, False]
    assert ask(span_hosts=True) == [True, False, False, True] and ask(span_hosts=True, max_depth=1) == [False] * 4
    dns = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2")], "host string, ip string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "x string, y string")
    assert {(r.x, r.y): r.same_ip for r in links.same_address(pairs, dns, "x", "y").collect()} == {("a", "b"): True, ("a", "c"): False, ("b", "c"): True}
    r = spark.createDataFrame([("u", "v", "w"), ("u", "u", None)], "url string, new_url string, refresh_url string")
    assert {tuple(x) for x in links.redirects(r).collect()} == {("u", "v"), ("u", "w")}


def test_cut_off_and_counts(spark):
    rows = [("h", i, i % 5 != 0) for i in range(30)] + [("g", i, False) for i in range(30)]
    df = spark.createDataFrame(rows, "host string, n long, similar boolean")
    got = {(r.host, r.n): r.cancelled for r in stats.cut_off(df, "host", ["n"], "similar", 10).collect()}
    assert all(got["h", i] == (i > 10) for i in range(30)) and not any(got["g", i] for i in range(30))
    deep = df.select("host", (F.col("n") % 2).cast("int").alias("depth"))
    assert {r.host: r.depths for r in stats.histogram_map(deep).collect()} == {"h": {0: 15, 1: 15}, "g": {0: 15, 1: 15}}


def test_cache_sequence(spark):
    rows = [("u", i, t) for i, t in enumerate([0, 1, 2, 3, 10, 11, 12])]
    df = spark.createDataFrame(rows, "k string, n long, s long").select("k", "n", F.timestamp_seconds("s").alias("t"))
    assert [r.server_hit for r in freshness.cache_hits(df, "k", "t", "n", 2).orderBy("n").collect()] == [True, False, False, True, True, False, False]


def test_saved_pages_stay(spark, tmp_path):
    pages = spark.createDataFrame([("http://h/a", "1"), ("http://h/b", "2")], "url string, html string")
    assert readers.save_pages(pages, str(tmp_path / "out")) == 2
    again = spark.createDataFrame([("http://h/a", "changed"), ("http://h/c", "3")], "url string, html string")
    assert readers.save_pages(again, str(tmp_path / "out")) == 1
    assert {(r.path, r.html) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("h/a/index.html", "1"), ("h/b/index.html", "2"), ("h/c/index.html", "3")}


def test_streams_go_on_where_they_were(spark, tmp_path):
    rows, df = events(spark, n=60)
    df = df.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))  # a stream's clock begins after 1970
    src = tmp_path / "in"
    for i in range(3):
        df.where((F.col("seq") >= 20 * i) & (F.col("seq") < 20 * i + 20)).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = flows.drain(flows.spaced_stream(stream, "host", "ts", "seq", 1_000_000), spark).collect()
    assert len(out) == 60
    for h in "abc":
        pops = sorted(r.pop_us for r in out if r.host == h)
        assert all(b - a >= 1_000_000 for a, b in zip(pops, pops[1:]))
