from __future__ import annotations

import random

from hopweave.llm.urlfilter import filter_urls, parts


def plain(url, entries, default=True):
    """Every entry against the URL."""
    p = parts(url)
    if p is None:
        return None, False, None
    best = None
    for action, e in entries:
        q = parts("http://" + e)
        fits = p[0][: len(q[0])] == q[0] if not q[1] else p[0] == q[0] and p[1][: len(q[1])] == q[1]
        if fits:
            k = (len(q[0]) + (1 + len(q[1]) if q[1] else 0), action == "block")
            if best is None or k > best[0] or k == best[0] and e < best[2]:
                best = k, action, e
    host = ".".join(p[0][::-1])
    return (host, default, None) if best is None else (host, best[1] == "allow", best[2])


def rows(df):
    return {(r.page_id, r.url): (r.url_filter.host, r.url_filter.allowed, r.url_filter.entry) for r in df.collect()}


def test_trie_and_join_give_what_trying_every_entry_gives(spark):
    r = random.Random(1)
    host = lambda: ".".join(r.choice("abc") for _ in range(r.randrange(1, 4))) + ".x"
    path = lambda n: "".join("/" + r.choice("pq") for _ in range(r.randrange(n)))
    entries = list({(r.choice(["allow", "block"]), host() + path(3)) for _ in range(60)})
    urls = [f"{r.choice(['http', 'https'])}://{host()}{path(5)}{r.choice(['', '/', '?a=/p', '#/q'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {(i, u): plain(u, entries) for i, u in enumerate(urls)}
    assert rows(filter_urls(pages, entries)) == want
    assert rows(filter_urls(pages, entries, most_bytes=0)) == want
    table = spark.createDataFrame(entries, "action string, entry string")
    assert rows(filter_urls(pages, table, default=False)) == {(i, u): plain(u, entries, False) for i, u in enumerate(urls)}


def test_odd_rows(spark):
    rs = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://User:pw@WWW.Ex.COM.:80//a///b?x#y"), (5, "HTTP://User:pw@WWW.Ex.COM.:80//a///b?x#y"), (6, "http://ex.com/" + "a/" * 30000)]
    pages = spark.createDataFrame([(*r, "k", "h", 1, 2, 3) for r in rs], "page_id long, url string, keys string, host string, url_filter int, hit int, U int")
    entries = [("block", "ex.com"), ("allow", "www.ex.com/a"), (None, "x"), ("block", None), ("block", ""), ("other", "ex.com")]
    for most in (100_000, 0):
        out = filter_urls(pages, entries, most_bytes=most)
        assert out.columns == ["page_id", "url", "keys", "host", "hit", "U", "url_filter"]
        got = rows(out)
        assert {(r.keys, r.host, r.hit, r.U) for r in out.collect()} == {("k", "h", 2, 3)} and out.count() == 7
        assert got[5, rs[4][1]] == ("www.ex.com", True, "www.ex.com/a") and got[6, rs[6][1]] == ("ex.com", False, "ex.com")
        assert {got[i, u] for i, u in rs[:4]} == {(None, False, None)}
        assert rows(filter_urls(pages, [], most_bytes=most))[6, rs[6][1]] == ("ex.com", True, None)
        assert filter_urls(pages.limit(0), entries, most_bytes=most).count() == 0
