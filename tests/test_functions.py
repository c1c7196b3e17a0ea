from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopweave.functions import content, freshness, html, letters, urls
from hopweave.operators import requests
from hopweave.operators.rules import PAGE_FILES, Pattern, Router, glob_regex
from hopweave.sources import readers


@pytest.mark.parametrize(
    "given_,want",
    [
        ("http://example.com", "http://example.com"),
        ("hTTp://eXAMPle.com", "http://example.com"),
        ("http://example.com:80", "http://example.com"),
        ("https://example.com:443", "https://example.com"),
        ("http://example.com:443/", "http://example.com:443/"),
        ("http://中文.com", "http://xn--fiq228c.com"),
        ("http://xn--FIQ228c.com", "http://xn--fiq228c.com"),
        ("http://example.com/%B4%BA%BD%DA", "http://example.com/%B4%BA%BD%DA"),
        ("http://example.com/für", "http://example.com/f%C3%BCr"),
        ("http://example.com/a//b/./c/../d/", "http://example.com/a/b/d/"),
        ("http://example.com/../x#y", "http://example.com/x"),
        ("http://example.com/?b=2&a=1&utm_source=x", "http://example.com/?b=2&a=1&utm_source=x"),
        ("http://[::1]:80/a", "http://[::1]/a"),
        ("http://u:p@Host/", "http://u:p@host/"),
    ],
)
def test_normalize(given_, want):
    assert urls.normalize(given_) == want
    assert urls.normalize(want) == want


@pytest.mark.parametrize("bad", ["ftp://example.com", "example.com", "http://", "http:///x", "http://exa mple.com/", "http://example.com/%zz", "http://[::1/", "", "http://-a.com"])
def test_not_urls(bad):
    assert urls.try_normalize(bad) is None


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"\Ahttps?://[a-z]{1,5}(\.[a-z]{1,3}){0,2}(/[a-zé.*%~ ]{0,4}){0,4}(\?[a-z=&]{0,5})?(#[a-z]{0,3})?\Z"))
def test_normalize_twice_is_once(url):
    n = urls.try_normalize(url)
    assert n is None or urls.normalize(n) == n


def test_columns_equal_the_python_forms(spark):
    rows = ["http://a.b/c", "http://a.b/c/?", "https://A.b/c", None, "http://a.b//c", "http://a.b/é", "x", "http://a.b/c#d", "http://a.b", "http://a.b:80/", "http://a.b/c.?q=%zz", "http://a.b/c?x=é", "http://a.b/.."]
    df = spark.createDataFrame([(r,) for r in rows], "u string")
    assert [r.n for r in df.select("u", urls.normalized(F.col("u")).alias("n")).collect()] == [urls.try_normalize(r) for r in rows]
    base = df.select(urls.resolved(F.lit("http://h/d/e?q"), F.col("u")).alias("n")).collect()
    assert base[6].n == "http://h/d/x" and base[3].n is None
    assert urls.try_link("http://h/d/e", "") == "http://h/d/e" and urls.try_link("http://h/d/e", "../f#g") == "http://h/f" and urls.try_link("http://h/d/e", "mailto:x@y") is None


def test_download_paths(spark):
    rows = {"http://h/": "r/h/index.html", "http://h": "r/h/index.html", "http://h/a": "r/h/a/index.html", "http://h/a.txt?b=2&a=1": "r/h/a.txt?a=1&b=2", "http://h/a/": "r/h/a/index.html"}
    df = spark.createDataFrame([(k,) for k in rows], "u string")
    assert {r.u: r.p for r in df.select("u", urls.download_path(F.col("u"), "r").alias("p")).collect()} == rows


def test_tokens():
    doc = "<!DOCTYPE html><!-- x --><A HREF='/a&amp;b' href=c>t&lt;</a><br/><script>if (a<b) '</p>'</script><p class=x id>u<"
    got = list(html.tokens(doc))
    assert [t.kind for t in got] == ["doctype", "comment", "start", "text", "end", "self", "start", "text", "end", "start", "text"]
    assert dict(got[2].attrs) == {"href": "/a&b"} and got[3].name == "t<" and got[7].name == "if (a<b) '</p>'" and dict(got[9].attrs) == {"class": "x", "id": ""}
    assert list(html.hrefs('<base href="/x"><base href="/d/"/><a href="1"><a name=q><a href="2"/><link href=3>')) == [("base", "/d/"), ("a", "1")]
    assert list(html.tokens("<a href=")) == [] and list(html.tokens("")) == []


def test_references_in_text():
    assert html.LOCATION.findall("\nwindow.location.href = \"/doc/hello.txt\" location.href= '/doc/hello.html'\n") == ["/doc/hello.txt", "/doc/hello.html"]
    assert [m.group() for m in html.ABSOLUTE.finditer("\nhttp://example.com/doc/hello?page=1 http://example.com\n")] == ["http://example.com/doc/hello?page=1", "http://example.com"]
    page = "<script>location.href='/s'</script><p>see http://e.com/x</p><img src=i>"
    assert list(html.located(page, (("img", "src"),), True, True)) == [("script", "/s"), ("text", "http://e.com/x"), ("img", "i")]


def test_fingerprints_are_close():
    page = lambda *ps: "\n<html>\n<head>\n</head>\n<body>\n" + "".join(f"<p>{p}</p>\n" for p in ps) + "</body>\n</html>\n"
    a, b, c = (html.fingerprint(page(*ps)) for ps in (["Hello, World"], ["你好，世界", "维基 百科"], ["Hello, World", "你好，世界"]))
    assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and b == c
    assert html.fingerprint("") == 0 and html.fingerprint(page("x") * 9, limit=10, whole=True) == 0


def test_page_meta(spark):
    page = '<html><head><meta http-equiv="Content-Type" content="text/html; charset=GBK"><meta http-equiv=refresh content="30; URL=1.html"></head>'
    m = spark.createDataFrame([(page,), (None,), ("<meta charset=UTF-8>",)], "h string").select(content.page_meta(F.col("h")).alias("m")).collect()
    assert m[0].m.charset is None and m[0].m.content_type == "text/html; charset=gbk" and m[0].m.refresh == "30; URL=1.html" and m[1].m is None and m[2].m.charset == "utf-8"
    rows = {"30; URL=1.html": (30, "1.html"), "5": (5, None), "x; url=a": (0, None), "7,url = b c ": (7, "b c"), "": (0, None), "3;u=a": (3, None)}
    df = spark.createDataFrame([(k,) for k in rows], "v string").select("v", content.refresh(F.col("v")).alias("r"))
    assert {r.v: (r.r.seconds, r.r.url) for r in df.collect()} == rows


def test_page_vector(spark):
    """Meta tags, headers and where a page says it is, together."""
    page = '<html><head><meta http-equiv="content-type" content="text/html;charset=GBK"><meta http-equiv="refresh" content="30; URL=1.html"></head>'
    df = spark.createDataFrame([(page, {"content-location": "index.html"}, "http://h/d/")], "h string, heads map<string,string>, url string")
    m = content.page_meta(F.col("h"))
    kind = content.page_type(F.lit("text/html"), F.lit(False), m["content_type"])
    row = df.select(kind.alias("k"), content.locations(F.col("heads"), F.col("url")).alias("l"), content.refresh(m["refresh"]).alias("r"), content.charset(F.encode("h", "UTF-8"), kind["content_type"]).alias("c")).first()
    assert tuple(row.k) == ("text/html; charset=gbk", True) and tuple(row.c) == ("gbk", True) and tuple(row.r) == (30, "1.html")
    assert row.l.content_location == "http://h/d/index.html" and row.l.refresh_seconds is None


def test_charset_decisions(spark):
    rows = [
        ("<html>你好，世界</html>".encode(), "text/html", ("utf-8", False)), ("<html>你好，世界</html>".encode(), "text/html; charset=utf-8", ("utf-8", True)), (b"<html><body></body></html>", "text/html; charset=gbk", ("gbk", True)),
        (b"<html>plain", "text/html", ("utf-8", True)), (b"\xef\xbb\xbfx", "text/html; charset=gbk", ("utf-8", True)), (b"<meta charset=Latin1>\xe9", "text/html", ("utf-8", True)), (b"<meta charset=koi8-r>\xe9", "text/html; charset=none", ("koi8-r", False)),
        (b"x\xe9", "text/html", ("utf-8", True)), (b"x", "text/plain", None), (None, "text/html", ("utf-8", True)), (("x" + "é" * 600).encode(), "text/html", ("utf-8", False)),
    ]
    df = spark.createDataFrame([(b, t) for b, t, _ in rows], "b binary, t string")
    got = [None if r.c is None else tuple(r.c) for r in df.select(content.charset(F.col("b"), F.col("t")).alias("c")).collect()]
    assert got == [w for *_, w in rows]
    assert [content.known_charset(x) for x in ("UTF8", "iso-8859-1", "nope", None, "Shift_JIS")] == ["utf-8", "windows-1252", None, None, "shift_jis"]


def test_structural_fingerprint_by_plain_loops(spark):
    """Features, hashes and votes one at a time, of the pages of a table and of three alike."""
    from hopweave.plans.catalogue import QUERIES
    from tests.conftest import SF

    def plain(page, limit=4096):
        feats, n = [], 0
        for t in html.tokens(page):
            n += 1
            if n >= limit:
                return 0
            tag = t.name if t.kind in ("start", "end", "self") and t.name in html.ATOMS else ""
            own = {"start": "A:", "end": "B:", "self": "C:", "doctype": "D:", "comment": "E:", "text": "F:"}[t.kind] + tag
            last = own
            if t.kind in ("start", "self") and t.attrs:
                k, v = t.attrs[-1]
                last = f"G:{tag}:{k}:{v}" if k in ("class", "href", "name", "rel") else f"G:{tag}:{k}"
            feats += [own, last]
        votes = [0] * 64
        for a, b in zip(feats, feats[1:]):
            h = 0xCBF29CE484222325
            for c in f"{a} {b}".encode():
                h = h * 0x100000001B3 % 2**64 ^ c
            for i in range(64):
                votes[i] += 1 if h >> i & 1 else -1
        f = sum(1 << i for i in range(64) if votes[i] >= 0) if len(feats) > 1 else 0
        return f - 2**64 if f >= 2**63 else f

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.fingerprint for r in QUERIES["structural_fingerprint"](spark, SF).collect()}
    assert got == {i: plain(h) for i, h in pages.items()} and any(got.values())
    assert [html.fingerprint(x, whole=True) for x in ("", "<p>", "<p>" * 5000)] == [plain(x) for x in ("", "<p>", "<p>" * 5000)]
    first = {}
    for i in sorted(got):
        first.setdefault(got[i], i)
    kept = {r.page_id: r.kept for r in QUERIES["near_dup_keep_pages"](spark, SF).collect()}
    assert kept == {i: got[i] != 0 and first[got[i]] == i for i in got}


def test_punycode_keeps_letters_as_they_are():
    assert urls.normalize("http://straße.de/") == "http://xn--strae-oqa.de/" and urls.normalize("http://bücher.example/") == "http://xn--bcher-kva.example/"


def test_bodies(spark):
    text = "grün 漢"
    rows = [(gzip.compress(text.encode()), "gzip", None), (zlib.compress(text.encode()), "deflate", None), (text.encode("gbk", "ignore"), "", "gbk"), (b"\xff\xfe" + text.encode("utf-16le"), "identity", "gbk"), (b"x", "br", None), (b"x", "gzip,deflate", None), (None, "", None)]
    df = spark.createDataFrame(rows, "b binary, e string, c string")
    assert [r.t for r in df.select(content.body_text(F.col("b"), F.col("e"), F.col("c")).alias("t")).collect()] == [text, text, text.encode("gbk", "ignore").decode("gbk"), text, None, None, None]
    kinds = [content.sniff(x) for x in (b"  <!DOCTYPE HTML>", b"%PDF-1", b"\x00\x01", b"hello", b"<?xml v", b"\x89PNG\r\n\x1a\n")]
    assert kinds == ["text/html; charset=utf-8", "application/pdf", "application/octet-stream", "text/plain; charset=utf-8", "text/xml; charset=utf-8", "image/png"]
    t = spark.createDataFrame([("", "/a.PDF"), ("a/b", "/a.pdf"), ("", "/a/"), ("", "/a")], "h string, p string").select(content.guess_type(F.col("h"), F.col("p")).alias("g")).collect()
    assert [tuple(r.g) for r in t] == [("application/pdf", True), ("a/b", True), ("text/html", False), ("application/octet-stream", False)]


def test_cache_control(spark):
    rows = [(200, "no-store"), (200, "max-age=100"), (200, "no-cache, max-age=100"), (404, "max-age=100"), (200, None), (200, "max-age=x"), (200, "max-age=5, s-maxage=9"), (301, "max-age=5, must-revalidate")]
    out = [tuple(r.c) for r in spark.createDataFrame(rows, "s int, c string").select(freshness.control(F.col("s"), F.col("c")).alias("c")).collect()]
    assert out == [(False, None, 0), (True, 100, 1), (True, 0, 2), (False, None, 0), (False, None, 0), (False, None, 0), (True, 9, 1), (True, 0, 2)]
    one = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:10' d, TIMESTAMP '2024-01-01 00:00:30' r, TIMESTAMP '2024-01-01 00:01:00' n")
    assert one.select(freshness.age(F.col("d"), F.col("r"), F.lit(5), F.col("n")).alias("a")).first().a == 50
    exp = one.select(freshness.control(F.lit(200), F.lit("public"), F.col("d"), F.col("n")).alias("c")).first().c
    assert exp.max_age == 50 and exp.cacheable


def test_patterns(spark):
    p = Pattern(accept=["**", "/.*/"], reject=[r"/.*\.(doc|xls|ppt|pdf)/"], host=["*.google.com"], exclude_host=["example.com"], dir=[r"\/doc/"], file=["*.txt", r"/.*\.html/", "*.pdf", ""], exclude_file=["*.mp3"])
    rows = {"http://www.example.com": False, "http://example.com/doc/hello.txt": False, "http://www.google.com/doc/": True, "http://google.com": False, "http://www.google.com/doc/hello.pdf": False, "http://www.google.com/hello.html": False, "http://www.google.com/doc/hello.html": True, "http://www.google.com/doc/hello.mp3": False}
    df = spark.createDataFrame([(k,) for k in rows], "u string")
    assert {r.u: r.ok for r in df.select("u", p.match(F.col("u")).alias("ok")).collect()} == rows
    assert [r.ok for r in df.limit(1).select(p.part(F.col("u"), "port").alias("ok")).collect()] == [False]
    files = {"http://h/": True, "http://h/a": True, "http://h/a.html": True, "http://h/a.shtml": True, "http://h/a.php": True, "http://h/a.png": False}
    df = spark.createDataFrame([(k,) for k in files], "u string")
    assert {r.u: r.ok for r in df.select("u", PAGE_FILES.match(F.col("u")).alias("ok")).collect()} == files
    assert glob_regex("a.{b,c}?[!x]", "/") == r"(?s)^a\.(?:b|c)[^/][^x]$"
    for bad in ("[a", "{a"):
        with pytest.raises(ValueError):
            glob_regex(bad)


def test_router(spark):
    r = Router()
    for i, p in enumerate(["*", "*://example.org/*", "http://example.org/*", "http://example.org/section/*", "= http://example.org/", "~ http://example.org/section/hello/.*", "^~ http://example.org/foo/*", "~ http://example.org/foo/.*"]):
        r.add(p, i)
    rows = {"hello, world": 0, "https://example.org/": 1, "http://example.org/bar": 2, "http://example.org/section": 2, "http://example.org/section/": 3, "http://example.org/": 4, "http://example.org/section/hello/world": 5, "http://example.org/foo/hello/world": 6}
    df = spark.createDataFrame([(k,) for k in rows], "s string")
    assert {x.s: x.v for x in df.select("s", r.get(F.col("s")).alias("v")).collect()} == rows
    assert not df.select(Router().allowed(F.col("s")).alias("v")).first().v


def test_requests(spark):
    q = requests.request(F.col("u"), "post")
    q = requests.add_cookie(requests.add_cookie(requests.user_agent(requests.user_agent(q, "a"), "b"), "x", "1"), "y", "2")
    q = requests.use(requests.referer(requests.cancel(q, F.col("u") == "v"), F.col("u")), "browser")
    rows = spark.createDataFrame([("u",), ("v",)], "u string").select(q.alias("q")).collect()
    assert rows[0].q.headers == {"User-Agent": ["b"], "Cookie": ["x=1", "y=2"], "Referer": ["u"]} and rows[0].q.method == "POST" and rows[0].q.client == "browser"
    assert [r.q.cancelled for r in rows] == [False, True]


def test_sitemap(spark, tmp_path):
    entries = [("http://e.com/", "2005-01-01", "monthly", "0.8"), ("http://e.com/c?a=1&amp;b=2", None, "weekly", None), ("http://e.com/3", "2004-12-23T18:00:15+00:00", None, "0.3"), ("http://e.com/4", "2004", "never", None)]
    body = "".join("<url>" + "".join(f"<{k}>{v}</{k}>" for k, v in zip(("loc", "lastmod", "changefreq", "priority"), e) if v) + "</url>" for e in entries)
    (tmp_path / "s.xml").write_text(f'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{body}</urlset>')
    got = {r.loc: r for r in readers.sitemap(spark, str(tmp_path / "s.xml")).collect()}
    day = 86400 * 10**9
    assert got["http://e.com/"].changefreq == 30 * day and got["http://e.com/"].priority == 0.8 and str(got["http://e.com/"].lastmod) == "2005-01-01 00:00:00"
    assert got["http://e.com/c?a=1&b=2"].changefreq == 7 * day and got["http://e.com/3"].changefreq == 0 and got["http://e.com/4"].changefreq == 2**63 - 1
    assert str(got["http://e.com/3"].lastmod) == "2004-12-23 18:00:15" and str(got["http://e.com/4"].lastmod) == "2004-01-01 00:00:00"
    with pytest.raises(Exception, match="unknown frequency"):
        spark.createDataFrame([("sometimes",)], "f string").select(readers.frequency(F.col("f"))).collect()


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds").write_text("# list\nhttp://A.com\n\nhttp://b.com/\nhttp://a.com:80\nhttp://c.com\n")
    got = readers.seed_file(spark, str(tmp_path / "seeds"))
    assert [r.url for r in got.collect()] == ["http://A.com", "http://b.com/", "http://a.com:80", "http://c.com"]
    assert {r.url for r in readers.seeds(got).collect()} == {"http://a.com", "http://b.com/", "http://c.com"}
    assert [r.url for r in readers.seed_file(spark, str(tmp_path / "seeds"), 2, 2).collect()] == ["http://b.com/", "http://a.com:80"]
    with pytest.raises(Exception, match="bad seed"):
        readers.seeds(spark.createDataFrame([("nope",)], "url string")).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("etaoinsr xé", max_size=40)), max_size=12), st.integers(0, 3), st.sampled_from([3, 40, 1 << 20]))
def test_letter_pairs_are_those_that_replace_finds(texts, offset, piece):
    of = "etaoinsr"
    want = [None if t is None else sum(((len(t) - len(t.replace(x + y, ""))) // 2 % 2) << (8 * i + j) for i, x in enumerate(of) for j, y in enumerate(of)) for t in texts]
    held, letters.PIECE = letters.PIECE, piece
    try:
        for kind in (pa.string(), pa.large_string()):
            got = letters.parities(pa.array(texts, kind).slice(offset), of).to_pylist()
            assert [None if x is None else x % (1 << 64) for x in got] == want[offset:]
    finally:
        letters.PIECE = held


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(["http://h.com/a/b?q", "https://h", "http://h-.com/", "http://h:80/x", "HTTP://h/", "http://" + "a" * 70 + ".com/", "http://u@h/", "http://h?x", "http://h\n/x", " http://h/", "", None]), st.one_of(st.text("/ab.~-_?#%&=;:[] \t\n\"é", max_size=12), st.text("/ab.?=", max_size=10).map(lambda x: "/a" + x)))
def test_links_of_a_page_are_those_of_each_reference(base, ref):
    assert urls.linker(base)(ref) == urls.try_link(base, ref)
