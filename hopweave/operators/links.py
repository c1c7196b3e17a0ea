"""Links of pages as rows, and the filters a crawl puts on them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions.html import hrefs, located
from hopweave.functions.urls import linker, part, resolve, same_domain, BadURL
from hopweave.operators.rules import Pattern


def _base(url: str, href: str) -> str:
    try:
        return resolve(url, href)
    except BadURL:
        return url


def _each(kind: pa.DataType, row: Callable, *columns: pa.Array) -> pa.Array:
    """``row`` of the values of every row. A batch holds as many pages as the session says, of any length, so only one page
    at a time is made a Python string, and what is found becomes Arrow data every few pages."""
    out, held = [], []
    for values in zip(*columns):
        held.append(row(*[v.as_py() for v in values]))
        if len(held) == 256:
            out.append(pa.array(held, kind))
            held = []
    return pa.concat_arrays([*out, pa.array(held, kind)])


def anchor_links(url: Column, html: Column) -> Column:
    """array<string> of the normalized links of the anchors of a page, in order; duplicates stay, and references that
    aren't crawlable URLs are null. A self-closing base tag changes the base of what follows."""

    def row(url_: str | None, text: str | None) -> list[str | None]:
        link, out = linker(url_), []
        for tag, ref in hrefs(text or ""):
            if tag == "base":
                link = linker(_base(url_ or "", ref))
            else:
                out.append(link(ref))
        return out

    @F.arrow_udf("array<string>")
    def run(u: pa.Array, h: pa.Array) -> pa.Array:
        return _each(pa.list_(pa.string()), row, u, h)

    return run(url, html)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row per anchor of ``pages`` (without the page text) with ``nth`` and its normalized ``link``;
    references that aren't crawlable URLs have none."""
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.posexplode(anchor_links(F.col(url), F.col(html))).alias("nth", "link")).where("link IS NOT NULL")


def extracted(pages: DataFrame, positions: tuple[tuple[str, str], ...] = (("a", "href"),), scripts: bool = False, free: bool = False, url: str = "url", html: str = "html") -> DataFrame:
    """A row per reference at one of ``positions`` (tag, attribute), in script assignments and in
    running text where asked for: ``tag`` and ``link``. Base tags count, closed or not."""
    wanted = tuple({*positions, ("base", "href")})

    def row(url_: str | None, text: str | None) -> list[dict]:
        link, out = linker(url_), []
        for tag, ref in located(text or "", wanted, scripts, free):
            if tag == "base":
                link = linker(_base(url_ or "", ref))
                if ("base", "href") not in positions:
                    continue
            out.append({"tag": tag, "link": link(ref)})
        return out

    @F.arrow_udf("array<struct<tag:string,link:string>>")
    def run(u: pa.Array, h: pa.Array) -> pa.Array:
        return _each(pa.list_(pa.struct([("tag", pa.string()), ("link", pa.string())])), row, u, h)

    keep = [c for c in pages.columns if c != html]
    each = pages.select(*keep, F.posexplode(run(F.col(url), F.col(html))).alias("nth", "__r"))
    return each.select(*keep, "nth", F.col("__r.tag").alias("tag"), F.col("__r.link").alias("link")).where("link IS NOT NULL")


def sniffed_urls(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row per absolute URL in the running text of pages, as it stands there (``link``), without the page text."""

    @F.arrow_udf("array<string>")
    def run(h: pa.Array) -> pa.Array:
        return _each(pa.list_(pa.string()), lambda x: [ref for _, ref in located(x or "", (), False, True)], h)

    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.explode(run(F.col(html))).alias("link"))


def redirects(responses: DataFrame, url: str = "url", new_url: str = "new_url", refresh_url: str = "refresh_url", always: bool = False) -> DataFrame:
    """(url, link) of where responses lead, other than to themselves; ``always``: these as well, as an
    extractor gives them."""
    to = F.array(F.col(new_url), F.col(refresh_url))
    found = responses.select(F.col(url).alias("url"), F.explode(to if always else F.array_distinct(to)).alias("link")).where("link IS NOT NULL")
    return found if always else found.where("link <> url")


def in_scope(parent: Column, link: Column, depth: Column, pattern: Pattern, max_depth: int = 0, span_hosts: bool = False, sub_domains: bool = False, shared_address: Column | None = None) -> Column:
    """Whether a link found at ``depth`` is followed: within the depth, of its parent's scheme, on its
    host unless hosts are spanned (then on a related host or one that the host rules accept), and
    matching the pattern."""
    a, b = part(parent, "host"), part(link, "host")
    ok = part(parent, "scheme") == part(link, "scheme")
    if max_depth > 0:
        ok = ok & (depth < max_depth)
    if not span_hosts:
        ok = ok & (a == b)
    else:
        related = a == b
        if sub_domains:
            related = related | same_domain(a, b)
        if shared_address is not None:
            related = related | shared_address
        ok = ok & (related | pattern.part(link, "host"))
    return ok & pattern.match(link)


def same_address(links: DataFrame, dns: DataFrame, parent_host: str, link_host: str) -> DataFrame:
    """``links`` with ``same_ip``: whether the hosts have an address in common, by a table (host, ip)."""
    both = links.select(parent_host, link_host).distinct()
    a, b = dns.select(F.col("host").alias("__a"), "ip"), dns.select(F.col("host").alias("__b"), "ip")
    met = both.join(a, F.col(parent_host) == F.col("__a")).join(b, "ip").where(F.col(link_host) == F.col("__b")).select(parent_host, link_host).distinct().withColumn("same_ip", F.lit(True))
    return links.join(met, [parent_host, link_host], "left").fillna(False, ["same_ip"])
