"""URL filters: allow and block entries in a trie over reversed host labels and path segments.

An entry ``host`` or ``host/path`` is the key (labels from the last to the first), then "/" and the
segments if it has a path. A host entry holds for the host, its subdomains and all their paths; a path
entry holds for the path and what lies below it on exactly that host. Of all entries that hold for a
URL the longest key decides; a block entry wins over an allow entry of the same key, and URLs without
an entry get the default.

The trie is broadcast while the entries take at most ``BROADCAST_BYTES``, which is counted first; beyond
that every distinct URL is joined with the list by its prefix keys, which gives the same rows.

Hosts are lower-cased, without user, port and trailing dot; paths are compared as written, without
empty segments, query and fragment. Defined results: null, empty and hostless URLs are not allowed and
have neither host nor entry; repeated rows and other columns, whatever their names, stay as they are; an empty list leaves
the default; entries that are null or without a host are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh

#: Of text and 64 a entry; a trie takes some times as much.
BROADCAST_BYTES = 16 << 20
#: (action, entry); the list a crawl of the example domains runs with.
ENTRIES = (
    ("block", "spam-farm.example.org"),
    ("block", "cheap-pills.example.com"),
    ("block", "adult-x.example.net"),
    ("allow", "spam-farm.example.org/en"),
    ("block", "m.ththth.example.net"),
    ("allow", "m.ththth.example.net/en"),
    ("block", "m.ththth.example.net/en/25"),
    ("block", "blog.tionsh.example.net/es"),
    ("allow", "blog.tionsh.example.net/es/533"),
    ("block", "therin.example.net/de"),
)

_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)", re.S)


def parts(url: str | None) -> tuple[list[str], list[str]] | None:
    """Host labels from the last to the first, and path segments."""
    m = _URL.match(url) if url else None
    host = m.group(1).lower().rstrip(".") if m else ""
    if not host:
        return None
    return host.split(".")[::-1], [s for s in m.group(2).split("/") if s]


def key(labels: list[str], segments: list[str]) -> str:
    return ".".join(labels) + "".join("/" + s for s in segments)


def clean(entries) -> dict[str, tuple[bool, str, list[str]]]:
    """Of every key whether it allows, its entry, and its path down the trie."""
    out: dict[str, tuple[bool, str, list[str]]] = {}
    for action, entry in entries:
        if action not in ("allow", "block") or not entry:
            continue
        p = parts(entry if "://" in entry else "http://" + entry)
        if p is None:
            continue
        k = key(*p)
        if k not in out or action == "block" and out[k][0] or action == ("allow" if out[k][0] else "block") and entry < out[k][1]:
            out[k] = (action == "allow", entry, [*p[0], *(["/", *p[1]] if p[1] else [])])
    return out


def build(entries) -> dict:
    """Nested dicts; None leads to (allowed, entry)."""
    trie: dict = {}
    for allowed, entry, path in clean(entries).values():
        node = trie
        for x in path:
            node = node.setdefault(x, {})
        node[None] = (allowed, entry)
    return trie


def longest(trie: dict, labels: list[str], segments: list[str]) -> tuple[bool, str] | None:
    node, best = trie, trie.get(None)
    for x in labels:
        node = node.get(x)
        if node is None:
            return best
        best = node.get(None, best)
    node = node.get("/")
    for x in segments:
        if node is None:
            return best
        node = node.get(x)
        if node is not None:
            best = node.get(None, best)
    return best


def _walk(docs: DataFrame, entries, default: bool, url, name: str):
    trie = docs.sparkSession.sparkContext.broadcast(build(entries))

    @F.arrow_udf("host string, allowed boolean, entry string")
    def run(urls: pa.Array) -> pa.Array:
        t, host, ok, hit = trie.value, [], [], []
        for u in urls.to_pylist():
            p = parts(u)
            best = longest(t, *p) if p else (False, None)
            host.append(".".join(p[0][::-1]) if p else None)
            ok.append(best[0] if best else default)
            hit.append(best[1] if best else None)
        return pa.StructArray.from_arrays([pa.array(host, pa.string()), pa.array(ok, pa.bool_()), pa.array(hit, pa.string())], names=["host", "allowed", "entry"])

    return docs.withColumn(name, run(url))


def _join(docs: DataFrame, entries: DataFrame, default: bool, url, name: str):
    """The same by a join on prefix keys."""

    @F.arrow_udf("string")
    def entry_key(x: pa.Array) -> pa.Array:
        ps = [parts(e if "://" in e else "http://" + e) if e else None for e in x.to_pylist()]
        return pa.array([key(*p) if p else None for p in ps], pa.string())

    listed = entries.where("action IN ('allow', 'block')").select(entry_key(F.col("entry")).alias("k"), (F.col("action") == "allow").alias("allowed"), "entry").where("k IS NOT NULL")
    listed = listed.groupBy("k").agg(F.min(F.struct("allowed", "entry")).alias("e"))
    deep = listed.agg(F.max(F.size(F.split(F.split("k", "/")[0], "\\."))), F.max(F.size(F.split("k", "/")) - 1)).first()
    most_labels, most_segments = deep[0] or 0, deep[1] or 0  # longer keys meet no entry

    @F.arrow_udf("host string, keys array<string>")
    def prefixes(urls: pa.Array) -> pa.Array:
        host, keys = [], []
        for u in urls.to_pylist():
            p = parts(u)
            host.append(".".join(p[0][::-1]) if p else None)
            keys.append([key(p[0][:i], []) for i in range(1, min(len(p[0]), most_labels) + 1)] + [key(p[0], p[1][:j]) for j in range(1, min(len(p[1]), most_segments) + 1)] if p else [])
        return pa.StructArray.from_arrays([pa.array(host, pa.string()), pa.array(keys, pa.list_(pa.string()))], names=["host", "keys"])

    urls = docs.select(url.alias("u")).distinct().withColumn("p", prefixes(F.col("u")))
    each = urls.select("u", F.posexplode("p.keys").alias("depth", "k")).join(listed, "k")
    best = each.groupBy("u").agg(F.max_by("e", "depth").alias("e"))
    own = fresh(docs, "u", name)[0]
    found = urls.join(best, "u", "left").select(
        F.col("u").alias(own),
        F.struct(F.col("p.host").alias("host"), F.coalesce(F.col("e.allowed"), F.col("p.host").isNotNull() & F.lit(default)).alias("allowed"), F.col("e.entry").alias("entry")).alias(name),
    )
    return docs.join(found, url.eqNullSafe(F.col(own)), "left").drop(own)


def filter_urls(pages: DataFrame, entries=ENTRIES, default: bool = True, url_col: str = "url", most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with a struct column ``url_filter`` (host, allowed, entry). ``entries``: pairs (action,
    entry), or a DataFrame of these two columns. A column of that name is replaced."""
    url = F.col(f"`{url_col}`").cast("string")
    name = fresh(pages, "hit")[0]
    if isinstance(entries, DataFrame):
        entries = entries.select("action", "entry")
        size = entries.agg(F.sum(F.coalesce(F.octet_length("entry"), F.lit(0)) + 64)).first()[0] or 0
        if size > most_bytes:
            out = _join(pages, entries, default, url, name)
        else:
            out = _walk(pages, [tuple(r) for r in entries.collect()], default, url, name)
    elif sum(len(e or "") + 64 for _, e in entries) > most_bytes:
        out = _join(pages, pages.sparkSession.createDataFrame(list(entries), "action string, entry string"), default, url, name)
    else:
        out = _walk(pages, entries, default, url, name)
    kept = [c for c in pages.columns if c.lower() != "url_filter"]
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(name).alias("url_filter"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "url", "url_filter.host", "url_filter.allowed", "url_filter.entry")


OP2_SQL = f"""
WITH entries(allowed, entry) AS (VALUES {", ".join(f"({'true' if a == 'allow' else 'false'}, '{e}')" for a, e in ENTRIES)}),
e AS (
  SELECT allowed, entry, split_part(entry, '/', 1) AS host,
         CASE WHEN contains(entry, '/') THEN substr(entry, strpos(entry, '/')) ELSE '' END AS path
  FROM entries
),
u AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)', 2)) AS host,
         rtrim(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/') AS path
  FROM pages
),
hit AS (
  SELECT u.page_id, u.url, e.allowed, e.entry,
         row_number() OVER (
           PARTITION BY u.page_id, u.url
           ORDER BY len(string_split(e.host, '.')) + len(string_split(e.path, '/')) DESC, e.allowed
         ) AS r
  FROM u JOIN e ON CASE WHEN e.path = '' THEN u.host = e.host OR ends_with(u.host, '.' || e.host)
                        ELSE u.host = e.host AND (u.path = e.path OR starts_with(u.path, e.path || '/')) END
)
SELECT u.page_id, u.url, nullif(u.host, '') AS host, coalesce(h.allowed, u.host <> '') AS allowed, h.entry
FROM u LEFT JOIN (SELECT * FROM hit WHERE r = 1) h ON h.page_id = u.page_id AND h.url = u.url
"""
