"""URL parsing, reference resolution and normalization.

Plain URLs (lower-case host without port, no dot segments, only unreserved characters) are handled by
built-in expressions; only the others are handed to Python, in Arrow batches.
"""

from __future__ import annotations

import ipaddress
import posixpath
import re
from collections.abc import Callable
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = re.compile(r"(?s)(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?")
PLAIN = r"^https?://[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*(/[A-Za-z0-9_~-][A-Za-z0-9._~-]*)*/?(\?[!-~&&[^#]]*)?(#[!-~&&[^#%]]*)?$"
_LABEL = re.compile(r"(?i)(?:[a-z0-9_](?:[a-z0-9_\-]{0,61}[a-z0-9])?\.)*[a-z0-9_](?:[a-z0-9_\-]{0,61}[a-z0-9])?\.?")
_VALID = re.compile(r"(?:[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/]|%[0-9A-Fa-f]{2})*")
_BAD_PERCENT = re.compile(r"%(?![0-9A-Fa-f]{2})")
_KEEP = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~$&+,/:;=@")
DEFAULT_PORTS = {"http": "80", "https": "443"}


class BadURL(ValueError):
    """The text can't be taken for a crawlable URL."""


def escape_path(path: str) -> str:
    """A valid escaped path stays as written; any other is decoded and escaped anew."""
    if _BAD_PERCENT.search(path):
        raise BadURL("bad escape")
    if _VALID.fullmatch(path):
        return path
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), path.encode())
    return "".join(chr(b) if b in _KEEP else f"%{b:02X}" for b in raw)


def clean_path(path: str) -> str:
    """Without empty, ``.`` and ``..`` segments; a slash at the end stays."""
    if not path:
        return ""
    out = posixpath.normpath(path)
    out = "/" + out.lstrip("/") if path.startswith("/") else out
    out = "" if out == "." else out
    return out + "/" if path.endswith("/") and not out.endswith("/") else out


def check_host(host: str) -> str:
    """Lower-case ASCII form of a host name or address."""
    if host.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(host[1:-1]).compressed}]" if host.endswith("]") else _raise("host")
        except ipaddress.AddressValueError as e:
            raise BadURL("host") from e
    low = host.lower()
    if not low.isascii():
        # punycode of every label as written, without the mappings of either IDNA standard
        low = ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in host.split(".")).lower()
    if not _LABEL.fullmatch(low) or len(low) > 253:
        raise BadURL("host")
    return low


def _raise(what: str):
    raise BadURL(what)


def normalize(url: str) -> str:
    """Canonical form: scheme and host lower-case, default port, dot segments and fragment gone, path escaped, query untouched."""
    scheme, authority, path, query, _ = SPLIT.fullmatch(url).groups()
    scheme = (scheme or "").lower()
    if scheme not in DEFAULT_PORTS:
        raise BadURL("scheme")
    user, _, place = (authority or "").rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place)
    if not m or not m[1]:
        raise BadURL("host")
    host, port = check_host(m[1]), m[2] or ""
    port = "" if port == DEFAULT_PORTS[scheme] else port
    path = clean_path(escape_path(path))
    return f"{scheme}://{user + '@' if user else ''}{host}{':' + port if port else ''}{path}{'?' + query if query is not None and query != '' else ''}"


def resolve(base: str, ref: str) -> str:
    """Absolute form of a reference found in ``base``."""
    ref = ref.strip(" \t\n\r\f")
    if _BAD_PERCENT.search(SPLIT.fullmatch(ref).group(3)):
        raise BadURL("bad escape")
    try:
        return urljoin(base, ref)
    except ValueError as e:
        raise BadURL("reference") from e


def try_normalize(url: str | None) -> str | None:
    try:
        return None if url is None else normalize(url)
    except BadURL:
        return None


def try_link(base: str | None, ref: str | None) -> str | None:
    """Normalized absolute form of a reference, or None."""
    try:
        return None if base is None or ref is None else normalize(resolve(base, ref))
    except BadURL:
        return None


_ORIGIN = re.compile(r"https?://[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*(?=[/?#]|\Z)")
_ROOTED = re.compile(r"""(?:/[A-Za-z0-9_~-][A-Za-z0-9._~-]*)+/?(?:\?[!"$-~]*[!"$->@-~])?""")


def linker(base: str | None) -> Callable[[str], str | None]:
    """``try_link`` for the references of one page. Plain ones from the root of a plain site are normal behind its name."""
    m = _ORIGIN.match(base or "")
    origin = m[0] if m and try_normalize(m[0]) == m[0] else None
    return lambda ref: origin + ref if origin and _ROOTED.fullmatch(ref) else try_link(base, ref)


def normalized(url: Column) -> Column:
    """Canonical form of a URL column; null where there is none."""
    plain = url.rlike(PLAIN)

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([try_normalize(u) for u in x.to_pylist()], pa.string())

    return F.coalesce(F.when(plain, F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "\\?$", "")), run(F.when(~plain, url)))


def resolved(base: Column, ref: Column) -> Column:
    """Normalized absolute URL of a reference column against a base column."""

    @F.arrow_udf("string")
    def run(b: pa.Array, r: pa.Array) -> pa.Array:
        return pa.array([try_link(x, y) for x, y in zip(b.to_pylist(), r.to_pylist())], pa.string())

    return run(base, ref)


def part(url: Column, which: str) -> Column:
    """scheme, host, path, dir, file or query of a normalized URL, by built-in expressions."""
    path = F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return {
        "scheme": F.regexp_extract(url, "^([a-z]+)://", 1),
        "host": F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1),
        "path": path,
        "dir": F.regexp_extract(path, "^(.*/)?([^/]*)$", 1),
        "file": F.regexp_extract(path, "^(.*/)?([^/]*)$", 2),
        "query": F.regexp_extract(url, "\\?([^#]*)", 1),
    }[which]


def site(url: Column, file: str = "/robots.txt") -> Column:
    """URL of a file at the root of the site."""
    return F.concat(part(url, "scheme"), F.lit("://"), part(url, "host"), F.lit(file))


def same_domain(a: Column, b: Column) -> Column:
    """Both hosts have two labels or more and the last two agree."""
    last = lambda h: F.slice(F.split(h, "\\."), -2, 2)
    many = lambda h: F.size(F.split(h, "\\.")) > 1
    return F.when(many(a) & many(b), last(a) == last(b)).otherwise(False)


def _pairs(query: Column) -> Column:
    return F.array_sort(F.filter(F.split(query, "&"), lambda x: x != ""))


def download_path(url: Column, root: str = "", keep_host: bool = True) -> Column:
    """File a page is saved under: directories and names without extension get index.html, a query is
    appended with its parameters sorted."""
    path, query = part(url, "path"), part(url, "query")
    named = F.when(path.endswith("/") | (path == ""), F.concat(F.rtrim(path, F.lit("/")), F.lit("/index.html"))).when(
        ~F.regexp_extract(path, "([^/]*)$", 1).contains("."), F.concat(path, F.lit("/index.html"))
    ).otherwise(path)
    tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(_pairs(query), "&")))
    lead = F.concat(F.lit(root.rstrip("/") + "/" if root else ""), part(url, "host") if keep_host else F.lit(""))
    return F.concat(lead, named, tail)
