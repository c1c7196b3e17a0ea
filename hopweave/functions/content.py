"""What a response holds: media type, character set, refresh, content decoding."""

from __future__ import annotations

import codecs
import gzip
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import meta
from .urls import resolved

HTML_TYPES = ("text/html", "application/xhtml+xml")
#: Media type by extension; fixed here, as operating systems differ in theirs.
BY_EXTENSION = {
    ".html": "text/html; charset=utf-8", ".htm": "text/html; charset=utf-8", ".xhtml": "application/xhtml+xml", ".css": "text/css; charset=utf-8", ".js": "text/javascript; charset=utf-8", ".json": "application/json",
    ".xml": "text/xml; charset=utf-8", ".txt": "text/plain; charset=utf-8", ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".svg": "image/svg+xml", ".webp": "image/webp", ".zip": "application/zip", ".gz": "application/gzip",
}
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
_MAGIC = ((b"%PDF-", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/x-gzip"))


def media_type(content_type: Column) -> Column:
    """The bare type, lower-case."""
    return F.lower(F.trim(F.split(content_type, ";")[0]))


def is_html(content_type: Column) -> Column:
    return media_type(content_type).isin(*HTML_TYPES)


def charset_of(content_type: Column) -> Column:
    """charset parameter of a media type, or null."""
    got = F.regexp_extract(F.lower(content_type), 'charset=\\s*"?([^\\s;"]+)', 1)
    return F.when(got != "", got)


def guess_type(header: Column, path: Column, location_path: Column | None = None) -> Column:
    """struct(content_type, certain): the header, else the extension, else HTML for directories."""
    table = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    ext = lambda p: table[F.lower(F.regexp_extract(p, "(\\.[^./]*)$", 1))]
    known = F.coalesce(F.when(header != "", header), ext(path), *([ext(location_path)] if location_path is not None else []))
    guess = F.when(path.endswith("/"), F.lit("text/html")).otherwise(F.lit("application/octet-stream"))
    return F.struct(F.coalesce(known, guess).alias("content_type"), known.isNotNull().alias("certain"))


def sniff(head: bytes) -> str:
    """Media type of the first bytes of a body."""
    for magic, kind in _MAGIC:
        if head.startswith(magic):
            return kind
    low = head.lstrip(b"\t\n\x0c\r ").lower()
    if any(low.startswith(t) and (len(low) == len(t) or low[len(t)] in b" >") for t in (b"<!doctype html", b"<html", b"<head", b"<script", b"<iframe", b"<h1", b"<div", b"<font", b"<table", b"<a", b"<style", b"<title", b"<b", b"<body", b"<br", b"<p")) or low.startswith(b"<!--"):
        return "text/html; charset=utf-8"
    if low.startswith(b"<?xml"):
        return "text/xml; charset=utf-8"
    for bom, name in BOMS:
        if head.startswith(bom):
            return f"text/plain; charset={name}"
    return "application/octet-stream" if any(b < 9 or 14 <= b < 27 or 28 <= b < 32 or b == 11 for b in head) else "text/plain; charset=utf-8"


def sniffed(body: Column) -> Column:
    """Media type by the first 1,024 bytes of a binary column; null for an empty body."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([sniff(b) if b else None for b in x.to_pylist()], pa.string())

    return run(F.substring(body, 1, 1024))


def page_meta(html: Column) -> Column:
    """struct(charset, content_type, refresh) of the page's meta tags."""

    @F.arrow_udf("charset string, content_type string, refresh string")
    def run(x: pa.Array) -> pa.Array:
        rows = [meta(h) if h is not None else None for h in x.to_pylist()]
        return pa.array(rows, pa.struct([("charset", pa.string()), ("content_type", pa.string()), ("refresh", pa.string())]))

    return run(F.substring(html, 1, 1024))


def refresh(value: Column) -> Column:
    """struct(seconds, url) of a refresh value: ``N; url=X`` or ``N, url=X``; (0, null) without a number."""
    number = F.regexp_extract(value, "^\\s*([0-9]+)\\s*(?:[;,]|$)", 1)
    to = F.regexp_extract(value, "^[^;,]*[;,]\\s*(?i:url)\\s*=\\s*(\\S.*?)\\s*$", 1)
    ok = number != ""
    return F.struct(F.when(ok, number.cast("int")).otherwise(0).alias("seconds"), F.when(ok & (to != ""), to).alias("url"))


def canonical_type(content_type: Column) -> Column:
    """Media type in lower case with its parameters in order of their names; text that is no media type stays."""
    parts = F.filter(F.transform(F.split(content_type, ";"), lambda x: F.trim(x)), lambda x: x != "")
    token = "^[!#$%&'*+.^_`|~0-9A-Za-z-]+$"
    unquoted = lambda x: F.when(x.rlike('^".*"$'), F.regexp_replace(F.substring(x, 2, F.length(x) - 2), r"\\\\(.)", "$1")).otherwise(x)
    quoted = lambda x: F.when(x.rlike(token), x).otherwise(F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\\\])', r"\\\\$1"), F.lit('"')))
    param = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), unquoted(F.trim(F.substring(x, F.locate("=", x) + 1, F.length(x)))).alias("v"))
    params = F.array_sort(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), param))
    fits = parts[0].rlike("^[^/ ]+(/[^/ ]+)?$") & F.forall(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.contains("="))
    return F.when(fits, F.concat(F.lower(parts[0]), F.array_join(F.transform(params, lambda p: F.concat(F.lit("; "), p["k"], F.lit("="), quoted(p["v"]))), ""))).otherwise(content_type)


def page_type(content_type: Column, certain: Column, from_meta: Column) -> Column:
    """struct(content_type, certain): that of the page's meta tag where the known one is uncertain or names no
    character set."""
    use = from_meta.isNotNull() & (~certain | charset_of(content_type).isNull())
    return F.struct(F.when(use, canonical_type(from_meta)).otherwise(content_type).alias("content_type"), (certain | use).alias("certain"))


def locations(headers: Column, url: Column, new_url: Column | None = None) -> Column:
    """struct(content_location, refresh_seconds, refresh_url) of a header map (lower-case names), resolved against
    where the response came from (``new_url``, or ``url``) and normalized."""
    base = url if new_url is None else F.coalesce(new_url, url)
    r = refresh(headers["refresh"])
    return F.struct(
        resolved(base, F.when(headers["content-location"] != "", headers["content-location"])).alias("content_location"),
        F.when(headers["refresh"].isNotNull(), r["seconds"]).alias("refresh_seconds"),
        resolved(base, r["url"]).alias("refresh_url"),
    )


def previewed(body: Column) -> Column:
    """First 1,024 bytes of a body; null where it has none, which is an error of the page (``preview_error``)."""
    return F.when(F.length(body) > 0, F.substring(body, 1, 1024))


def preview_error(body: Column) -> Column:
    """Error class of a body that can't be looked into, or null."""
    return F.when(body.isNull() | (F.length(body) == 0), "error")


def decode_body(body: bytes, encodings: list[str]) -> bytes:
    """Body without its content encoding; more than one real encoding is an error."""
    real = [e for e in encodings if e not in ("", "identity", "chunked")]
    if len(real) > 1:
        raise ValueError("several encodings")
    if not real:
        return body
    if real[0] == "gzip":
        return gzip.decompress(body)
    if real[0] == "deflate":
        return zlib.decompress(body, -15) if body[:1] not in (b"\x78",) else zlib.decompress(body)
    raise ValueError(f"unknown encoding {real[0]}")


def to_text(body: bytes, charset: str | None, default: str = "utf-8") -> str:
    """Text of a body: a byte order mark decides over the charset, bad bytes become U+FFFD."""
    for bom, name in BOMS:
        if body.startswith(bom):
            return body[len(bom) :].decode(name, "replace")
    try:
        return body.decode((charset or default).replace("windows-", "cp"), "replace")
    except LookupError:
        return body.decode(default, "replace")


#: Names that stand for another character set on the web.
_LABELS = {"iso-8859-1": "windows-1252", "latin1": "windows-1252", "latin-1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "utf8": "utf-8", "gb2312": "gbk", "x-gbk": "gbk", "utf-16": "utf-16le", "sjis": "shift_jis", "x-sjis": "shift_jis", "ks_c_5601-1987": "euc-kr"}
_META = re.compile(rb"(?is)<meta[^>]*?charset\s*=\s*[\"']?\s*([a-z0-9_:.\-]+)")


def known_charset(name: str | None) -> str | None:
    """Usual name of a character set, or None where there is no such."""
    low = (name or "").strip().lower()
    low = _LABELS.get(low, low)
    try:
        codecs.lookup(low.replace("windows-", "cp"))
    except LookupError:
        return None
    return low


def decide_charset(head: bytes, content_type: str | None) -> tuple[str, bool]:
    """Character set of a page and whether that is certain: its byte order mark or the media type's are; one that
    a meta tag names isn't, nor is UTF-8 that is seen from the bytes, nor windows-1252, which is what is left."""
    for bom, name in BOMS:
        if head.startswith(bom):
            return name, True
    m = re.search(r"charset=\s*\"?([^\s;\"]+)", (content_type or "").lower())
    if m and known_charset(m[1]):
        return known_charset(m[1]), True
    m = _META.search(head)
    if m and known_charset(m[1].decode()):
        named = known_charset(m[1].decode())
        return ("utf-8" if named.startswith("utf-16") else named), False
    try:
        text = head.decode() if len(head) < 1024 else codecs.getincrementaldecoder("utf-8")().decode(head)
        return ("utf-8" if len(text) < len(head) else "windows-1252"), False
    except UnicodeDecodeError:
        return "windows-1252", False


def charset(body: Column, content_type: Column, asked: Column | None = None) -> Column:
    """struct(charset, certain) of HTML bodies, by their first 1,024 bytes; ``asked``: what to take, as certain,
    where nothing is known (UTF-8). Null for other media types."""

    @F.arrow_udf("charset string, certain boolean")
    def run(b: pa.Array, t: pa.Array, hook: pa.Array) -> pa.Array:
        out = []
        for x, kind, other in zip(b.to_pylist(), t.to_pylist(), hook.to_pylist()):
            if (kind or "").split(";")[0].strip().lower() not in HTML_TYPES:
                out.append(None)
                continue
            name, sure = decide_charset(x or b"", kind)
            if not sure and name == "windows-1252" and known_charset(other):
                name, sure = known_charset(other), True
            out.append({"charset": name, "certain": sure})
        return pa.array(out, pa.struct([("charset", pa.string()), ("certain", pa.bool_())]))

    return run(F.substring(body, 1, 1024), content_type, F.lit("utf-8") if asked is None else asked)


def body_text(body: Column, encoding: Column, charset: Column) -> Column:
    """Text of a raw body column; null where it can't be decoded."""

    @F.arrow_udf("string")
    def run(b: pa.Array, e: pa.Array, c: pa.Array) -> pa.Array:
        out = []
        for x, enc, cs in zip(b.to_pylist(), e.to_pylist(), c.to_pylist()):
            try:
                out.append(None if x is None else to_text(decode_body(x, (enc or "").lower().split(",")), cs))
            except (ValueError, OSError, EOFError, zlib.error):
                out.append(None)
        return pa.array(out, pa.string())

    return run(body, encoding, charset)
