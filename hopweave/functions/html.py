"""A tokenizer of HTML text and what is read off its tokens: links, page metadata, structure."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np

TEXT, START, END, SELF, COMMENT, DOCTYPE = "text", "start", "end", "self", "comment", "doctype"
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
#: Elements whose name counts in the structure of a page; others count as nameless.
ATOMS = frozenset(
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption center cite code col colgroup datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
_TAG = re.compile(r"(?s)<(/?)([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""(?s)[\s/]*(?:(>)|([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>)))?)""")


class Token(NamedTuple):
    kind: str
    name: str
    attrs: tuple[tuple[str, str], ...]


def tokens(html: str) -> Iterator[Token]:
    """Tokens in order; the first of equal attributes counts, names are lower-case, values decoded."""
    at, n, raw = 0, len(html), None
    while at < n:
        if raw:
            m = re.compile(rf"(?i)</{re.escape(raw)}(?=[\s/>])").search(html, at)
            to = m.start() if m else n
            if to > at:
                yield Token(TEXT, html[at:to] if raw in ("script", "style") else unescape(html[at:to]), (("raw", raw),))
            at, raw = to, None
            continue
        lt = html.find("<", at)
        while lt >= 0 and not re.match(r"</?[A-Za-z]|<[!?]|</", html[lt : lt + 3]):
            lt = html.find("<", lt + 1)
        to = lt if lt >= 0 else n
        if to > at:
            yield Token(TEXT, unescape(html[at:to]), ())
        at = to
        if at >= n:
            return
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            yield Token(COMMENT, html[at + 4 : end if end >= 0 else n], ())
            at = end + 3 if end >= 0 else n
            continue
        m = _TAG.match(html, at)
        if not m:
            end = html.find(">", at)
            kind = DOCTYPE if html[at : at + 9].lower() == "<!doctype" else COMMENT
            yield Token(kind, html[at + 2 : end if end >= 0 else n].strip(), ())
            at = end + 1 if end >= 0 else n
            continue
        at, attrs, closed = m.end(), {}, False
        while True:
            a = _ATTR.match(html, at)
            if not a:
                if at >= n:
                    return  # a tag cut off is no token
                at += 1
                continue
            at = a.end()
            if a[1]:
                closed = html[at - 2] == "/"
                break
            attrs.setdefault(a[2].lower(), unescape(next((v for v in a.groups()[2:] if v is not None), "")))
        name = m[2].lower()
        yield Token(END if m[1] else SELF if closed else START, name, tuple(attrs.items()))
        if not m[1] and not closed and name in RAW:
            raw = name


def hrefs(html: str) -> Iterator[tuple[str, str]]:
    """("base", href) of self-closing base tags and ("a", href) of starting anchors, in order."""
    for t in tokens(html):
        if t.kind == START and t.name == "a" or t.kind == SELF and t.name == "base":
            v = dict(t.attrs).get("href")
            if v is not None:
                yield t.name, v


def located(html: str, positions: tuple[tuple[str, str], ...], scripts: bool, free: bool) -> Iterator[tuple[str, str]]:
    """(tag, reference) of the wanted (tag, attribute) pairs; with the references in script assignments
    and the absolute URLs of running text if asked for."""
    want: dict[str, list[str]] = {}
    for tag, attr in positions:
        want.setdefault(tag, []).append(attr)
    for t in tokens(html):
        if t.kind in (START, SELF):
            held = dict(t.attrs)
            for a in want.get(t.name, ()):
                if a in held:
                    yield t.name, held[a]
        elif t.kind == TEXT:
            if scripts and dict(t.attrs).get("raw") == "script":
                yield from (("script", x) for x in LOCATION.findall(t.name))
            elif free and not dict(t.attrs):
                yield from (("text", m.group()) for m in ABSOLUTE.finditer(t.name))


LOCATION = re.compile(r"""(?:window\s*\.\s*)?location(?:\s*\.\s*href)?\s*=\s*["']([^"']*)["']""")
ABSOLUTE = re.compile(r"https?://(?:-\.)?(?:[^\s/?.#-]+\.?)+(?:/[^\s]*)?")


def meta(html: str) -> dict[str, str | None]:
    """charset, content_type and refresh of the meta tags of the first 1,024 characters, the last of each; the
    character set of a content type is in that."""
    out: dict[str, str | None] = {"charset": None, "content_type": None, "refresh": None}
    for t in tokens(html[:1024]):
        if t.kind in (START, SELF) and t.name == "meta":
            a = dict(t.attrs)
            if a.get("charset", "").strip():
                out["charset"] = a["charset"].strip().lower()
            kind, value = a.get("http-equiv", "").lower(), a.get("content", "").strip()
            if value and kind == "content-type":
                out["content_type"] = value.lower()
            elif value and kind == "refresh":
                out["refresh"] = value
    return out


def features(html: str, limit: int) -> tuple[list[str], bool]:
    """Structure of a page: two features a token, and whether all tokens were read."""
    letter = {START: "A:", END: "B:", SELF: "C:", DOCTYPE: "D:", COMMENT: "E:", TEXT: "F:"}
    out: list[str] = []
    for i, t in enumerate(tokens(html)):
        if i >= limit - 1:
            return out, False
        tag = t.name if t.kind in (START, END, SELF) and t.name in ATOMS else ""
        own = letter[t.kind] + tag
        out.append(own)
        if t.kind in (START, SELF) and t.attrs:
            k, v = t.attrs[-1]
            out.append(f"G:{tag}:{k}" + (f":{v}" if k in ("class", "href", "name", "rel") else ""))
        else:
            out.append(own)
    return out, True


@lru_cache(maxsize=1 << 16)
def _fnv(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF) ^ b
    return h


def fingerprint(html: str, limit: int = 4096, shingle: int = 2, whole: bool = False) -> int:
    """64-bit SimHash of the structure, as a signed number. ``whole``: 0 for pages beyond ``limit``."""
    feats, ended = features(html, limit)
    if whole and not ended or len(feats) < shingle:
        return 0
    # shingles repeat, within a page and between pages: each is hashed once, and votes as often as it occurs
    many = Counter(zip(*[feats[i:] for i in range(shingle)]))
    hashes = np.fromiter((_fnv(" ".join(x)) for x in many), np.uint64, len(many))
    times = np.fromiter(many.values(), np.int64, len(many))
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)
    votes = times @ (2 * bits.astype(np.int64) - 1)
    return int(np.bitwise_or.reduce(np.where(votes >= 0, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))).view(np.int64))
