"""URL rules compiled to column predicates: globs, regular expressions, and the router's precedence."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopweave.functions.urls import part
from hopweave.operators.requests import request, use


def glob_regex(glob: str, sep: str = "") -> str:
    """Anchored Java regular expression of a glob: ``*`` and ``?`` stop at ``sep``, ``**`` doesn't."""
    one = f"[^{re.escape(sep)}]" if sep else "."
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob.startswith("**", i):
                out, i = out + ".*", i + 1
            else:
                out += one + "*"
        elif c == "?":
            out += one
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"open class in {glob!r}")
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"open braces in {glob!r}")
    return f"(?s)^{out}$"


def rule(text: Column, pattern: str, sep: str = "") -> Column:
    """Predicate of one rule: empty equals empty, ``/re/`` searches, anything else is a glob."""
    if pattern == "":
        return text == ""
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
        re.compile(pattern[1:-1])
        return text.rlike(pattern[1:-1])
    return text.rlike(glob_regex(pattern, sep))


def _any(preds: list[Column]) -> Column | None:
    out = None
    for p in preds:
        out = p if out is None else out | p
    return out


@dataclass(frozen=True)
class Pattern:
    """Accept and reject rules of the four parts of a URL; a part passes if no reject rule and, where there
    are any, some accept rule matches it."""

    accept: list[str] = field(default_factory=list)
    reject: list[str] = field(default_factory=list)
    host: list[str] = field(default_factory=list)
    exclude_host: list[str] = field(default_factory=list)
    dir: list[str] = field(default_factory=list)
    exclude_dir: list[str] = field(default_factory=list)
    file: list[str] = field(default_factory=list)
    exclude_file: list[str] = field(default_factory=list)

    def part(self, url: Column, which: str) -> Column:
        """Predicate of one part: url, host, dir or file; anything else never passes."""
        table = {"url": (url, self.accept, self.reject, "/"), "host": (part(url, "host"), self.host, self.exclude_host, "."), "dir": (part(url, "dir"), self.dir, self.exclude_dir, "/"), "file": (part(url, "file"), self.file, self.exclude_file, "")}
        if which not in table:
            return F.lit(False)
        text, yes, no, sep = table[which]
        bad = _any([rule(text, p, sep) for p in no])
        good = _any([rule(text, p, sep) for p in yes])
        out = F.lit(True) if good is None else good
        return out if bad is None else out & ~bad

    def match(self, url: Column) -> Column:
        return self.part(url, "url") & self.part(url, "host") & self.part(url, "dir") & self.part(url, "file")


#: Files that are likely HTML pages.
PAGE_FILES = Pattern(file=["", "*.htm", "*.html", "*.?htm?", "/^[^.]*$/", "*.{php,jsp,aspx,asp,cgi,do}"])


class Router:
    """Values by pattern. ``= text`` matches exactly; otherwise the wildcard pattern with the longest
    literal beginning (then most literals) is chosen, at once if it is marked ``^~ ``; else the first
    matching ``~ regex`` in order, and the wildcard pattern if there is none."""

    def __init__(self):
        self.exact: list[tuple[str, object]] = []
        self.wild: list[tuple[str, object, bool]] = []
        self.regex: list[tuple[str, object]] = []

    def add(self, pattern: str, value) -> "Router":
        if pattern.startswith("= "):
            self.exact.append((pattern[2:], value))
        elif pattern.startswith("^~ "):
            self.wild.append((pattern[3:], value, True))
        elif pattern.startswith("~ "):
            self.regex.append((pattern[2:], value))
        else:
            self.wild.append((pattern, value, False))
        return self

    @staticmethod
    def _precision(pattern: str) -> tuple[int, int]:
        return len(re.split(r"[*?\[{]", pattern, maxsplit=1)[0]), len(re.sub(r"[*?]", "", pattern))

    def get(self, text: Column) -> Column:
        """Column of the value, null where nothing matches."""
        ordered = sorted(self.wild, key=lambda w: self._precision(w[0]), reverse=True)
        wild, final = F.lit(None), F.lit(False)
        for p, v, stop in reversed(ordered):
            hit = text.rlike(glob_regex(p))
            wild, final = F.when(hit, F.lit(v)).otherwise(wild), F.when(hit, F.lit(stop)).otherwise(final)
        out = wild
        for p, v in reversed(self.regex):
            out = F.when(text.rlike(p), F.lit(v)).otherwise(out)
        out = F.when(final, wild).otherwise(out)
        for p, v in reversed(self.exact):
            out = F.when(text == p, F.lit(v)).otherwise(out)
        return out

    def allowed(self, text: Column) -> Column:
        """Routers of booleans deny by default."""
        return F.coalesce(self.get(text).cast("boolean"), F.lit(False))


@dataclass
class Routes:
    """The tables of a crawl's routes and the predicates made of them."""

    admit: Router = field(default_factory=Router)
    nofollow: Router = field(default_factory=Router)
    score: Router = field(default_factory=Router)
    visits: Router = field(default_factory=Router)
    depth: Router = field(default_factory=Router)
    interval: Router = field(default_factory=Router)
    client: Router = field(default_factory=Router)

    def allow(self, pattern: str) -> None:
        self.admit.add(pattern, True)

    def disallow(self, pattern: str) -> None:
        self.admit.add(pattern, False)

    def follows(self, url: Column, depth: Column) -> Column:
        """Whether the links of a page are followed."""
        stop = F.coalesce(self.nofollow.get(url).cast("boolean"), F.lit(False))
        deepest = self.depth.get(url).cast("int")
        return ~stop & F.coalesce(depth < deepest, F.lit(True))

    def spacing(self, host: Column, default_us: int = 0) -> Column:
        """Microseconds between visits of a host."""
        return F.coalesce(self.interval.get(host).cast("long"), F.lit(default_us).cast("long"))

    def request(self, url: Column, method: str = "GET") -> Column:
        """Request of a URL by the client of its route."""
        return use(request(url, method), self.client.get(url))

    def ticket(self, url: Column) -> Column:
        return F.coalesce(self.score.get(url).cast("int"), F.lit(0))

    def again(self, url: Column, visited: Column) -> Column:
        """Whether a page visited so often is visited again."""
        return F.coalesce(visited < self.visits.get(url).cast("int"), F.lit(False))


def depth_score(depth: Column) -> Column:
    """Priority that falls with depth."""
    return F.lit(1000) - depth * 100
