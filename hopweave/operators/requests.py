"""Requests as struct columns, changed by expressions."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F


def request(url: Column, method: str = "GET") -> Column:
    """struct(url, method, headers, client, cancelled) of a URL column."""
    return F.struct(url.alias("url"), F.lit(method.upper()).alias("method"), F.create_map().cast("map<string,array<string>>").alias("headers"), F.lit(None).cast("string").alias("client"), F.lit(False).alias("cancelled"))


def set_header(req: Column, name: str, value: str | Column) -> Column:
    """Replace a header."""
    v = F.array(F.lit(value) if isinstance(value, str) else value)
    rest = F.map_filter(req["headers"], lambda k, _: F.lower(k) != name.lower())
    return req.withField("headers", F.map_concat(rest, F.create_map(F.lit(name), v)))


def add_header(req: Column, name: str, value: str) -> Column:
    """Add a value to a header."""
    held = F.coalesce(req["headers"][name], F.array().cast("array<string>"))
    rest = F.map_filter(req["headers"], lambda k, _: k != name)
    return req.withField("headers", F.map_concat(rest, F.create_map(F.lit(name), F.concat(held, F.array(F.lit(value))))))


def add_cookie(req: Column, name: str, value: str) -> Column:
    return add_header(req, "Cookie", f"{name}={value}")


def basic_auth(req: Column, user: str, password: str) -> Column:
    return set_header(req, "Authorization", "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode())


def referer(req: Column, url: str | Column) -> Column:
    return set_header(req, "Referer", url)


def user_agent(req: Column, name: str) -> Column:
    return set_header(req, "User-Agent", name)


def use(req: Column, client: str | Column) -> Column:
    return req.withField("client", F.lit(client) if isinstance(client, str) else client.cast("string"))


def cancel(req: Column, when: Column) -> Column:
    """Cancelled requests complete their URL without being sent (``frontier.Controller.prepare``)."""
    return req.withField("cancelled", req["cancelled"] | when)
