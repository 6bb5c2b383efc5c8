"""URL parts, coordinates in URLs, identifiers in links. Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.bind import bound


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded twice as nested links need it."""
    raw = F.try_parse_url(url, F.lit("QUERY"), F.lit(name))
    return F.try_url_decode(F.try_url_decode(raw))


def https(url: Column) -> Column:
    return F.regexp_replace(url, "^http://", "https://")


def is_category_link(url: Column, of_host: str) -> Column:
    return F.coalesce((host(url) == of_host) & F.startswith(F.try_parse_url(url, F.lit("PATH")), F.lit("/wiki/Category:")), F.lit(False))


def is_geo_link(url: Column, hosts: tuple[str, ...]) -> Column:
    """A link to a map service that carries coordinates."""
    known = F.lit(False)
    for h in hosts:
        known = known | F.contains(host(url), F.lit(h))
    return F.coalesce(known & F.contains(url, F.lit("params=")), F.lit(False))


def entity_id(url: Column) -> Column:
    """Q and digits after a slash, null where there are none."""
    return F.nullif(F.regexp_extract(url, r"/(Q\d+)(?:[^0-9]|$)", 1), F.lit(""))


def heading(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^Category:\s*", "")


def _place(tokens: Column, *marks: str) -> Column:
    return F.array_position(F.transform(tokens, lambda t: t.isin(*marks)), True).cast("int")


def _decimal(parts: Column, hemisphere: Column) -> Column:
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    whole = F.abs(number(1)) + F.coalesce(number(2), F.lit(0.0)) / 60 + F.coalesce(number(3), F.lit(0.0)) / 3600
    sign = F.when(hemisphere.isin("S", "W"), -1.0).otherwise(1.0) * F.when(number(1) < 0, -1.0).otherwise(1.0)
    bad = F.exists(F.slice(parts, 1, 3), lambda p: p.try_cast("double").isNull())
    return F.when(~bad & (F.size(parts) > 0), whole * sign)


def coordinates(value: Column) -> Column:
    """struct(latitude, longitude) of degrees, minutes and seconds with hemispheres between underscores.

    A comma is a decimal point; a negative degree turns the sign once more; null where a hemisphere or a number is missing."""
    tokens = F.filter(F.split(F.replace(value, F.lit(","), F.lit(".")), "_"), lambda t: t != "")

    def parts(t: Column) -> Column:
        return bound(_place(t, "N", "S"), lambda at: bound(F.slice(t, at + 1, F.greatest(F.size(t) - at, F.lit(0))), lambda rest: bound(_place(rest, "E", "W"), lambda end: both(t, at, rest, end))))

    def both(t: Column, at: Column, rest: Column, end: Column) -> Column:
        found = (at > 1) & (end > 1)
        lat = bound(F.slice(t, 1, F.greatest(at - 1, F.lit(0))), lambda p: _decimal(p, F.try_element_at(t, at)))
        lon = bound(F.slice(rest, 1, F.greatest(end - 1, F.lit(0))), lambda p: _decimal(p, F.try_element_at(rest, end)))
        return F.struct(F.when(found, lat).alias("latitude"), F.when(found, lon).alias("longitude"))

    return bound(tokens, parts)
