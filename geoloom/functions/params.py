"""Request parameters as columns: parsing, defaults, limits and error texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of requests, and the forms of codes.
MAX_QUERY_BYTES = 200
DEFAULT_LIMIT, MAX_LIMIT = 10, 40
MAX_POPULATION = 10_000_000_000
COUNTRY = "[A-Z]{2}"
REGION = "[A-Z]{2}-[A-Z0-9]{1,3}"


def limit(raw: Column, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> Column:
    """A requested whole number, the default if it is none, at most 40."""
    number = F.when(raw.rlike(r"^\+?\d+$"), raw.try_cast("bigint"))
    return F.least(F.coalesce(number, F.lit(default)), F.lit(most))


def flag(raw: Column, default: bool) -> Column:
    """True exactly for "1" and "true"; the default if absent."""
    return F.coalesce(raw.isin("1", "true"), F.lit(default))


def coordinate(raw: Column, most: float) -> Column:
    """The number if it is one within bounds, ends included, else null."""
    value = raw.try_cast("double")
    return F.when(value.between(-most, most), value)


def query_error(text: Column) -> Column:
    """Why a query text is refused, else null.  White space alone is allowed and finds nothing."""
    return F.when(text.isNull() | (text == ""), "missing query").when(F.octet_length(text) > MAX_QUERY_BYTES, "query too long")


def point_error(lat: Column, lon: Column) -> Column:
    """Why a pair of coordinates, as text, is refused, else null."""
    y, x = lat.try_cast("double"), lon.try_cast("double")
    return F.when(y.isNull(), "bad lat").when(x.isNull(), "bad lon").when(~y.between(-90.0, 90.0), "lat out of range").when(~x.between(-180.0, 180.0), "lon out of range")


def is_country(code: Column) -> Column:
    return F.coalesce(code.rlike(f"^{COUNTRY}$"), F.lit(False))


def is_region(code: Column) -> Column:
    return F.coalesce(code.rlike(f"^{REGION}$"), F.lit(False))


def _checked(value, good: bool, what: str):
    if not good:
        raise ValueError(f"{what}: {value!r}")
    return value


def checked_country(code: str) -> str:
    return _checked(code, re.fullmatch(COUNTRY, code) is not None, "not a country code")


def checked_region(code: str) -> str:
    return _checked(code, re.fullmatch(REGION, code) is not None, "not a region code")


def checked_threshold(n: int) -> int:
    return _checked(n, 0 <= n <= MAX_POPULATION, "population threshold out of range")


def query_pairs(url: Column) -> Column:
    """An array of (key, value) of the query string in a URL: "+" is a space, bytes are percent-encoded; a key without "=" has an empty value."""
    part = F.filter(F.split(F.substring_index(F.regexp_extract(url, r"\?(.*)$", 1), "#", 1), "&"), lambda x: x != "")
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    return F.transform(part, lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("key"), F.when(F.contains(x, F.lit("=")), plain(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("value")))


def param(pairs: Column, name: str) -> Column:
    """The last value of a key, null without one."""
    return F.try_element_at(F.filter(pairs, lambda p: p["key"] == name), F.lit(-1))["value"]


def search_request(requests: DataFrame, url: str = "url") -> DataFrame:
    """Queries from requests (request columns, url, header_country, header_lat, header_lon).

    Adds text, error, limit, autocomplete, format ("geojson" or "json"), debug and the location: the coordinates of the URL
    take the place of the header's if it has both, even if they cannot be read; the country is always the header's.
    """
    rows = requests.withColumn("__pairs", query_pairs(F.col(url)))
    get = lambda name: param(F.col("__pairs"), name)
    own = get("lat").isNotNull() & get("lon").isNotNull()
    at = lambda name, header: F.when(own, get(name).try_cast("double")).otherwise(F.col(header).try_cast("double"))
    added = {
        "text": get("q"), "error": query_error(get("q")), "limit": limit(get("limit")), "autocomplete": flag(get("autocomplete"), True),
        "format": F.when(get("format") == "geojson", "geojson").otherwise("json"), "debug": flag(get("debug"), False),
        "bias_country": F.col("header_country"), "bias_lat": at("lat", "header_lat"), "bias_lon": at("lon", "header_lon"),
    }
    return rows.withColumns(added).drop("__pairs")
