"""Scores of search results.  BM25 is negative, the lower the better; importance runs from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.geo import clamp, distance_decay, haversine

# Fixed values.
POPULATION_WEIGHT = 2.0
NO_POPULATION = 2.0
IMPORTANCE_SCALE = 50.0
EXACT_BONUS = 0.1
COUNTRY_BOOST = 0.35
COUNTRY_BOOST_WITH_COORDINATES = 0.25
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6


def boosted_score(bm25: Column, population: Column) -> Column:
    """BM25 less twice the log of the population, or less 2 where none is known or it is not positive."""
    return F.when(population > 0, bm25 - POPULATION_WEIGHT * F.log(population + F.lit(1.0))).otherwise(bm25 - NO_POPULATION)


def importance(boosted: Column) -> Column:
    return clamp(-boosted / IMPORTANCE_SCALE)


def bonus_tokens(query: Column) -> Column:
    """The query's lower-case tokens, split at white space and commas; other punctuation stays."""
    return F.filter(F.split(F.lower(query), r"[\s,]+"), lambda t: t != "")


def has_exact_match(name: Column, query: Column) -> Column:
    """Whether a query token begins the name and ends at its end, a comma or a space (in characters)."""
    low = F.lower(name)
    return F.exists(bonus_tokens(query), lambda t: F.startswith(low, t) & F.substr(low, F.char_length(t) + 1, F.lit(1)).isin("", ",", " "))


def exact_bonus(imp: Column, name: Column, query: Column) -> Column:
    """The importance with 0.1 added, once, where the name begins with a query token as a whole word."""
    return F.when(has_exact_match(name, query), clamp(imp + EXACT_BONUS)).otherwise(imp)


def bias_kind(country: Column, lat: Column, lon: Column) -> Column:
    """Which bias a location gives: ``full``, ``coordinates``, ``country`` or ``none`` (also for a country with half a coordinate)."""
    return (
        F.when(country.isNotNull() & lat.isNotNull() & lon.isNotNull(), "full")
        .when(lat.isNotNull() & lon.isNotNull(), "coordinates")
        .when(country.isNotNull() & lat.isNull() & lon.isNull(), "country")
        .otherwise("none")
    )


def bias_boost(kind: Column, bias_country: Column, bias_lat: Column, bias_lon: Column, country: Column, lat: Column, lon: Column) -> Column:
    same = F.coalesce(country == bias_country, F.lit(False))
    near = distance_decay(haversine(bias_lat, bias_lon, lat, lon))
    return (
        F.when(kind == "country", F.when(same, COUNTRY_BOOST).otherwise(0.0))
        .when(kind == "coordinates", near)
        .when(kind == "full", F.when(same, COUNTRY_BOOST_WITH_COORDINATES).otherwise(0.0) + near)
        .otherwise(0.0)
    )


def idf(docs: Column, with_term: Column) -> Column:
    raw = F.log((docs - with_term + 0.5) / (with_term + 0.5))
    return F.when(raw > 0, raw).otherwise(LEAST_IDF)


def bm25_part(tf: Column, docs: Column, with_term: Column, length: Column, mean_length: Column) -> Column:
    """One phrase's part of the score; ``tf`` and ``with_term`` count the phrase, all expansions of a prefix together."""
    return weighted_part(idf(docs, with_term), tf, length, mean_length)


def weighted_part(weight: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    """:func:`bm25_part` with the phrase's idf as it is known."""
    return -weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
