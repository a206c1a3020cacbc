"""Display names and search texts of places and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def region_code(country: Column, region: Column) -> Column:
    """The region as shown: without its prefix in the United States."""
    return F.when((country == "US") & region.isNotNull(), F.replace(region, F.lit("US-"), F.lit(""))).otherwise(region)


def primary_name(name: Column, country: Column, region: Column) -> Column:
    """"Name, MA" in the United States, else "Name, GB-ENG", else "Name, CC"; a null part is empty."""
    tail = F.coalesce(region_code(country, region), country)
    return F.concat_ws("", name, F.lit(", "), tail)


def rule_values(rules: Column, variant: str, english: bool = False) -> Column:
    """The values of one variant without a language, or with ``english`` also those whose language begins with "en", joined by spaces."""
    fits = lambda r: r["language"].isNull() | (r["language"].startswith("en") if english else F.lit(False))
    return F.coalesce(F.array_join(F.transform(F.filter(rules, lambda r: (r["variant"] == variant) & fits(r)), lambda r: r["value"]), " "), F.lit(""))


def common_name(common: Column, language: str = "en") -> Column:
    return F.coalesce(F.try_element_at(common, F.lit(language)), F.lit(""))


def distinct_words(*parts: Column) -> Column:
    """The parts' distinct words in order of first appearance, then in lower case (so "Paris paris" keeps both)."""
    words = F.array_distinct(F.filter(F.split(F.concat_ws(" ", *parts), " "), lambda w: w != ""))
    return F.lower(F.array_join(words, " "))


def search_text(name: Column, rules: Column, common: Column, country: Column, region: Column, country_name: Column, country_common: Column, country_short: Column, region_name: Column) -> Column:
    """What a place is found by: its names, codes, and the names of its country and region."""
    return distinct_words(
        name,
        rule_values(rules, "short"),
        common_name(common),
        rule_values(rules, "official"),
        rule_values(rules, "alternate", english=True),
        region_code(country, region),
        country,
        country_name,
        country_common,
        country_short,
        region_name,
    )


def level(levels: Column, n: int) -> Column:
    """The value of the n-th address level, from 1; null where there is none."""
    return F.try_element_at(levels, F.lit(n))["value"]


def address_name(number: Column, street: Column, unit: Column, city: Column, postal_city: Column, state: Column, postcode: Column) -> Column:
    line = F.nullif(F.concat_ws(" ", number, street, unit), F.lit(""))
    return F.concat_ws(", ", line, F.coalesce(city, postal_city), F.concat_ws("", state, F.lit(" "), postcode))


def address_text(number: Column, street: Column, city: Column, postal_city: Column, state: Column, postcode: Column) -> Column:
    empty = F.lit("")
    return F.lower(F.concat_ws(" ", F.coalesce(number, empty), F.coalesce(street, empty), F.coalesce(city, postal_city, empty), F.coalesce(state, empty), F.coalesce(postcode, empty), F.lit("us")))
