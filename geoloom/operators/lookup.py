"""Joins that add names and areas to places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.names import common_name, rule_values
from geoloom.operators.merge import first_of


def one_per_code(df: DataFrame, code: str, order: str) -> DataFrame:
    """A lookup table with one row for each code, the smallest by ``order``, so that joins never multiply rows."""
    return first_of(df.where(F.col(code).isNotNull()), [code], [F.asc(order)])


def country_names(divisions: DataFrame) -> DataFrame:
    """(country, country_name, country_common, country_short) from the country divisions."""
    rows = divisions.where("subtype = 'country'").select("country", "id", F.col("names.primary").alias("country_name"), common_name(F.col("names.common")).alias("country_common"), rule_values(F.col("names.rules"), "short", english=True).alias("country_short"))
    return one_per_code(rows, "country", "id").drop("id")


def region_names(divisions: DataFrame) -> DataFrame:
    rows = divisions.where("subtype = 'region'").select("region", "id", F.col("names.primary").alias("region_name"))
    return one_per_code(rows, "region", "id").drop("id")


def smallest_area(divisions: DataFrame, areas: DataFrame, key: str, area: Column) -> DataFrame:
    """Divisions joined with their smallest area; those without one go."""
    return divisions.join(first_of(areas.withColumn("__a", area), [key], [F.asc("__a")]).drop("__a"), key)
