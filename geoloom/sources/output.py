"""Results as JSON and GeoJSON strings, one response for each query, and as text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _box() -> Column:
    return F.array("xmin", "ymin", "xmax", "ymax")


def json_item() -> Column:
    """A result without its null fields; population is not shown."""
    return F.struct("gers_id", "name", "type", "lat", "lon", _box().alias("bbox"), "importance", "country", "region")


def geojson_item() -> Column:
    """A feature; null properties are kept."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct("gers_id", "name", "type", "importance", "country", "region")
    return F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"), _box().alias("bbox"))


def _in_order(df: DataFrame, item: Column, key: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("rank"), item.alias("item"))))
    return df.groupBy(key).agg(F.transform(rows, lambda r: r["item"]).alias("items"))


def json_responses(df: DataFrame, key: str = "query_id", debug: DataFrame | None = None) -> DataFrame:
    """(query_id, body): ``{"results": [...]}`` in rank order, with a debug object if one is given for the query."""
    lists = _in_order(df, json_item(), key)
    if debug is None:
        return lists.select(key, F.to_json(F.struct(F.col("items").alias("results"))).alias("body"))
    return lists.join(debug, key, "left").select(key, F.to_json(F.struct(F.col("items").alias("results"), "debug")).alias("body"))


def geojson_responses(df: DataFrame, key: str = "query_id") -> DataFrame:
    lists = _in_order(df, geojson_item(), key)
    body = F.struct(F.lit("FeatureCollection").alias("type"), F.col("items").alias("features"))
    return lists.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def text_lines(df: DataFrame) -> DataFrame:
    """A printed line for each result."""
    return df.select("*", F.format_string("%d. %s (%s, %s) [%.4f, %.4f] importance %.3f", F.col("rank"), F.col("name"), F.col("type"), F.coalesce("country", F.lit("??")), F.col("lat"), F.col("lon"), F.col("importance")).alias("line"))
