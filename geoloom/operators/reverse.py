"""Reverse geocoding: points to the smallest place around them and its hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import area_confidence, haversine
from geoloom.operators.grid import points_in_boxes
from geoloom.operators.merge import first_of, top_of

# Place types, the most specific first.
PRIORITY = {"neighborhood": 1, "macrohood": 2, "locality": 3, "localadmin": 4, "county": 5, "region": 6, "country": 7}
CANDIDATES = 50


def priority(subtype: Column) -> Column:
    """The place type's place in the order, case ignored; null for an unknown type."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.lower(subtype))


def division_type(raw: Column) -> Column:
    """The place type in lower case, whatever the case given; null for an unknown one."""
    return F.when(priority(raw).isNotNull(), F.lower(raw))


def candidates(points: DataFrame, places: DataFrame, keep: int = CANDIDATES) -> DataFrame:
    """Places whose box holds a point (point_id, p_lat, p_lon): the ``keep`` smallest, then one row for each gers_id.

    Ties in area go by gers_id.  The cut comes before the deduplication.
    """
    found = points_in_boxes(points, places)
    cut = top_of(found, ["point_id"], [F.asc("area"), F.asc("gers_id")], keep, "nth")
    return first_of(cut, ["point_id", "gers_id"], [F.asc("nth")])


def most_specific(cands: DataFrame) -> DataFrame:
    """The smallest place of each point with distance_km and confidence; points in no place are absent."""
    one = first_of(cands, ["point_id"], [F.asc("nth")])
    return one.withColumn("distance_km", haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).withColumn("confidence", area_confidence(F.col("area")))


def hierarchy(cands: DataFrame) -> DataFrame:
    """(point_id, level, subtype, gers_id, name): the smallest place of each known type, the most specific type first."""
    known = cands.withColumn("level", priority(F.col("subtype"))).where("level IS NOT NULL")
    return first_of(known, ["point_id", "level"], [F.asc("nth")]).select("point_id", F.col("level").cast("long").alias("level"), "subtype", "gers_id", "name")


def reverse(points: DataFrame, places: DataFrame) -> DataFrame:
    """One row for each point in some place, with its hierarchy as an array of (gers_id, subtype, name)."""
    cands = candidates(points, places)
    steps = hierarchy(cands).groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("level", "gers_id", "subtype", "name"))).alias("steps"))
    nested = F.transform("steps", lambda s: F.struct(s["gers_id"].alias("gers_id"), s["subtype"].alias("subtype"), s["name"].alias("name")))
    return most_specific(cands).join(steps, "point_id", "left").withColumn("hierarchy", F.coalesce(nested, F.array().cast("array<struct<gers_id:string,subtype:string,name:string>>"))).drop("steps", "nth")


def reverse_sharded(points: DataFrame, places: DataFrame) -> DataFrame:
    """Like :func:`most_specific`, from the point's country shard if it finds anything there, else from HEAD.

    ``points`` also has ``country``, which may be null; ``places`` has ``shard_id``.
    """
    found = points_in_boxes(points.withColumnRenamed("country", "p_country"), places)
    tier = F.when(F.col("shard_id") == F.col("p_country"), 0).when(F.col("shard_id") == "HEAD", 1)
    ranked = found.withColumn("tier", tier).where("tier IS NOT NULL")
    cut = top_of(ranked, ["point_id", "tier"], [F.asc("area"), F.asc("gers_id")], CANDIDATES, "nth")
    best = first_of(cut, ["point_id"], [F.asc("tier"), F.asc("nth")])
    return best.withColumn("distance_km", haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).withColumn("confidence", area_confidence(F.col("area")))
