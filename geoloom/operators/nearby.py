"""The nearest features around points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import circle_boxes, haversine
from geoloom.operators.grid import points_in_boxes
from geoloom.operators.merge import top_of


def nearby(points: DataFrame, features: DataFrame, radius_km: float = 1.0, limit: int = 10, category: str | None = None) -> DataFrame:
    """Features (gers_id, lat, lon[, category]) within ``radius_km`` of points (point_id, p_lat, p_lon), nearest first.

    Exact: all features within the radius compete, across the antimeridian and near the poles too.
    The circle's boxes select candidates through the grid.
    """
    if category is not None:
        features = features.where(F.col("category") == category)
    boxes = points.withColumn("__box", F.explode(circle_boxes(F.col("p_lat"), F.col("p_lon"), F.lit(float(radius_km)))))
    boxes = boxes.select(*points.columns, *(F.col(f"__box.{c}").alias(f"__{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    found = points_in_boxes(features, boxes, "lat", "lon", "__xmin", "__ymin", "__xmax", "__ymax").drop("__xmin", "__ymin", "__xmax", "__ymax")
    near = found.withColumn("distance_km", haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).where(F.col("distance_km") <= radius_km)
    return top_of(near, ["point_id"], [F.round("distance_km", 9), F.asc("gers_id")], limit)
