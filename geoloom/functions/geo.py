"""Distances, boxes and rings as column expressions.  Boxes are (xmin, ymin, xmax, ymax) in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
DECAY_KM = 100.0
MAX_DISTANCE_BOOST = 0.2
HIGH_CONFIDENCE_AREA, MEDIUM_CONFIDENCE_AREA = 0.01, 0.1


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` held between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; rounding never leaves the arcsine's domain."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def distance_to_bbox(lat: Column, lon: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """0 inside the box, else the distance to the nearest point of it; no antimeridian handling."""
    return haversine(lat, lon, F.greatest(ymin, F.least(ymax, lat)), F.greatest(xmin, F.least(xmax, lon)))


def distance_decay(km: Column) -> Column:
    """A boost of 0.2 at no distance, half of it at 100 km."""
    return F.lit(MAX_DISTANCE_BOOST) / (1 + km / DECAY_KM)


def radius_to_bbox(lat: Column, lon: Column, radius_km: Column) -> tuple[Column, Column, Column, Column]:
    """A box around a circle; at the poles the longitude span becomes the whole world."""
    dlat = radius_km / KM_PER_DEGREE
    dlon = F.least(F.coalesce(F.try_divide(radius_km, F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat))), F.lit(360.0)), F.lit(360.0))
    return lon - dlon, lat - dlat, lon + dlon, lat + dlat


def circle_boxes(lat: Column, lon: Column, radius_km: Column) -> Column:
    """An array of boxes (xmin, ymin, xmax, ymax) that surely hold a circle: two if it meets the antimeridian, all longitudes near a pole.

    No two of them overlap but at their edges.
    """
    dlat = radius_km / KM_PER_DEGREE
    top = F.abs(lat) + dlat
    dlon = F.when(top < 89.0, dlat / F.cos(F.radians(F.least(top, F.lit(89.0))))).otherwise(F.lit(360.0))
    box = lambda a, b: F.struct(a.alias("xmin"), (lat - dlat).alias("ymin"), b.alias("xmax"), (lat + dlat).alias("ymax"))
    west, east = lon - dlon, lon + dlon
    return (
        F.when(dlon >= 180.0, F.array(box(F.lit(-180.0), F.lit(180.0))))
        .when(west < -180.0, F.array(box(F.lit(-180.0), east), box(west + 360.0, F.lit(180.0))))
        .when(east > 180.0, F.array(box(west, F.lit(180.0)), box(F.lit(-180.0), east - 360.0)))
        .otherwise(F.array(box(west, east)))
    )


def in_bbox(lat: Column, lon: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a point lies in a box, edges included."""
    return (xmin <= lon) & (xmax >= lon) & (ymin <= lat) & (ymax >= lat)


def area_confidence(area: Column) -> Column:
    """``high``, ``medium`` or ``low``, by the area in square degrees of the smallest match."""
    return F.when(area < HIGH_CONFIDENCE_AREA, "high").when(area < MEDIUM_CONFIDENCE_AREA, "medium").otherwise("low")


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring, an array of structs (x, y), closed or not.

    An edge counts if exactly one of its ends is above the point and it crosses to the right;
    level edges therefore never divide by zero.  A point on an edge may go either way.
    """
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        spans = (a["y"] > lat) != (b["y"] > lat)
        at = F.try_divide((b["x"] - a["x"]) * (lat - a["y"]), b["y"] - a["y"]) + a["x"]
        return F.when(spans & (lon < at), 1).otherwise(0)

    hits = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + crosses(i))
    return F.when(n < 3, F.lit(False)).otherwise(hits % 2 == 1)


def point_in_rings(lon: Column, lat: Column, rings: Column, holes: bool = True) -> Column:
    """Against a polygon's rings, the outer one first; with ``holes`` a point in an inner ring is outside."""
    outer = point_in_ring(lon, lat, F.element_at(rings, 1))
    if not holes:
        return F.when(F.size(rings) < 1, F.lit(False)).otherwise(outer)
    inner = F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: point_in_ring(lon, lat, r))
    return F.when(F.size(rings) < 1, F.lit(False)).otherwise(outer & ~inner)
