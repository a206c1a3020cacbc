"""The engine as one object: the calls of a geocoding client, over tables of requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geo import area_confidence
from geoloom.functions.wkb import as_geojson, covers, measures
from geoloom.operators import nearby as near
from geoloom.operators import refine as fine
from geoloom.operators.bm25 import TextIndex
from geoloom.operators.merge import first_of
from geoloom.operators.reverse import candidates, reverse
from geoloom.plans import search as forward
from geoloom.sources import output
from geoloom.sources.readers import by_id


@dataclass
class Gazetteer:
    """Tables and index behind the calls.

    ``places``: shard_id, gers_id, name, type, country, region, population, lat, lon, box, search_text.  ``divisions``: the
    reverse table.  ``geometries``: gers_id, geometry (WKB).  ``pois`` and ``addresses``: gers_id, lat, lon[, category].  ``catalog``: shard statistics.
    """

    places: DataFrame
    index: TextIndex
    catalog: DataFrame | None = None
    divisions: DataFrame | None = None
    geometries: DataFrame | None = None
    pois: DataFrame | None = None
    addresses: DataFrame | None = None

    @classmethod
    def of(cls, places: DataFrame, **tables: DataFrame) -> Gazetteer:
        return cls(places, TextIndex.build(places, "search_text", "gers_id", "shard_id"), **tables)

    def search(self, queries: DataFrame) -> DataFrame:
        """Ranked results for each query: over HEAD and the shards of its location if there is a catalog, else over all shards."""
        rows = self.places.drop("search_text")
        if self.catalog is None:
            return forward.search(queries, self.index, rows)
        return forward.search_sharded(queries, self.catalog, self.index, rows)

    def search_json(self, queries: DataFrame, debug: bool = False) -> DataFrame:
        """(query_id, body) for every query, also those that find nothing."""
        told = forward.debug_shards(queries, self.places, self.catalog) if debug and self.catalog is not None else None
        found = output.json_responses(self.search(queries), debug=told)
        return queries.select("query_id").join(found, "query_id", "left").withColumn("body", F.coalesce("body", F.lit('{"results":[]}')))

    def search_geojson(self, queries: DataFrame) -> DataFrame:
        found = output.geojson_responses(self.search(queries))
        return queries.select("query_id").join(found, "query_id", "left").withColumn("body", F.coalesce("body", F.lit('{"type":"FeatureCollection","features":[]}')))

    def geocode(self, texts: DataFrame) -> DataFrame:
        """The best place for each text."""
        return forward.first_hits(texts, self.index, self.places.drop("search_text"))

    def count(self) -> int:
        return self.places.count()

    def reverse(self, points: DataFrame) -> DataFrame:
        """The smallest place around each point with its hierarchy; points in no place are absent."""
        return reverse(points, self.divisions)

    def reverse_geocode(self, points: DataFrame) -> DataFrame:
        """(point_id, name) of the smallest place; null for a point in no place."""
        return points.select("point_id").join(self.reverse(points).select("point_id", "name"), "point_id", "left")

    def reverse_geojson(self, points: DataFrame) -> DataFrame:
        """(point_id, body): a feature for each point that lies in some place."""
        feature = F.struct(
            F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
            F.struct("gers_id", "name", "subtype", "distance_km", "confidence", "hierarchy").alias("properties"), F.array("xmin", "ymin", "xmax", "ymax").alias("bbox"),
        )
        return self.reverse(points).select("point_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("body"))

    def containing(self, points: DataFrame, verify: bool = False, verify_limit: int = 10) -> DataFrame:
        """(point_id, rank, gers_id, confidence): all places around each point, the smallest first; with ``verify`` checked against their polygons."""
        found = candidates(points, self.divisions).select("point_id", F.col("nth").alias("rank"), "gers_id", area_confidence(F.col("area")).alias("confidence"), "p_lat", "p_lon")
        if verify:
            inside = covers("geometry", "p_lon", "p_lat")
            shapes = self.geometries.select("gers_id", "geometry", measures("geometry")["type"].alias("__type"))
            found = fine.refine(found, shapes, inside, F.col("__type").isNull(), verify_limit)
        return found.drop("p_lat", "p_lon")

    def geometry(self, ids: DataFrame) -> DataFrame:
        """(gers_id, geojson) of the features asked for."""
        return by_id(self.geometries, ids).select("gers_id", as_geojson("geometry").alias("geojson"))

    def verify_contains_point(self, pairs: DataFrame) -> DataFrame:
        """(gers_id, p_lat, p_lon, contains): whether the feature's polygon holds the point; null without a readable one."""
        return pairs.join(self.geometries.select("gers_id", "geometry"), "gers_id", "left").withColumn("contains", covers("geometry", "p_lon", "p_lat")).drop("geometry")

    def nearby_places(self, points: DataFrame, radius_km: float = 1.0, limit: int = 10, category: str | None = None) -> DataFrame:
        return near.nearby(points, self.pois, radius_km, limit, category)

    def nearby_addresses(self, points: DataFrame, radius_km: float = 0.5, limit: int = 10) -> DataFrame:
        return near.nearby(points, self.addresses, radius_km, limit)

    def reverse_and_refine(self, points: DataFrame, verify: bool = True, radius_km: float = 0.5, limit: int = 5) -> DataFrame:
        """(point_id, divisions, places, addresses) of every point; branches without a table are null."""
        around = self.containing(points, verify and self.geometries is not None)
        pois = None if self.pois is None else self.nearby_places(points, radius_km, limit).select("point_id", "rank", "gers_id", "distance_km")
        homes = None if self.addresses is None else self.nearby_addresses(points, radius_km, limit).select("point_id", "rank", "gers_id", "distance_km")
        return points.select("point_id").join(fine.reverse_and_refine(around, pois, homes), "point_id", "left")

    def best_of_each(self, results: DataFrame) -> DataFrame:
        return first_of(results, ["query_id"], [F.asc("rank")])
