"""Queries over what a service needs around the search itself: requests, shards, saved indexes, builds, flattened source tables."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from geoloom.api import Gazetteer
from geoloom.functions import geo, params, wkb
from geoloom.operators import shards
from geoloom.operators.bm25 import TextIndex, search_text
from geoloom.operators.reverse import division_type
from geoloom.plans import build
from geoloom.plans import search as forward
from geoloom.plans.oracle import bm25_sql
from geoloom.plans.registry import (
    CANDS_SQL, CODES, FLAGS, LIMITS, LOADED_SQL, PREFIXES, SEARCH_SQL, SEARCHES_SQL, SHARDS_SQL, SIZE_SQL, SPLIT_BYTES, SPOTS, _assigned, _divisions, _pick_sql, _ranked_sql, _renamed, _values, pick, query, r6, searches, size,
)
from geoloom.plans.views import PLACES_SQL, POINTS_SQL, places, points
from geoloom.sources import catalog, readers
from geoloom.sources.scratch import scratch_path, table_from_bytes

# --- search over shards ---


@query(f"""{SHARDS_SQL}, {SEARCHES_SQL}, {LOADED_SQL},
    corpus AS (SELECT shard_id, gers_id AS doc_id, search_text AS text FROM assigned), {bm25_sql('corpus', 'queries')},
    {_ranked_sql('assigned', 'loaded')}
    SELECT query_id, shard_id, gers_id, round(importance, 6) AS importance, rank FROM ranked WHERE rank <= 10""")
def search_sharded(spark, sf_dir):
    p = _assigned(spark, sf_dir)
    index = TextIndex.build(p, "search_text", "gers_id", "shard_id")
    found = forward.search_sharded(searches(spark), shards.shard_stats(p, size()), index, p.drop("search_text"))
    return found.select("query_id", "shard_id", "gers_id", r6("importance"), "rank")


@query(f"""{SHARDS_SQL}, {SEARCHES_SQL}, {LOADED_SQL}
    SELECT DISTINCT query_id, shard_id FROM loaded WHERE contains(shard_id, '-R')""")
def search_missing_shards(spark, sf_dir):
    p = _assigned(spark, sf_dir)
    index = TextIndex.build(p.where(~F.contains("shard_id", F.lit("-R"))), "search_text", "gers_id", "shard_id")
    return forward.missing_shards(searches(spark), shards.shard_stats(p, size()), index, p)


# --- indexes that change, and saved ones ---

CHANGED_SQL = """
    corpus AS (
        SELECT 'ALL' AS shard_id, p_partkey AS doc_id, CASE WHEN p_retailprice > 1500 THEN p_type || ' ' || p_name ELSE p_name END AS text FROM part WHERE p_size <= 40
        UNION ALL SELECT 'ALL', -1 - s_suppkey, s_name FROM supplier
    )"""
CHANGE_QUERIES = [(1, "sm", True), (2, "red widget", False), (3, "supplier", True), (4, "blue", True), (5, "ring", False)]


def _changed(spark, sf_dir) -> tuple[TextIndex, DataFrame]:
    """An index of parts less the large ones, the dear ones replaced, and the suppliers, which are still to be added."""
    part = readers.read_table(spark, sf_dir, "part").select(F.lit("ALL").alias("shard_id"), F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"), "p_type", "p_size", "p_retailprice")
    index = TextIndex.build(part, "text")
    index = index.without(part.where("p_size > 40"))
    dear = part.where("p_retailprice > 1500 AND p_size <= 40").withColumn("text", F.concat_ws(" ", "p_type", "text"))
    suppliers = readers.read_table(spark, sf_dir, "supplier").select(F.lit("ALL").alias("shard_id"), (-1 - F.col("s_suppkey")).alias("doc_id"), F.col("s_name").alias("text"))
    return index.updated(dear, "text"), suppliers


_FOUND_SQL = f"""
    WITH {_values('queries', CHANGE_QUERIES, 'query_id, text, autocomplete')}, {CHANGED_SQL}, {bm25_sql('corpus', 'queries')},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), doc_id) AS rank FROM hits)
    SELECT query_id, doc_id, round(bm25, 6) AS bm25, rank FROM ranked WHERE rank <= 20"""


def _asked(spark, index: TextIndex) -> DataFrame:
    q = spark.createDataFrame(CHANGE_QUERIES, "query_id long, text string, autocomplete boolean")
    return search_text(q, index, 20).select("query_id", "doc_id", r6("bm25"), "rank")


@query(_FOUND_SQL)
def index_update(spark, sf_dir):
    index, suppliers = _changed(spark, sf_dir)
    return _asked(spark, index.updated(suppliers, "text"))


@query(_FOUND_SQL)
def index_saved(spark, sf_dir):
    index, suppliers = _changed(spark, sf_dir)
    path = scratch_path(spark, "index")
    index.write(f"{path}/first")
    TextIndex.build(suppliers, "text").append(f"{path}/first")
    return _asked(spark, TextIndex.compact(spark, f"{path}/first", f"{path}/second"))


# --- builds and the catalog ---


@query(f"""
    WITH {PLACES_SQL}, sized AS (SELECT *, {SIZE_SQL} AS bytes FROM places),
    big AS (SELECT country FROM sized WHERE country IN ('C1', 'C2', 'C3') GROUP BY country HAVING sum(bytes) > {SPLIT_BYTES}),
    rows AS (
        SELECT 'all' AS options, 'HEAD' AS shard_id FROM places WHERE subtype = 'county' OR coalesce(population >= 700000, false)
        UNION ALL SELECT 'all', CASE WHEN country IN (SELECT country FROM big) THEN coalesce(region, country || '-XX') ELSE country END FROM places WHERE country IN ('C1', 'C2', 'C3')
        UNION ALL SELECT 'reverse', country FROM places
        UNION ALL SELECT 'head', 'HEAD' FROM places WHERE subtype IN ('country', 'region', 'county') OR coalesce(population >= 100000, false)
    )
    SELECT options, shard_id, count(*) AS record_count FROM rows GROUP BY ALL""")
def build_options(spark, sf_dir):
    p = places(spark, sf_dir)
    built = {
        "all": build.plan_shards(p, size(), threshold=700_000, countries=("C1", "C2", "C3"), most=SPLIT_BYTES),
        "reverse": build.plan_shards(p, size(), skip_head=True, reverse=True),
        "head": build.plan_shards(p, size(), head_only=True, reverse=True),
    }
    parts = [rows.groupBy("shard_id").agg(F.count(F.lit(1)).alias("record_count")).select(F.lit(name).alias("options"), "shard_id", "record_count") for name, rows in built.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""{SHARDS_SQL}
    SELECT '2025-02-01.0' AS version, shard_id, record_count, size_bytes, round(xmin, 6) AS xmin, round(ymax, 6) AS ymax, record_count AS rows_read,
           count(*) OVER () AS shard_count, CAST(sum(record_count) OVER () AS BIGINT) AS total_records FROM stats""")
def published_catalog(spark, sf_dir):
    root = scratch_path(spark, "catalog")
    assigned = _assigned(spark, sf_dir)
    for version in ("2025-01-01.0", "2025-02-01.0"):
        known = catalog.published_versions(spark, f"{root}/catalog.json")
        catalog.publish(spark, root, version, assigned, shards.shard_stats(assigned, size()), known)
    newest = catalog.latest_version(catalog.read_catalog(spark, f"{root}/catalog.json")).first()["version"]
    told = spark.read.schema("summaries struct<shard_count:bigint,total_records:bigint>").json(f"{root}/{newest}/collection.json", multiLine=True).select("summaries.*")
    read = spark.read.parquet(f"{root}/{newest}/shards").groupBy("shard_id").agg(F.count(F.lit(1)).alias("rows_read"))
    items = catalog.read_collection(spark, f"{root}/{newest}/collection.json").join(read, "shard_id", "left").withColumn("one", F.lit(1))
    return items.join(told.withColumn("one", F.lit(1)), "one").select(F.lit(newest).alias("version"), "shard_id", "record_count", "size_bytes", r6("xmin"), r6("ymax"), "rows_read", "shard_count", "total_records")


@query(f"WITH {PLACES_SQL} SELECT country, gers_id, name FROM places WHERE country = 'C1'")
def shard_from_bytes(spark, sf_dir):
    path = scratch_path(spark, "shard")
    places(spark, sf_dir).where("country = 'C1'").select("country", "gers_id", "name").coalesce(1).write.mode("overwrite").parquet(path)
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("content").first()["content"]  # one shard's file
    return table_from_bytes(spark, bytes(data))


# --- requests ---

FORMATS = ("geojson", "json", "xml", None)
NAMES = ("County", "REGION", "planet", None, "locality", "macroHood", "")


@query(rf"""
    WITH raw AS (
        SELECT event_id, {_pick_sql(LIMITS, 1)} AS lim, {_pick_sql(FLAGS, 2)} AS flag, {_pick_sql(SPOTS, 1)} AS lat, {_pick_sql(SPOTS, 3)} AS lon, {_pick_sql(CODES, 1)} AS code, {_pick_sql(FORMATS, 1)} AS fmt, {_pick_sql(SPOTS, 5)} AS h_lat,
               CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN '' ELSE 'Café & ' || repeat(event_type || ' ', CAST(event_id % 30 AS INT)) END AS q FROM events
    )
    SELECT event_id, q AS text, CASE WHEN q IS NULL OR q = '' THEN 'missing query' WHEN strlen(q) > 200 THEN 'query too long' END AS error,
           least(coalesce(CASE WHEN regexp_full_match(lim, '\+?\d+') THEN TRY_CAST(lim AS BIGINT) END, 10), 40) AS "limit", coalesce(flag IN ('1', 'true'), true) AS autocomplete,
           CASE WHEN fmt = 'geojson' THEN 'geojson' ELSE 'json' END AS format, coalesce(flag IN ('1', 'true'), false) AS debug, code AS bias_country,
           CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN TRY_CAST(lat AS DOUBLE) ELSE TRY_CAST(h_lat AS DOUBLE) END AS bias_lat,
           CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN TRY_CAST(lon AS DOUBLE) ELSE 7.25 END AS bias_lon FROM raw""")
def search_requests(spark, sf_dir):
    raw = readers.read_table(spark, sf_dir, "events").select(
        "event_id", pick(LIMITS, 1).alias("lim"), pick(FLAGS, 2).alias("flag"), pick(SPOTS, 1).alias("lat"), pick(SPOTS, 3).alias("lon"), pick(CODES, 1).alias("header_country"), pick(FORMATS, 1).alias("fmt"), pick(SPOTS, 5).alias("header_lat"),
        F.expr("CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN '' ELSE 'Caf%C3%A9+%26 ' || repeat(event_type || '%20', CAST(event_id % 30 AS INT)) END").alias("q"),
    )
    given = {"q": "q", "limit": "lim", "autocomplete": "flag", "debug": "flag", "format": "fmt", "lat": "lat", "lon": "lon"}
    url = F.concat(F.lit("https://host/search?limit=1&debug&"), F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.replace(F.col(c), F.lit("+"), F.lit("%2B")) if c == "lim" else F.col(c)) for k, c in given.items())))
    # where no limit is given the one at the front holds, so it is left out there
    url = F.when(F.col("lim").isNull(), F.replace(url, F.lit("limit=1&"), F.lit(""))).otherwise(url)
    asked = raw.select("event_id", url.alias("url"), "header_country", "header_lat", F.lit("7.25").alias("header_lon"))
    return params.search_request(asked).select("event_id", "text", "error", F.col("limit").cast("long").alias("limit"), "autocomplete", "format", "debug", "bias_country", "bias_lat", "bias_lon")


@query(f"""
    WITH raw AS (SELECT event_id, {_pick_sql(NAMES, 1)} AS name FROM events)
    SELECT event_id, CASE WHEN lower(name) IN ('neighborhood', 'macrohood', 'locality', 'localadmin', 'county', 'region', 'country') THEN lower(name) END AS type FROM raw""")
def division_types(spark, sf_dir):
    return readers.read_table(spark, sf_dir, "events").select("event_id", division_type(pick(NAMES, 1)).alias("type"))


@query(f"""{CANDS_SQL}
    SELECT points.point_id, first(name) AS name FROM points LEFT JOIN (SELECT * FROM cands WHERE nth = 1) c ON c.point_id = points.point_id GROUP BY points.point_id""")
def reverse_or_nothing(spark, sf_dir):
    p = places(spark, sf_dir)
    return Gazetteer(p, None, divisions=_renamed(p)).reverse_geocode(points(spark, sf_dir).drop("country"))


@query(f"""{SEARCH_SQL}
    SELECT queries.query_id, count(r.gers_id) AS n, min(r.name) FILTER (WHERE r.rank = 1) AS first_name
    FROM queries LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON r.query_id = queries.query_id GROUP BY queries.query_id""")
def client_search(spark, sf_dir):
    p = places(spark, sf_dir).withColumn("shard_id", F.lit("ALL")).withColumn("type", F.col("subtype"))
    body = Gazetteer.of(p).search_json(searches(spark))
    return body.select("query_id", F.json_array_length(F.get_json_object("body", "$.results")).cast("long").alias("n"), F.get_json_object("body", "$.results[0].name").alias("first_name"))


# --- source tables ---


@F.pandas_udf(BinaryType())
def _point(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x, y, strict=True)])


@F.pandas_udf(BinaryType())
def _box(xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
    return pd.Series([wkb.encode("Polygon", [[[w, s], [e, s], [e, n], [w, n], [w, s]]]) for w, s, e, n in zip(xmin, ymin, xmax, ymax, strict=True)])


def _source_divisions(spark, sf_dir) -> DataFrame:
    """Nested divisions with a point, a box and the other columns of a release."""
    p = places(spark, sf_dir).select(F.col("gers_id").alias("__id"), "lat", "lon", "population", F.struct("xmin", "ymin", "xmax", "ymax").alias("bbox"), F.col("subtype").alias("kind"))
    d = _divisions(spark, sf_dir).join(p, F.col("id") == F.col("__id"), "left")
    lat, lon = F.coalesce("lat", F.lit(0.0)), F.coalesce("lon", F.lit(0.0))
    return d.withColumn("geometry", _point(lon, lat)).withColumn("subtype", F.coalesce("kind", "subtype")).withColumns({"version": F.lit(3), "class": F.lit("land")}).drop("__id", "kind", "lat", "lon")


_PRIMARY = "CASE WHEN region IS NOT NULL THEN name || ', ' || region ELSE name || ', ' || country END"


@query(f"""
    WITH {PLACES_SQL}
    SELECT gers_id, 3 AS version, name, subtype AS type, 'land' AS class, population, round(lat, 6) AS lat, round(lon, 6) AS lon, round(xmin, 6) AS xmin, {_PRIMARY} AS primary_name
    FROM places WHERE subtype IN ('locality', 'localadmin', 'neighborhood', 'macrohood', 'county')""")
def flatten_divisions(spark, sf_dir):
    flat = readers.flatten_divisions(_source_divisions(spark, sf_dir))
    return flat.select("gers_id", "version", "name", "type", "class", "population", r6("lat"), r6("lon"), r6("xmin"), "primary_name")


@query(f"""
    WITH {PLACES_SQL}
    SELECT gers_id, subtype, {_PRIMARY} AS name, population, round(lat, 6) AS lat, round(xmin, 6) AS xmin, round(ymax, 6) AS ymax, round(area, 6) AS area FROM places""")
def flatten_reverse_divisions(spark, sf_dir):
    p = places(spark, sf_dir)
    small = p.select(F.col("gers_id").alias("division_id"), _box("xmin", "ymin", "xmax", "ymax").alias("geometry"))
    large = p.select(F.col("gers_id").alias("division_id"), _box(F.col("xmin") - 1, F.col("ymin") - 1, F.col("xmax") + 1, F.col("ymax") + 1).alias("geometry"))
    broken = p.select(F.col("gers_id").alias("division_id"), F.lit(b"?").alias("geometry"))
    flat = readers.reverse_divisions(_source_divisions(spark, sf_dir), small.unionByName(large).unionByName(broken))
    return flat.select("gers_id", "subtype", "name", "population", r6("lat"), r6("xmin"), r6("ymax"), r6("area"))


@query("""
    SELECT 'a' || CAST(s_suppkey AS VARCHAR) AS gers_id, 'S' || CAST(s_nationkey AS VARCHAR) AS state, CASE WHEN s_suppkey % 2 = 0 THEN 'City' END AS city
    FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 0""")
def flatten_addresses(spark, sf_dir):
    value = lambda x: F.struct(x.alias("value"))
    state = value(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")))
    raw = readers.read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_acctbal") > 0, "US").otherwise("CA").alias("country"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(state, value(F.lit("City")))).otherwise(F.array(state)).alias("address_levels"),
        *(F.lit(None).cast("string").alias(c) for c in ("postcode", "street", "number", "unit", "postal_city")),
    )
    return readers.flatten_addresses(raw, "US", "S3").select("gers_id", "state", "city")


@query(f"""WITH {PLACES_SQL} SELECT gers_id, '{{"type": "Point"}}' AS kind, round(lon, 6) AS lon, round(lat, 6) AS lat FROM places WHERE subtype <> 'county'""")
def point_features(spark, sf_dir):
    p = places(spark, sf_dir)
    shapes = p.select("gers_id", F.when(F.col("subtype") == "county", _box("xmin", "ymin", "xmax", "ymax")).otherwise(_point("lon", "lat")).alias("geometry"))
    body = wkb.as_geojson("geometry")
    found = readers.only_points(shapes).select("gers_id", body.alias("body"))
    return found.select(
        "gers_id", F.concat(F.lit('{"type": "'), F.get_json_object("body", "$.type"), F.lit('"}')).alias("kind"),
        r6(F.get_json_object("body", "$.coordinates[0]").cast("double"), "lon"), r6(F.get_json_object("body", "$.coordinates[1]").cast("double"), "lat"),
    )


@query(f"""
    WITH {POINTS_SQL} SELECT point_id, round(p_lat - 5 / 111.0, 6) AS ymin, round(p_lat + 5 / 111.0, 6) AS ymax,
           round(p_lon - 5 / (111.0 * cos(radians(p_lat))), 6) AS xmin, round(p_lon + 5 / (111.0 * cos(radians(p_lat))), 6) AS xmax FROM points""")
def radius_boxes(spark, sf_dir):
    box = geo.radius_to_bbox(F.col("p_lat"), F.col("p_lon"), F.lit(5.0))
    return points(spark, sf_dir).select("point_id", *(r6(c, name) for name, c in zip(("xmin", "ymin", "xmax", "ymax"), box, strict=True))).select("point_id", "ymin", "ymax", "xmin", "xmax")


@query(f"""
    WITH {PLACES_SQL}, {POINTS_SQL}
    SELECT point_id, gers_id, CASE WHEN subtype <> 'county' THEN p_lon + 0.005 > xmin AND p_lon + 0.005 < xmax AND p_lat + 0.005 > ymin AND p_lat + 0.005 < ymax END AS contains
    FROM points JOIN places ON point_id = key""")
def verify_contains_point(spark, sf_dir):
    p = places(spark, sf_dir)
    shapes = p.where("subtype <> 'county'").select("gers_id", _box("xmin", "ymin", "xmax", "ymax").alias("geometry"))
    pairs = points(spark, sf_dir).drop("country").join(p.select(F.col("key").alias("point_id"), "gers_id"), "point_id")
    moved = pairs.withColumns({"p_lat": F.col("p_lat") + 0.005, "p_lon": F.col("p_lon") + 0.005})
    return Gazetteer(p, None, geometries=shapes).verify_contains_point(moved).select("point_id", "gers_id", "contains")
