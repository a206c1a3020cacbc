"""Places, points and queries derived from plain business tables, in Spark and as the same SQL.

The tables have no coordinates, so integer arithmetic on their keys gives them some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources.readers import read_table

TYPES = ("neighborhood", "macrohood", "locality", "localadmin", "county", "region", "country")
HALF = (0.04, 0.1, 0.4, 0.8, 1.5, 3.0, 8.0)
WORDS = ("north", "south", "east", "west", "upper", "lower", "new", "old", "great", "little", "saint")
NOUNS = ("bridge", "ford", "haven", "mill", "field", "gate", "river")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place for each customer: gers_id, name, subtype, country, region, population, lat, lon, box, area, search_text."""
    c, n, r = (read_table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    k = F.col("c_custkey")
    # one after the other: the size of a join is guessed too high for the broadcast that either gets by itself
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        F.concat(F.lit("p"), F.lpad(k.cast("string"), 12, "0")).alias("gers_id"),
        k.alias("key"),
        F.concat_ws(" ", pick(WORDS, k % 11), pick(NOUNS, k % 7)).alias("name"),
        pick(TYPES, k % 7).alias("subtype"),
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country"),
        F.when(k % 13 != 0, F.concat(F.lit("C"), F.col("n_nationkey").cast("string"), F.lit("-R"), (k % 5).cast("string"))).alias("region"),
        F.col("r_name").alias("continent"),
        F.when(k % 10 != 0, F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("population"),
        (((k * 7919) % 17000).cast("double") / F.lit(100.0) - F.lit(85.0)).alias("lat"),
        (((k * 104729) % 36000).cast("double") / F.lit(100.0) - F.lit(180.0)).alias("lon"),
        pick(HALF, k % 7).alias("half"),
    )
    h = F.col("half")
    return rows.select(
        "*", (F.col("lon") - h).alias("xmin"), (F.col("lat") - h).alias("ymin"), (F.col("lon") + h).alias("xmax"), (F.col("lat") + h).alias("ymax"),
        (4 * h * h).alias("area"), F.lower(F.concat_ws(" ", "name", "continent", "country", "region")).alias("search_text"),
    )


def _choice(values: tuple, index: str) -> str:
    return f"list_extract([{', '.join(repr(v) if isinstance(v, str) else f'CAST({v} AS DOUBLE)' for v in values)}], CAST({index} + 1 AS INT))"


PLACES_SQL = f"""
    places0 AS (
        SELECT 'p' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS gers_id, c_custkey AS key,
               {_choice(WORDS, 'c_custkey % 11')} || ' ' || {_choice(NOUNS, 'c_custkey % 7')} AS name,
               {_choice(TYPES, 'c_custkey % 7')} AS subtype,
               'C' || CAST(n_nationkey AS VARCHAR) AS country,
               CASE WHEN c_custkey % 13 <> 0 THEN 'C' || CAST(n_nationkey AS VARCHAR) || '-R' || CAST(c_custkey % 5 AS VARCHAR) END AS region,
               r_name AS continent,
               CASE WHEN c_custkey % 10 <> 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END AS population,
               CAST((c_custkey * 7919) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE) AS lat,
               CAST((c_custkey * 104729) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon,
               {_choice(HALF, 'c_custkey % 7')} AS half
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    ),
    places AS (
        SELECT *, lon - half AS xmin, lat - half AS ymin, lon + half AS xmax, lat + half AS ymax, 4 * half * half AS area,
               lower(concat_ws(' ', name, continent, country, region)) AS search_text
        FROM places0
    )"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each supplier: point_id, p_lat, p_lon, country."""
    k = F.col("s_suppkey")
    return read_table(spark, sf_dir, "supplier").select(
        k.alias("point_id"),
        (((k * 7907) % 17000).cast("double") / F.lit(100.0) - F.lit(85.0)).alias("p_lat"),
        (((k * 104723) % 36000).cast("double") / F.lit(100.0) - F.lit(180.0)).alias("p_lon"),
        F.when(k % 4 != 0, F.concat(F.lit("C"), F.col("s_nationkey").cast("string"))).alias("country"),
    )


POINTS_SQL = """
    points AS (
        SELECT s_suppkey AS point_id,
               CAST((s_suppkey * 7907) % 17000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(85 AS DOUBLE) AS p_lat,
               CAST((s_suppkey * 104723) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS p_lon,
               CASE WHEN s_suppkey % 4 <> 0 THEN 'C' || CAST(s_nationkey AS VARCHAR) END AS country
        FROM supplier
    )"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(12742.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) "
        f"+ cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )
