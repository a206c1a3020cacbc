"""Readers of place data: release folders, nested divisions, areas, addresses and plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.names import address_name, address_text, level, primary_name, search_text
from geoloom.functions.wkb import measures
from geoloom.operators.lookup import country_names, region_names, smallest_area

# The place types of the forward and of the reverse table.
FORWARD_TYPES = ("locality", "localadmin", "neighborhood", "macrohood", "county")
REVERSE_TYPES = ("country", "region", "county", "localadmin", "locality", "macrohood", "neighborhood")

ANONYMOUS_STORE = {
    "spark.hadoop.fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider",
    "spark.hadoop.fs.s3a.endpoint.region": "us-west-2",
}


def anonymous(builder: SparkSession.Builder, memory: str | None = None, threads: int | None = None) -> SparkSession.Builder:
    """A session builder that reads the public store without credentials, with the driver's memory and the threads of a local master."""
    for key, value in ANONYMOUS_STORE.items():
        builder = builder.config(key, value)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return builder.master(f"local[{threads}]") if threads else builder


def forget(spark: SparkSession, path: str) -> None:
    """Drop what the session has cached of the files under a path, so that the next read sees them as they are."""
    spark.catalog.refreshByPath(path)


def some_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """Any ``n`` rows, for a look at a table."""
    return df.limit(n)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files under a path, each read whole by one task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def release_path(root: str, release: str, theme: str, kind: str) -> str:
    """The folder of one type of one release, laid out as theme=/type=."""
    return f"{root.rstrip('/')}/{release}/theme={theme}/type={kind}"


def read_release(spark: SparkSession, root: str, release: str, theme: str, kind: str) -> DataFrame:
    """The table with its partition columns; filters and columns chosen later reach the scan."""
    return spark.read.option("basePath", f"{root.rstrip('/')}/{release}").parquet(release_path(root, release, theme, kind))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_id(features: DataFrame, ids: DataFrame) -> DataFrame:
    """The features whose gers_id is asked for."""
    return features.join(ids.select("gers_id").distinct(), "gers_id", "left_semi")


def in_box(features: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Features whose box meets a box; plain comparisons, so row groups are pruned by their statistics."""
    c = F.col
    return features.where((c("bbox.xmin") <= xmax) & (c("bbox.xmax") >= xmin) & (c("bbox.ymin") <= ymax) & (c("bbox.ymax") >= ymin))


def only_points(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Rows whose WKB geometry is a point, from its type code in either byte order."""
    code = F.when(F.hex(F.substring(geometry, 1, 1)) == "01", F.hex(F.substring(geometry, 2, 1))).otherwise(F.hex(F.substring(geometry, 5, 1)))
    return features.where(code == "01")


def non_empty(df: DataFrame, what: str = "table") -> DataFrame:
    """The table itself; an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def flatten_divisions(divisions: DataFrame) -> DataFrame:
    """The forward table: named divisions of the forward types with display name, search text, point and box."""
    places = divisions.where(F.col("subtype").isin(*FORWARD_TYPES) & F.col("names.primary").isNotNull())
    joined = places.join(country_names(divisions), "country", "left").join(region_names(divisions), "region", "left").withColumn("__m", measures("geometry"))
    n = F.col("names.primary")
    return joined.select(
        F.col("id").alias("gers_id"), "version", n.alias("name"), F.col("subtype").alias("type"), "class", "country", "region", "population",
        F.col("__m.y").alias("lat"), F.col("__m.x").alias("lon"), *(F.col(f"bbox.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")),
        primary_name(n, F.col("country"), F.col("region")).alias("primary_name"),
        search_text(n, F.col("names.rules"), F.col("names.common"), F.col("country"), F.col("region"), F.col("country_name"), F.col("country_common"), F.col("country_short"), F.col("region_name")).alias("search_text"),
    )


def reverse_divisions(divisions: DataFrame, areas: DataFrame) -> DataFrame:
    """The reverse table: divisions with the box and planar area of their smallest polygon."""
    measured = areas.select(F.col("division_id").alias("gers_id"), measures("geometry").alias("m")).where("m.area IS NOT NULL").select("gers_id", "m.xmin", "m.ymin", "m.xmax", "m.ymax", "m.area")
    places = divisions.where(F.col("subtype").isin(*REVERSE_TYPES) & F.col("names.primary").isNotNull()).withColumn("__m", measures("geometry"))
    flat = places.select(
        F.col("id").alias("gers_id"), "subtype", "country", "region", "population", F.col("__m.y").alias("lat"), F.col("__m.x").alias("lon"),
        primary_name(F.col("names.primary"), F.col("country"), F.col("region")).alias("name"),
    )
    return smallest_area(flat, measured, "gers_id", F.col("area"))


def flatten_addresses(addresses: DataFrame, country: str = "US", state: str | None = None) -> DataFrame:
    """Addresses of a country, or of one of its states, with display name and search text."""
    st, city = level(F.col("address_levels"), 1), level(F.col("address_levels"), 2)
    rows = addresses.where((F.col("country") == country) & (F.lit(True) if state is None else st == state))
    c = F.col
    return rows.select(
        c("id").alias("gers_id"), c("postcode"), c("street"), c("number"), c("unit"), st.alias("state"), city.alias("city"), c("postal_city"),
        address_name(c("number"), c("street"), c("unit"), city, c("postal_city"), st, c("postcode")).alias("primary_name"),
        address_text(c("number"), c("street"), city, c("postal_city"), st, c("postcode")).alias("search_text"),
    )


def parsed_response(json: Column) -> Column:
    """An array of results from a response in any of its forms: a list, {"results": [...]} or one object; fields under either name."""
    item = "struct<gers_id:string,name:string,primary_name:string,type:string,subtype:string,lat:double,lon:double,importance:double,bbox:array<double>,boundingbox:array<double>>"
    wrapped = F.from_json(json, f"struct<results:array<{item}>>")["results"]
    listed = F.from_json(json, f"array<{item}>")
    single = F.from_json(json, item)
    items = (
        F.when(F.startswith(F.ltrim(json), F.lit("[")), listed)
        .when(wrapped.isNotNull(), wrapped)
        .when(single["gers_id"].isNotNull(), F.array(single))
        .otherwise(F.array().cast(f"array<{item}>"))
    )
    return F.transform(
        items,
        lambda r: F.struct(
            r["gers_id"].alias("gers_id"), F.coalesce(r["primary_name"], r["name"]).alias("primary_name"), F.coalesce(r["type"], r["subtype"]).alias("type"),
            r["lat"].alias("lat"), r["lon"].alias("lon"), r["importance"].alias("importance"), F.coalesce(r["bbox"], r["boundingbox"]).alias("bbox"),
        ),
    )
