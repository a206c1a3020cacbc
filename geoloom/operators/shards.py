"""Shards: assignment, statistics, and the choice of shards for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geo import distance_to_bbox
from geoloom.operators.merge import top_of

# Fixed values.
MAX_SHARD_BYTES = 50 * 1024 * 1024
FALLBACK = "XX"
HEAD = "HEAD"
HEAD_POPULATION = 100_000
NEARBY_KM = 200.0
MAX_LOCATION_SHARDS = 4
HEAD_FORWARD = ("county",)
HEAD_REVERSE = ("country", "region", "county")


def region_shard(country: Column, region: Column) -> Column:
    return F.coalesce(region, F.concat(country, F.lit(f"-{FALLBACK}")))


def in_head(subtype: Column, population: Column, kinds: tuple[str, ...] = HEAD_FORWARD, threshold: int = HEAD_POPULATION) -> Column:
    """Populous places and whole types; an unknown population is not populous."""
    return F.coalesce(population >= threshold, F.lit(False)) | F.coalesce(subtype.isin(*kinds), F.lit(False))


def row_bytes(*columns: str) -> Column:
    """An estimate of a row's size: its text, and eight bytes for anything else."""
    return sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(8))


def oversize(df: DataFrame, size: Column, most: int = MAX_SHARD_BYTES) -> DataFrame:
    """(country, size_bytes) of the countries whose rows together exceed the limit."""
    return df.groupBy("country").agg(F.sum(size).alias("size_bytes")).where(F.col("size_bytes") > most)


def assign_shards(df: DataFrame, size: Column, most: int = MAX_SHARD_BYTES, head: Column | None = None) -> DataFrame:
    """The rows with shard_id: the country, or the region where the country is too large; rows in ``head`` once more under HEAD.

    Countries are few, so the oversize list is joined by whatever strategy its size at run time allows.
    """
    big = oversize(df, size, most).select("country", F.lit(True).alias("__big"))
    local = df.join(big, "country", "left").withColumn("shard_id", F.when(F.col("__big"), region_shard(F.col("country"), F.col("region"))).otherwise(F.col("country"))).drop("__big")
    if head is None:
        return local
    return local.unionByName(df.where(head).withColumn("shard_id", F.lit(HEAD)).select(*local.columns))


def shard_stats(df: DataFrame, size: Column) -> DataFrame:
    """(shard_id, record_count, size_bytes, xmin, ymin, xmax, ymax); a shard without boxes has null bounds."""
    return df.groupBy("shard_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.sum(size).cast("long").alias("size_bytes"),
        F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
    )


def region_counts(df: DataFrame) -> DataFrame:
    """(country, region, n) grouped by the region column itself, the fallback name put in after counting."""
    return df.groupBy("country", "region").agg(F.count(F.lit(1)).alias("n")).select("country", region_shard(F.col("country"), F.col("region")).alias("region"), "n")


def row_hash(df: DataFrame, key: str, columns: list[str], group: str = "shard_id", digits: int = 4) -> DataFrame:
    """(group, rows_sha256): a hash of a group's rows that does not depend on files or partitions.

    A tree of two levels, so that a large group need not meet in one value: rows fall into 16 ** ``digits`` buckets by the
    first digits of their key's hash; a bucket's hash is that of its rows' hashes in order of key, and the group's
    that of its non-empty buckets' hashes in order.
    """
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    rows = df.select(group, F.substring(F.sha2(F.col(key).cast("string"), 256), 1, digits).alias("bucket"), F.struct(F.col(key).alias("k"), F.sha2(line, 256).alias("h")).alias("row"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda r: r["h"]), ""), 256)
    buckets = rows.groupBy(group, "bucket").agg(joined("row").alias("h"))
    return buckets.select(group, F.struct(F.col("bucket").alias("k"), "h").alias("row")).groupBy(group).agg(joined("row").alias("rows_sha256"))


def region_map(df: DataFrame) -> DataFrame:
    """(country, regions): the regions of each country, the largest first, ties by name."""
    counts = region_counts(df)
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("region"))))
    return counts.groupBy("country").agg(F.transform(order, lambda r: r["region"]).alias("regions"))


def shards_near(points: DataFrame, catalog: DataFrame, within_km: float = NEARBY_KM, most: int = MAX_LOCATION_SHARDS) -> DataFrame:
    """The nearest shards of each point (point_id, p_lat, p_lon), HEAD and shards without bounds left out; ties by shard_id.

    A catalog has one row for each shard, a few hundred; boxes widened by the reach select candidates through the grid.
    """
    from geoloom.operators.grid import points_in_boxes

    reach = within_km / 111.0
    tallest = F.greatest(F.abs(F.col("ymin")), F.abs(F.col("ymax"))) + reach
    widen = F.when(tallest < 89.0, F.lit(reach * 1.01) / F.cos(F.radians(tallest))).otherwise(F.lit(360.0))
    real = catalog.where((F.col("shard_id") != HEAD) & F.col("xmin").isNotNull())
    boxes = real.withColumns({"w_xmin": F.greatest(F.lit(-180.0), F.col("xmin") - widen), "w_xmax": F.least(F.lit(180.0), F.col("xmax") + widen), "w_ymin": F.col("ymin") - 1.01 * reach, "w_ymax": F.col("ymax") + 1.01 * reach})
    # near the antimeridian distances also run the other way round, so such boxes take the whole parallel
    round_world = (F.col("xmin") - widen < -180) | (F.col("xmax") + widen > 180)
    boxes = boxes.withColumns({"w_xmin": F.when(round_world, -180.0).otherwise(F.col("w_xmin")), "w_xmax": F.when(round_world, 180.0).otherwise(F.col("w_xmax"))})
    pairs = points_in_boxes(points, boxes, "p_lat", "p_lon", "w_xmin", "w_ymin", "w_xmax", "w_ymax")
    far = pairs.withColumn("distance_km", distance_to_bbox(*(F.col(c) for c in ("p_lat", "p_lon", "xmin", "ymin", "xmax", "ymax")))).where(F.col("distance_km") <= within_km)
    return top_of(far, ["point_id"], [F.round("distance_km", 9), F.asc("shard_id")], most).select("point_id", "shard_id", "distance_km", "rank")


def shards_of_country(points: DataFrame, places: DataFrame, catalog: DataFrame, most: int = MAX_LOCATION_SHARDS) -> DataFrame:
    """(point_id, shard_id, rank): the country's largest regions if it is split, else its own shard, else none.

    ``points`` has a country; which countries are split shows in the catalog, which then lacks their shard.
    """
    whole = catalog.select(F.col("shard_id").alias("country"))
    split = region_counts(places).join(whole, "country", "left_anti")
    order = Window.partitionBy("country").orderBy(F.desc("n"), F.asc("region"))
    ranked = split.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("country", F.col("region").alias("shard_id"), "rank")
    single = whole.where(F.col("country") != HEAD).select("country", F.col("country").alias("shard_id"), F.lit(1).cast("long").alias("rank"))
    known = ranked.join(catalog.select("shard_id"), "shard_id", "left_semi").select("country", "shard_id", "rank").unionByName(single)
    return points.where(F.col("country").isNotNull()).join(known, "country").select("point_id", "shard_id", "rank")


def select_shards(points: DataFrame, places: DataFrame, catalog: DataFrame) -> DataFrame:
    """Coordinates decide; without both the country does; without either there is no location shard."""
    located = points.where(F.col("p_lat").isNotNull() & F.col("p_lon").isNotNull())
    rest = points.where(F.col("p_lat").isNull() | F.col("p_lon").isNull())
    return shards_near(located, catalog).select("point_id", "shard_id", "rank").unionByName(shards_of_country(rest, places, catalog))


def split_antimeridian(df: DataFrame) -> DataFrame:
    """Boxes whose xmin exceeds their xmax as two rows, one on each side of the antimeridian; others unchanged."""
    crosses = F.col("xmin") > F.col("xmax")
    side = lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    both = F.array(side(F.col("xmin"), F.lit(180.0)), side(F.lit(-180.0), F.col("xmax")))
    parts = F.explode(F.when(crosses, both).otherwise(F.array(side(F.col("xmin"), F.col("xmax")))))
    return df.withColumn("__part", parts).withColumns({"xmin": F.col("__part.a"), "xmax": F.col("__part.b")}).drop("__part")
