"""Building a version of the shards: which rows go where, the tables, the index and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.params import checked_threshold
from geoloom.operators import shards
from geoloom.operators.bm25 import TextIndex
from geoloom.sources import catalog


def plan_shards(
    places: DataFrame,
    size: Column,
    threshold: int = shards.HEAD_POPULATION,
    countries: tuple[str, ...] | None = None,
    head_only: bool = False,
    skip_head: bool = False,
    reverse: bool = False,
    most: int = shards.MAX_SHARD_BYTES,
) -> DataFrame:
    """The rows with their shard_id, by the options of a build.

    HEAD holds the populous places and whole types of all countries; ``countries`` restricts the other shards.  Reverse shards are whole countries, forward ones are split where oversize.
    """
    kinds = shards.HEAD_REVERSE if reverse else shards.HEAD_FORWARD
    head = places.where(shards.in_head(F.col("subtype"), F.col("population"), kinds, checked_threshold(threshold))).withColumn("shard_id", F.lit(shards.HEAD))
    local = places.where(F.col("country").isNotNull())
    if countries is not None:
        local = local.where(F.col("country").isin(*countries))
    local = local.withColumn("shard_id", F.col("country")) if reverse else shards.assign_shards(local, size, most)
    local = local.select(head.columns)
    if head_only:
        return head.limit(0) if skip_head else head
    return local if skip_head else local.unionByName(head)


def build(places: DataFrame, root: str, size: Column, version: str | None = None, reverse: bool = False, **options) -> str:
    """Write a version of the shards under ``root``; the version's name.

    Tables and index first, then the collection.  The root document comes last, and only for forward shards, so readers see a
    whole version or none; versions published before stay in it.
    """
    spark = places.sparkSession
    version = version or catalog.build_version()
    assigned = plan_shards(places, size, reverse=reverse, **options)
    stats = shards.shard_stats(assigned, size)
    if reverse:
        catalog.publish_shards(spark, root, version, assigned, stats, "reverse")
        return version
    TextIndex.build(assigned, "search_text", "gers_id", "shard_id").write(f"{root}/{version}/index")
    catalog.publish(spark, root, version, assigned, stats, catalog.published_versions(spark, f"{root}/catalog.json"))
    return version
