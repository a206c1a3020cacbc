"""The shard catalog: a root document pointing at versioned collections, which embed their shards' statistics."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The version of the format, and the keys by which readers find things in a document: links with rel, href, type and
# latest; items with record_count, size_bytes, sha256, href, bbox and parent_country; summaries with shard_count, total_records and
# total_size_bytes; region_sharded.
STAC_VERSION = "1.1.0"
LINKS = "array<struct<rel:string,href:string,latest:boolean>>"


def version_of(href) -> F.Column:
    """The version in a link such as ``./2025-01-01.0/collection.json``."""
    return F.regexp_extract(href, r"^(?:\./)?([^/]+)", 1)


def latest_version(links: DataFrame) -> DataFrame:
    """(version) of the child link marked latest."""
    return links.where((F.col("rel") == "child") & F.col("latest")).select(version_of(F.col("href")).alias("version"))


def all_versions(links: DataFrame, *more: str) -> DataFrame:
    """The distinct versions of the child links and of ``more``, the newest first."""
    have = links.where("rel = 'child'").select(version_of(F.col("href")).alias("version"))
    if more:
        have = have.union(links.sparkSession.createDataFrame([(v,) for v in more], "version string"))
    return have.distinct().orderBy(F.desc("version"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The root's links as rows."""
    return spark.read.schema(f"links {LINKS}").json(path, multiLine=True).select(F.explode("links").alias("l")).select("l.*")


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, record_count, size_bytes, sha256, href, parent_country, xmin, ymin, xmax, ymax) of the embedded shards."""
    item = "struct<record_count:bigint,size_bytes:bigint,sha256:string,href:string,parent_country:string,bbox:array<double>>"
    rows = spark.read.schema(f"items map<string,{item}>").json(path, multiLine=True).select(F.explode("items").alias("shard_id", "i"))
    box = [F.try_element_at("i.bbox", F.lit(n + 1)).alias(c) for n, c in enumerate(("xmin", "ymin", "xmax", "ymax"))]
    return rows.select("shard_id", "i.record_count", "i.size_bytes", "i.sha256", "i.href", "i.parent_country", *box)


def with_legacy(embedded: DataFrame, legacy: DataFrame) -> DataFrame:
    """Shards of the collection, and from older item files those that it does not embed."""
    return embedded.unionByName(legacy.join(embedded.select("shard_id"), "shard_id", "left_anti"), allowMissingColumns=True)


def shard_metadata(stats: DataFrame, version: str, threshold: int | None = None, now: datetime | None = None) -> DataFrame:
    """(shard_id, key, value): version, type, record_count, created_at, the country or region, and HEAD's population threshold."""
    made = (now or datetime.now(UTC)).isoformat()
    sid, is_head = F.col("shard_id"), F.col("shard_id") == "HEAD"
    pairs = {
        "version": F.lit(version),
        "record_count": F.col("record_count").cast("string"),
        "created_at": F.lit(made),
        "type": F.when(is_head, "head").when(F.contains(sid, F.lit("-")), "region").otherwise("country"),
        "country": F.when(~is_head, F.split(sid, "-")[0]),
        "region": F.when(~is_head & F.contains(sid, F.lit("-")), sid),
        "population_threshold": F.when(is_head, F.lit(None if threshold is None else str(threshold)).cast("string")),
    }
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items())))
    return stats.select("shard_id", entries.alias("e")).select("shard_id", "e.key", "e.value").where("value IS NOT NULL")


def metadata_of(metadata: DataFrame, shards: DataFrame, key: str) -> DataFrame:
    """(shard_id, value) for each shard asked for; null where it has no such key."""
    return shards.select("shard_id").join(metadata.where(F.col("key") == key).select("shard_id", "value"), "shard_id", "left")


def release_status(table: DataFrame, links: DataFrame, release: str) -> DataFrame:
    """One row: rows of the release's table, whether there are any, and whether the release is newer than the latest published version."""
    latest = latest_version(links).agg(F.max("version").alias("published"))
    counts = table.agg(F.count(F.lit(1)).alias("n"))
    fresh = F.coalesce(F.lit(release) > F.col("published"), F.lit(True))
    return counts.withColumn("one", F.lit(1)).join(latest.withColumn("one", F.lit(1)), "one").select("n", (F.col("n") > 0).alias("accessible"), F.lit(release).alias("release"), "published", fresh.alias("newer"))


def build_version(now: datetime | None = None) -> str:
    return f"{now or datetime.now(UTC):%Y-%m-%d}.0"


def _link(rel: str, href: str, **more) -> dict:
    """A link to another document of the catalog."""
    return {"rel": rel, "href": href, "type": "application/json", **more}


def published_versions(spark: SparkSession, path: str) -> list[str]:
    """The versions that a root document names; none where there is no such file."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
        return []
    return [r["version"] for r in all_versions(read_catalog(spark, path)).collect()]  # one a version


def collection_document(version: str, shards: list[dict], regions: dict[str, list[str]] | None = None, now: datetime | None = None) -> dict:
    """A collection from rows of shard statistics, at most a few hundred of them."""
    items = {}
    for s in shards:
        box = [s[c] for c in ("xmin", "ymin", "xmax", "ymax")]
        items[s["shard_id"]] = {"record_count": s["record_count"], "size_bytes": s["size_bytes"], "sha256": s.get("sha256", ""), "href": f"./shards/{s['shard_id']}", "bbox": None if None in box else box}
        if s.get("parent_country"):
            items[s["shard_id"]]["parent_country"] = s["parent_country"]
    out = {
        "type": "Collection",
        "stac_version": STAC_VERSION,
        "id": f"places-{version}",
        "description": f"Places of version {version}, by shard",
        "extent": {"spatial": {"bbox": [[-180.0, -90.0, 180.0, 90.0]]}, "temporal": {"interval": [[(now or datetime.now(UTC)).isoformat(), None]]}},
        "summaries": {"shard_count": len(items), "total_records": sum(x["record_count"] for x in items.values()), "total_size_bytes": sum(x["size_bytes"] for x in items.values())},
        "items": items,
        "links": [_link("root", "../catalog.json"), _link("parent", "../catalog.json")],
    }
    return out | ({"region_sharded": regions} if regions else {})


def item_document(shard: dict, now: datetime | None = None) -> dict:
    """A single shard as a feature whose outline is its box."""
    x0, y0, x1, y1 = (shard[c] for c in ("xmin", "ymin", "xmax", "ymax"))
    ring = [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    known = {k: shard[k] for k in ("record_count", "size_bytes", "sha256") if k in shard}
    return {"type": "Feature", "stac_version": STAC_VERSION, "id": shard["shard_id"], "bbox": [x0, y0, x1, y1], "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"datetime": (now or datetime.now(UTC)).isoformat(), **known}, "assets": {"data": {"href": f"./shards/{shard['shard_id']}", "roles": ["data"]}}, "links": []}


def catalog_document(versions: list[str], latest: str) -> dict:
    """The root, which points at every version's collection, the newest first, and marks the latest."""
    newest = sorted({*versions, latest}, reverse=True)
    links = [_link("child", f"./{v}/collection.json", **({"latest": True} if v == latest else {})) for v in newest]
    return {"type": "Catalog", "stac_version": STAC_VERSION, "id": "places", "description": f"{len(newest)} versions of the places' shards", "links": links}


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """A small document through the file system that Spark uses; written beside its place, then moved there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(document, indent=2, ensure_ascii=False).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(draft, target)


def publish_shards(spark: SparkSession, root: str, version: str, places: DataFrame, stats: DataFrame, folder: str = "shards", regions: dict[str, list[str]] | None = None) -> None:
    """Write shards and then their collection."""
    places.repartitionByRange("shard_id", "gers_id").sortWithinPartitions("shard_id", "gers_id").write.mode("overwrite").option("compression", "zstd").partitionBy("shard_id").parquet(f"{root}/{version}/{folder}")
    rows = [r.asDict() for r in stats.collect()]  # one row a shard
    name = "collection.json" if folder == "shards" else f"{folder}-collection.json"
    write_json(spark, f"{root}/{version}/{name}", collection_document(version, rows, regions))


def publish(spark: SparkSession, root: str, version: str, places: DataFrame, stats: DataFrame, versions: list[str], regions: dict[str, list[str]] | None = None) -> None:
    """Write shards, then the collection, and last the root that points at it, so readers never see a version in part."""
    publish_shards(spark, root, version, places, stats, "shards", regions)
    write_json(spark, f"{root}/catalog.json", catalog_document([*versions, version], version))
