"""Spatial operators, shards, catalogs, readers and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import wkb
from geoloom.operators import refine, shards
from geoloom.operators.grid import points_in_boxes
from geoloom.operators.nearby import nearby
from geoloom.operators.reverse import reverse, reverse_sharded
from geoloom.sources import catalog, output, readers
from geoloom.streaming.enrich import containing_places, reverse_stream

POINTS = "point_id long, p_lat double, p_lon double"
BOXES = "gers_id string, xmin double, ymin double, xmax double, ymax double"


def test_grid_equals_all_pairs(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)] + [(900, 10.0, 20.0), (901, None, 1.0), (902, 90.0, 180.0), (903, -90.0, -180.0)]
    boxes = []
    for i in range(300):
        w, h = 10 ** rng.uniform(-4, 2), 10 ** rng.uniform(-4, 2)
        x, y = rng.uniform(-180, 180), rng.uniform(-90, 90)
        boxes.append((str(i), x, y, x + w, y + h))
    boxes += [("world", -180.0, -90.0, 180.0, 90.0), ("dot", 20.0, 10.0, 20.0, 10.0), ("null", None, 0.0, 1.0, 1.0), ("inverted", 10.0, 0.0, 5.0, 1.0)]
    got = sorted((r.point_id, r.gers_id) for r in points_in_boxes(spark.createDataFrame(pts, POINTS), spark.createDataFrame(boxes, BOXES)).collect())
    want = sorted((p, b) for p, lat, lon in pts for b, x0, y0, x1, y1 in boxes if None not in (lat, x0) and x0 <= lon <= x1 and y0 <= lat <= y1)
    assert got == want and len(got) == len(set(got))


PLACES = "gers_id string, name string, subtype string, country string, region string, population long, lat double, lon double, xmin double, ymin double, xmax double, ymax double, area double"


def place(gid, subtype, half, country="C", lat=0.0, lon=0.0):
    return (gid, gid.upper(), subtype, country, None, None, lat, lon, lon - half, lat - half, lon + half, lat + half, 4 * half * half)


def test_reverse_hierarchy(spark):
    df = spark.createDataFrame([place("n", "neighborhood", 0.04), place("n", "neighborhood", 0.04), place("l", "locality", 0.1), place("l2", "locality", 0.2), place("c", "country", 20.0), place("odd", "ward", 0.01)], PLACES)
    rows = {r.point_id: r for r in reverse(spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 80.0, 0.0)], POINTS), df).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].gers_id == "odd" and rows[1].confidence == "high" and rows[1].distance_km == 0
    assert [h.gers_id for h in rows[1].hierarchy] == ["n", "l", "c"]
    assert rows[2].gers_id == "c" and rows[2].confidence == "low"


def test_reverse_falls_back_to_head(spark):
    df = spark.createDataFrame([place("a", "locality", 0.1, "FR"), place("b", "country", 10.0, "FR")], PLACES)
    both = df.where("gers_id = 'a'").withColumn("shard_id", F.lit("FR")).unionByName(df.where("gers_id = 'b'").withColumn("shard_id", F.lit("HEAD")))
    pts = spark.createDataFrame([(1, 0.0, 0.0, "FR"), (2, 5.0, 5.0, "FR"), (3, 0.0, 0.0, None)], POINTS + ", country string")
    assert {r.point_id: r.gers_id for r in reverse_sharded(pts, both).collect()} == {1: "a", 2: "b", 3: "b"}


def test_nearby_is_exact_everywhere(spark):
    rng = random.Random(6)
    feats = [(f"f{i:03}", rng.choice([rng.uniform(-90, 90), rng.uniform(86, 90)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179)])) for i in range(400)]
    pts = [(1, 0.0, 179.9), (2, 89.5, 0.0), (3, 20.0, 20.0), (4, -60.0, -179.99)]
    f, p = spark.createDataFrame(feats, "gers_id string, lat double, lon double"), spark.createDataFrame(pts, POINTS)
    from geoloom.functions.geo import haversine

    every = p.crossJoin(f).withColumn("km", haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).where("km <= 900")
    want = sorted((r.point_id, r.gers_id) for r in every.collect())
    got = sorted((r.point_id, r.gers_id) for r in nearby(p, f, 900.0, 10_000).collect())
    assert got == want and len(want) > 10


def test_refine_outcomes(spark):
    res = spark.createDataFrame([(1, "in", 1, "low"), (1, "out", 2, "low"), (1, "missing", 3, "low"), (1, "broken", 4, "low"), (1, "late", 5, "low")], "point_id long, gers_id string, rank long, confidence string")
    geo = spark.createDataFrame([("in", True), ("out", False), ("broken", None)], "gers_id string, inside boolean")
    got = {r.gers_id: r.confidence for r in refine.refine(res, geo, F.col("inside"), F.col("inside").isNull(), 4).collect()}
    assert got == {"in": "exact", "broken": "low", "late": "low"}


def test_shard_rules(spark):
    rows = [("a", "C1", "C1-A", 10), ("b", "C1", None, 20), ("c", "C1", "C1-XX", 5), ("d", "C2", None, 200_000)]
    df = spark.createDataFrame(rows, "gers_id string, country string, region string, population long").withColumn("subtype", F.lit("locality"))
    size = F.lit(100)
    got = sorted((r.shard_id, r.gers_id) for r in shards.assign_shards(df, size, 250, shards.in_head(F.col("subtype"), F.col("population"))).collect())
    assert got == [("C1-A", "a"), ("C1-XX", "b"), ("C1-XX", "c"), ("C2", "d"), ("HEAD", "d")]
    assert {(r.region, r.n) for r in shards.region_counts(df).where("country = 'C1'").collect()} == {("C1-A", 1), ("C1-XX", 1)}
    empty = df.limit(0).withColumn("shard_id", F.lit("x")).withColumns({c: F.lit(0.0) for c in ("xmin", "ymin", "xmax", "ymax")})
    assert shards.shard_stats(empty, size).count() == 0


def test_antimeridian_split(spark):
    df = spark.createDataFrame([("a", 170.0, 0.0, -170.0, 1.0), ("b", 1.0, 0.0, 2.0, 1.0)], BOXES)
    assert sorted((r.gers_id, r.xmin, r.xmax) for r in shards.split_antimeridian(df).collect()) == [("a", -180.0, -170.0), ("a", 170.0, 180.0), ("b", 1.0, 2.0)]


def test_near_shards_match_all_pairs(spark):
    rng = random.Random(7)
    tiles = []
    for i in range(80):
        x, y = rng.uniform(-180, 178), rng.uniform(-90, 88)
        tiles.append((f"S{i:02}", x, y, x + 2, y + 2))
    cat = spark.createDataFrame([*tiles, ("HEAD", -180.0, -90.0, 180.0, 90.0), ("EMPTY", None, None, None, None)], BOXES.replace("gers_id", "shard_id"))
    pts = spark.createDataFrame([(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(100, 0.0, 180.0)], POINTS)
    from geoloom.functions.geo import distance_to_bbox

    pairs = pts.crossJoin(cat.where("shard_id <> 'HEAD' AND xmin IS NOT NULL")).withColumn("km", distance_to_bbox(*(F.col(c) for c in ("p_lat", "p_lon", "xmin", "ymin", "xmax", "ymax")))).where("km <= 1500")
    want = sorted((r.point_id, r.shard_id) for r in pairs.collect())
    assert sorted((r.point_id, r.shard_id) for r in shards.shards_near(pts, cat, 1500.0, 1000).collect()) == want


def test_publish_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "C1"), ("b", "C2"), ("c", "C1")], "gers_id string, shard_id string").withColumns({c: F.lit(float(i)) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))})
    stats = shards.shard_stats(df, F.lit(10))
    catalog.publish(spark, str(tmp_path), "2025-02-01.0", df, stats, ["2025-01-01.0"], {"C1": ["C1-A"]})
    links = catalog.read_catalog(spark, f"{tmp_path}/catalog.json")
    assert [r.version for r in catalog.latest_version(links).collect()] == ["2025-02-01.0"]
    assert [r.version for r in catalog.all_versions(links).collect()] == ["2025-02-01.0", "2025-01-01.0"]
    items = catalog.read_collection(spark, f"{tmp_path}/2025-02-01.0/collection.json")
    assert {(r.shard_id, r.record_count, r.xmax) for r in items.collect()} == {("C1", 2, 2.0), ("C2", 1, 2.0)}
    legacy = spark.createDataFrame([("C1", 7), ("C9", 9)], "shard_id string, record_count long")
    assert {(r.shard_id, r.record_count) for r in catalog.with_legacy(items, legacy).collect()} == {("C1", 2), ("C2", 1), ("C9", 9)}
    assert spark.read.parquet(f"{tmp_path}/2025-02-01.0/shards").where("shard_id = 'C1'").count() == 2
    document = json.loads((tmp_path / "2025-02-01.0/collection.json").read_text())
    assert document["summaries"] == {"shard_count": 2, "total_records": 3, "total_size_bytes": 30} and document["region_sharded"] == {"C1": ["C1-A"]}


def test_row_hash_ignores_partitions(spark):
    df = spark.createDataFrame([("s", i, f"n{i}") for i in range(50)], "shard_id string, k int, name string")
    a = shards.row_hash(df.repartition(5), "k", ["k", "name"]).first()
    assert a == shards.row_hash(df.repartition(2), "k", ["k", "name"]).first()


def test_output_null_fields(spark):
    row = spark.createDataFrame([(1, 1, "a", "A", "county", 1.0, 2.0, 0.5, None, None, 0.0, 0.0, 1.0, 1.0)], "query_id long, rank long, gers_id string, name string, type string, lat double, lon double, importance double, country string, region string, xmin double, ymin double, xmax double, ymax double")
    assert "country" not in json.loads(output.json_responses(row).first().body)["results"][0]
    feature = json.loads(output.geojson_responses(row).first().body)["features"][0]
    assert feature["properties"]["country"] is None and feature["geometry"] == {"type": "Point", "coordinates": [2.0, 1.0]}
    assert "(county, ??)" in output.text_lines(row).first().line


NAMES = "struct<primary:string,common:map<string,string>,rules:array<struct<variant:string,language:string,value:string>>>"
DIVISION = f"id string, version int, subtype string, class string, country string, region string, population long, geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, names {NAMES}"


def test_readers(spark):
    dot = bytearray(wkb.encode("Point", [-71.0, 42.0]))
    box = (-72.0, 41.0, -70.0, 43.0)
    rows = [
        ("us", 1, "country", None, "US", None, None, dot, box, ("United States", {"en": "United States"}, [("short", "en", "USA"), ("short", "fr", "EU")])),
        ("us2", 1, "country", None, "US", None, None, dot, box, ("Second", {}, [])),
        ("ma", 1, "region", None, "US", "US-MA", None, dot, box, ("Massachusetts", None, None)),
        ("bo", 1, "locality", None, "US", "US-MA", 675_647, dot, box, ("Boston", {"en": "Boston"}, [("short", None, "BOS"), ("alternate", "en-US", "Beantown"), ("alternate", "es", "x")])),
        ("no", 1, "locality", None, "US", "US-MA", None, dot, box, (None, {}, [])),
    ]
    d = spark.createDataFrame(rows, DIVISION)
    flat = readers.flatten_divisions(d).collect()
    assert [(r.gers_id, r.primary_name, r.lat, r.lon) for r in flat] == [("bo", "Boston, MA", 42.0, -71.0)]
    assert flat[0].search_text == "boston bos beantown ma us united states usa massachusetts"
    small, large = (bytearray(wkb.encode("Polygon", [[[0.0, 0.0], [s, 0.0], [s, s], [0.0, s]]])) for s in (1.0, 3.0))
    areas = spark.createDataFrame([("bo", large), ("bo", small), ("ma", large), ("bo", bytearray(b"x"))], "division_id string, geometry binary")
    assert sorted((r.gers_id, r.area) for r in readers.reverse_divisions(d, areas).collect()) == [("bo", 1.0), ("ma", 9.0)]
    assert readers.in_box(d, -71.5, 41.5, -71.0, 42.0).count() == 5 and readers.in_box(d, 0.0, 0.0, 1.0, 1.0).count() == 0
    assert readers.only_points(d).count() == 5
    with pytest.raises(ValueError, match="empty"):
        readers.non_empty(d.limit(0))


def test_addresses(spark):
    rows = [("a", "US", "02101", "Main St", "123", None, [("MA",), ("Boston",)], None), ("b", "US", None, None, None, None, [("MA",)], "Salem"), ("c", "CA", "1", "x", "1", None, [], None)]
    d = spark.createDataFrame(rows, "id string, country string, postcode string, street string, number string, unit string, address_levels array<struct<value:string>>, postal_city string")
    got = {r.gers_id: (r.primary_name, r.search_text) for r in readers.flatten_addresses(d, state="MA").collect()}
    assert got == {"a": ("123 Main St, Boston, MA 02101", "123 main st boston ma 02101 us"), "b": ("Salem, MA ", "  salem ma  us")}


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([place("l", "locality", 0.1), place("c", "country", 20.0)], PLACES)
    spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], POINTS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(POINTS).parquet(f"{tmp_path}/in")
    q = reverse_stream(stream, df, f"{tmp_path}/out", f"{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    assert {(r.point_id, r.gers_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "l"), (2, "c")}
    q = containing_places(spark.readStream.schema(POINTS).parquet(f"{tmp_path}/in"), df).writeStream.format("memory").queryName("around").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("around").count() == 3
