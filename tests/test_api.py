"""The client calls over small tables, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from geoloom.__main__ import main
from geoloom.api import Gazetteer
from geoloom.functions import wkb
from geoloom.operators import shards
from tests.test_places import PLACES, POINTS, place
from tests.test_search import gazetteer


@pytest.fixture
def gaz(spark):
    square = lambda h: bytearray(wkb.encode("Polygon", [[[-h, -h], [h, -h], [h, h], [-h, h], [-h, -h]]]))
    places = gazetteer(spark).withColumnRenamed("subtype", "type").withColumns({"xmin": F.col("lon") - 0.1, "ymin": F.col("lat") - 0.1, "xmax": F.col("lon") + 0.1, "ymax": F.col("lat") + 0.1})
    divisions = spark.createDataFrame([place("in", "locality", 0.1), place("half", "county", 0.5), place("none", "region", 3.0), place("broken", "country", 20.0)], PLACES)
    shapes = spark.createDataFrame([("in", square(0.1)), ("half", square(0.01)), ("broken", bytearray(b"?"))], "gers_id string, geometry binary")
    pois = spark.createDataFrame([("cafe", 0.05, 0.051, "food"), ("shop", 0.05, 0.0505, "retail"), ("far", 10.0, 10.0, "food")], "gers_id string, lat double, lon double, category string")
    stats = shards.shard_stats(places, F.lit(10))
    return Gazetteer.of(places, catalog=stats, divisions=divisions, geometries=shapes, pois=pois)


def points(spark):
    return spark.createDataFrame([(1, 0.05, 0.05), (2, 80.0, 80.0)], POINTS)


def test_forward(spark, gaz):
    q = spark.createDataFrame([(1, "boston"), (2, "nowhere")], "query_id long, text string")
    bodies = {r.query_id: json.loads(r.body) for r in gaz.search_json(q, debug=True).collect()}
    assert bodies[1]["results"][0]["gers_id"] == "d" and bodies[1]["debug"]["shards"][0]["shard_id"] == "HEAD" and bodies[2] == {"results": []}
    features = {r.query_id: json.loads(r.body)["features"] for r in gaz.search_geojson(q).collect()}
    assert features[1][0]["geometry"]["coordinates"] == [-71.06, 42.36] and features[2] == []
    assert [r.gers_id for r in gaz.geocode(q).collect()] == ["d"] and gaz.count() == 5


def test_reverse_calls(spark, gaz):
    names = {r.point_id: r.name for r in gaz.reverse_geocode(points(spark)).collect()}
    assert names == {1: "IN", 2: None}
    body = json.loads(gaz.reverse_geojson(points(spark)).first().body)
    assert [h["gers_id"] for h in body["properties"]["hierarchy"]] == ["in", "half", "none", "broken"]
    plain = {r.gers_id: r.confidence for r in gaz.containing(points(spark)).collect()}
    checked = {r.gers_id: r.confidence for r in gaz.containing(points(spark), verify=True).collect()}
    assert plain == {"in": "medium", "half": "low", "none": "low", "broken": "low"} and checked == {"in": "exact", "broken": "low"}


def test_geometry_and_nearby(spark, gaz):
    ids = spark.createDataFrame([("in",), ("absent",)], "gers_id string")
    assert json.loads(gaz.geometry(ids).first().geojson)["type"] == "Polygon"
    pairs = spark.createDataFrame([("in", 0.05, 0.05), ("half", 0.05, 0.05), ("broken", 0.0, 0.0), ("absent", 0.0, 0.0)], "gers_id string, p_lat double, p_lon double")
    assert {r.gers_id: r.contains for r in gaz.verify_contains_point(pairs).collect()} == {"in": True, "half": False, "broken": None, "absent": None}
    assert [r.gers_id for r in gaz.nearby_places(points(spark)).orderBy("rank").collect()] == ["shop", "cafe"]
    assert [r.gers_id for r in gaz.nearby_places(points(spark), category="food").collect()] == ["cafe"]
    both = {r.point_id: r for r in gaz.reverse_and_refine(points(spark)).collect()}
    assert [d.gers_id for d in both[1].divisions] == ["in", "broken"] and [p.gers_id for p in both[1].places] == ["shop", "cafe"]
    assert both[1].addresses is None and both[2].divisions is None


def test_command_line(spark, gaz, tmp_path, capsys):
    gaz.places.write.parquet(f"{tmp_path}/places")
    gaz.index.write(f"{tmp_path}/index")
    main(["count", f"{tmp_path}/places"])
    main(["search", f"{tmp_path}/index", f"{tmp_path}/places", "boston", "--limit", "1"])
    main(["search", f"{tmp_path}/index", f"{tmp_path}/places", "boston", "--json"])
    out = capsys.readouterr().out.strip().split("\n")
    assert out[0] == "5" and out[1].startswith("1. Boston, MA (locality, US)") and json.loads(out[2])["results"][0]["gers_id"] == "d"
