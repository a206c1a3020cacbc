"""Column functions against known values and plain Python versions."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo, names, params, score, wkb
from geoloom.functions.text import Porter, fold_table, fts_tokens, index_terms


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("a", "b", "low", "high"),
    [((40.71, -74.01), (34.05, -118.24), 3840, 4040), ((42.3601, -71.0589), (40.7128, -74.006), 301, 311), ((10.0, 20.0), (10.0, 20.0), 0, 0.01), ((0.0, 0.0), (0.0, 180.0), 20015, 20016), ((42.3601, -71.0589), (42.3736, -71.1097), 4, 6)],
)
def test_haversine(spark, a, b, low, high):
    km = one(spark, geo.haversine(*(F.lit(x) for x in (*a, *b))))[0]
    assert low <= km <= high


@pytest.mark.parametrize(("point", "low", "high"), [((41.0, -72.0), 0, 0), ((34.0522, -118.2437), 3000, 5000), ((40.0, -75.0), 1, 100)])
def test_distance_to_bbox(spark, point, low, high):
    km = one(spark, geo.distance_to_bbox(*(F.lit(x) for x in (*point, -74.0, 40.0, -71.0, 43.0))))[0]
    assert low <= km <= high


def test_clamp_keeps_null(spark):
    r = one(spark, geo.clamp(F.lit(None).cast("double")), geo.clamp(F.lit(-1.0)), geo.clamp(F.lit(2.0)), geo.clamp(F.lit(0.5)))
    assert tuple(r) == (None, 0.0, 1.0, 0.5)


def test_radius_box_holds_centre_and_survives_pole(spark):
    r = one(spark, *geo.radius_to_bbox(F.lit(42.0), F.lit(-71.0), F.lit(1.0)))
    assert r[0] < -71 < r[2] and r[1] < 42 < r[3]
    assert one(spark, *geo.radius_to_bbox(F.lit(90.0), F.lit(0.0), F.lit(1.0)))[2] <= 360


def test_ring_with_level_edges(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]))
    hits = one(spark, *(geo.point_in_ring(F.lit(x), F.lit(y), ring) for x, y in [(2.0, 2.0), (5.0, 2.0), (-1.0, 2.0), (2.0, 5.0)]))
    assert tuple(hits) == (True, False, False, False)


def test_rings_with_hole(spark):
    square = lambda a, b: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(a, a), (b, a), (b, b), (a, b)]))
    rings = F.array(square(0, 10), square(4, 6))
    assert tuple(one(spark, geo.point_in_rings(F.lit(5.0), F.lit(5.0), rings), geo.point_in_rings(F.lit(5.0), F.lit(5.0), rings, holes=False), geo.point_in_rings(F.lit(1.0), F.lit(1.0), rings))) == (False, True, True)


def test_wkb_round_trip_and_measures(spark):
    hole = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]], [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]]]
    shapes = [("Point", [1.0, 2.0]), ("LineString", [[0.0, 0.0], [1.0, 1.0]]), ("Polygon", hole), ("MultiPolygon", [hole, [[[20.0, 0.0], [21.0, 0.0], [21.0, 1.0]]]]), ("MultiPoint", [[0.0, 1.0], [2.0, 3.0]])]
    for s in shapes:
        assert wkb.decode(wkb.encode(*s)) == s
    big = struct.pack(">BI2d", 0, 1, 3.0, 4.0)
    assert wkb.decode(big) == ("Point", [3.0, 4.0])
    with_z = struct.pack("<BI3d", 1, 1001, 3.0, 4.0, 5.0)
    assert wkb.decode(with_z) == ("Point", [3.0, 4.0])
    rows = [(i, wkb.encode(*s)) for i, s in enumerate(shapes)] + [(9, b"\x01\x02"), (10, None)]
    got = {r.i: r.m for r in spark.createDataFrame(rows, "i int, g binary").select("i", wkb.measures("g").alias("m")).collect()}
    assert got[0].x == 1.0 and got[0].area == 0.0
    assert got[2].area == 96.0 and got[2].xmax == 10.0 and got[3].area == 96.5
    assert got[9].type is None and got[10].area is None
    assert wkb.contains(*shapes[2], 3.0, 3.0) is False and wkb.contains(*shapes[2], 3.0, 3.0, holes=False) and wkb.contains(*shapes[2], 1.0, 1.0)


def test_scores(spark):
    r = one(spark, *(score.boosted_score(F.lit(-3.0), F.lit(p).cast("long")) for p in (None, 0, -5, 1, 999_999)))
    assert r[0] == r[1] == r[2] == -5.0
    assert math.isclose(r[3], -3 - 2 * math.log(2)) and math.isclose(r[4], -3 - 2 * math.log(1_000_000))
    assert one(spark, score.importance(F.lit(-25.0)), score.importance(F.lit(-500.0)), score.importance(F.lit(3.0)))[:] == (0.5, 1.0, 0.0)


@pytest.mark.parametrize(("name", "query", "hit"), [("Paris, FR", "paris", True), ("Parish, LA", "paris", False), ("Paris", "go paris", True), ("São Paulo", "são", True), ("New York", "york", False), ("Paris x", "  ", False)])
def test_exact_match(spark, name, query, hit):
    assert one(spark, score.has_exact_match(F.lit(name), F.lit(query)))[0] is hit


def test_bias_kinds(spark):
    kind = lambda c, a, b: one(spark, score.bias_kind(F.lit(c).cast("string"), F.lit(a).cast("double"), F.lit(b).cast("double")))[0]
    assert [kind("FR", 1.0, 2.0), kind("FR", None, None), kind(None, 1.0, 2.0), kind("FR", 1.0, None), kind(None, None, None)] == ["full", "country", "coordinates", "none", "none"]


@pytest.mark.parametrize(
    ("text", "auto", "want"),
    [("boston", True, [("boston", True)]), ("boston ma", True, [("boston", False), ("ma", True)]), ("boston", False, [("boston", False)]), ("new york, ny", True, [("new", False), ("york", False), ("ny", True)]), ("St. Louis", True, [("st", False), ("louis", True)]), ("winston-salem", True, [("winston-salem", True)]), ("", True, []), ("   ", True, []), ("...", True, [])],
)
def test_fts_tokens(spark, text, auto, want):
    got = one(spark, fts_tokens(F.lit(text), auto))[0]
    assert [tuple(t) for t in got] == want


def test_index_terms_fold_single_marks_only(spark):
    a, b = fold_table()
    assert len(a) == len(b) and a[b.index("a")] in "àáâãäå"
    assert one(spark, index_terms(F.lit("São-Paulo ẞ Việt x2")))[0][:2] == ["sao", "paulo"]
    assert "việt" in one(spark, index_terms(F.lit("Việt")))[0]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("falling", "fall"), ("relational", "relat"), ("vietnamization", "vietnam"), ("happy", "happi"), ("sky", "sky"), ("adjustment", "adjust"), ("controlling", "control"), ("rate", "rate"), ("paris", "pari")])
def test_porter(word, stem):
    assert Porter.stem(word) == stem


def test_names(spark):
    n = lambda c, r: one(spark, names.primary_name(F.lit("X"), F.lit(c).cast("string"), F.lit(r).cast("string")))[0]
    assert [n("US", "US-MA"), n("GB", "GB-ENG"), n("FR", None), n(None, None)] == ["X, MA", "X, GB-ENG", "X, FR", "X, "]
    assert one(spark, names.distinct_words(F.lit("Paris paris"), F.lit(None), F.lit("FR Paris")))[0] == "paris paris fr"


def test_params(spark):
    r = one(spark, *(params.limit(F.lit(x).cast("string")) for x in ("5", "99", "x", None, "-1", "7.5")))
    assert tuple(r) == (5, 40, 10, 10, 10, 10)
    assert one(spark, params.query_error(F.lit("é" * 101)), params.query_error(F.lit(" ")), params.query_error(F.lit("")))[:] == ("query too long", None, "missing query")
    assert params.checked_region("CN-XX") == "CN-XX"
    for bad in ("us", "USA", "U1"):
        with pytest.raises(ValueError, match="country"):
            params.checked_country(bad)
    for bad in ("US", "usa-MA"):
        with pytest.raises(ValueError, match="region"):
            params.checked_region(bad)
    with pytest.raises(ValueError, match="threshold"):
        params.checked_threshold(-1)
