"""Stated locations and places, against tables of cases and plain code."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions import geo, locations
from attestra.operators import places

# text: format, lat, lon, precision
CASES = {
    "33.61639, 73.09972": ("DD", 33.61639, 73.09972, "pad"),
    "-33.5 151.25": ("DD", -33.5, 151.25, "site"),
    "33.5 -151.2": ("DD", 33.5, -151.2, "city"),
    "12.5° S, 45.3° W": ("DMS", -12.5, -45.3, "city"),
    "12.5 s;45.3 w": ("DD", -12.5, -45.3, "city"),
    "91.0, 10.0": ("toponym", None, None, None),
    "32°14′20″N 074°07′52″E": ("DMS", 32 + 14 / 60 + 20 / 3600, 74 + 7 / 60 + 52 / 3600, "pad"),
    "32°14'20.5\"S, 74°07'52\"W": ("DMS", -(32 + 14 / 60 + 20.5 / 3600), -(74 + 7 / 60 + 52 / 3600), "pad"),
    "32:14:20N 74:07:52E": ("DMS", 32 + 14 / 60 + 20 / 3600, 74 + 7 / 60 + 52 / 3600, "site"),
    "495355N 0380155E": ("DMS", 49 + 53 / 60 + 55 / 3600, 38 + 1 / 60 + 55 / 3600, "pad"),
    "495355N0380155E": ("DMS", 49 + 53 / 60 + 55 / 3600, 38 + 1 / 60 + 55 / 3600, "pad"),
    "4953N 03801E": ("DMS", 49 + 53 / 60, 38 + 1 / 60, "city"),
    "34-29.00N 071-30.50E": ("DMS", 34 + 29 / 60, 71 + 30.5 / 60, "site"),
    "33N 73E": ("DD", 33.0, 73.0, "city"),
    "33 North, 73 East": ("DMS", 33.0, 73.0, "city"),
    "12 sites, 5 exits": ("toponym", None, None, None),
    "Malir District (24.9012 N, 67.2034 E)": ("DMS", 24.9012, 67.2034, "pad"),
    "32°14′20″N 074°07′52″E, ~1.5 km NE of the runway": ("DMS", 32 + 14 / 60 + 20 / 3600, 74 + 7 / 60 + 52 / 3600, "pad"),
    "https://maps.example.com/?z=3&q=33.6164,73.0997": ("url", 33.6164, 73.0997, "pad"),
    "https://maps.example.com/?ll=33.61%2C73.09": ("url", 33.61, 73.09, "site"),
    "https://example.com/maps/@-33.6,73.1,15z": ("url", -33.6, 73.1, "city"),
    "https://example.com/place/data=!3d33.61!4d-73.09": ("url", 33.61, -73.09, "site"),
    "https://example.com/nowhere": ("url", None, None, None),
    "Grid: 43S CT 23715 21242 (MGRS, WGS84)": ("MGRS", None, None, None),
    "43SCT2371521242": ("MGRS", None, None, None),
    "43S CT 2371 21242": ("toponym", None, None, None),
    "61S CT 23715 21242": ("toponym", None, None, None),
    "43S 323715 mE 3721242 mN": ("UTM", None, None, None),
    "12-15 km NE of Sargodha": ("relative", None, None, None),
    "Eastmoor Barracks": ("toponym", None, None, None),
    "95°N 200°E": ("DMS", None, None, None),
}


def test_shapes_of_locations(spark):
    d = spark.createDataFrame([(t,) for t in CASES] + [(None,), ("  ",), ("9" * 100_000 + " N",)], "raw string")
    got = {r.raw: r.s for r in d.select("raw", locations.stated(F.col("raw")).alias("s")).collect()}
    for t, (shape, lat, lon, precision) in CASES.items():
        s = got[t]
        assert (s.format, s.precision) == (shape, precision), t
        assert (s.lat, s.lon) == (pytest.approx((lat, lon), abs=1e-9) if lat is not None else (None, None)), t
    assert got[None] is None and got["  "] is None and got["9" * 100_000 + " N"].format == "toponym"


def test_declared_shapes(spark):
    d = spark.createDataFrame([("at @33.5,-12.25 it is", "url"), ("Eastmoor", "DMS"), ("33N 73E", "toponym"), ("33N 73E", "url")], "raw string, declared string")
    got = [tuple(r.s)[:3] for r in d.select(locations.stated(F.col("raw"), F.col("declared")).alias("s")).collect()]
    assert got == [("url", 33.5, -12.25), ("toponym", None, None), ("DD", 33.0, 73.0), ("DD", 33.0, 73.0)]


def test_ways_from_landmarks(spark):
    d = spark.createDataFrame([("~10 km NW of Gujranwala.",), ("depot, 5.5 NM sse of  the Port; ",), ("300 metres W of x",), ("10 km of road",), ("10 km up of y",)], "raw string")
    got = [tuple(r.w) if r.w else None for r in d.select(locations.from_landmark(F.col("raw")).alias("w")).collect()]
    assert got[0] == (10.0, 315.0, "Gujranwala") and got[1] == (pytest.approx(10.186), 157.5, "the Port") and got[2] == (pytest.approx(0.3), 270.0, "x")
    assert got[3:] == [None, None]


def test_geodesic_destination_ends_where_the_distance_says(spark):
    rnd = random.Random(5)
    rows = [(rnd.uniform(-80, 80), rnd.uniform(-180, 180), rnd.choice([0.001, 10.0, 800.0, 5000.0]), rnd.choice([0.0, 22.5, 180.0, 337.5])) for _ in range(60)] + [(10.0, 179.99, 50.0, 90.0)]
    d = spark.createDataFrame(rows, "lat double, lon double, km double, bearing double").withColumn("to", geo.geodesic_destination("lat", "lon", "km", "bearing"))
    for r in d.withColumn("back", geo.geodesic_km("lat", "lon", "to.lat", "to.lon")).collect():
        assert r.back == pytest.approx(r.km, abs=1e-6) and -180 <= r.to.lon <= 180
    assert d.where("lat = 10.0").first().to.lon < 0
    none = spark.createDataFrame([(None, 1.0, 1.0, 1.0)], "lat double, lon double, km double, bearing double")
    assert none.select(geo.geodesic_destination("lat", "lon", "km", "bearing").alias("t")).first().t.lat is None


PLACES = [(1, "Nur Base", ["NB"], ["OPRN"], 33.6, 73.1, "site"), (2, "Nur Base", None, None, 1.0, 1.0, "pad"), (3, "Nowhere", None, None, None, None, "city")]


def gaz(spark, rows=PLACES):
    return places.gazetteer(spark.createDataFrame(rows, "ord int, name string, aliases array<string>, codes array<string>, lat double, lon double, precision string"))


def test_locations_in_the_order_in_which_they_hang_on_each_other(spark):
    rows = [
        ("a", "33.61, 73.09", None, "depot one"), ("b", "10 km N of Depot-One", None, "depot two"), ("c", "5 km E of depot two", None, None), ("d", "depot two", None, None),
        ("e", "2 km S of nur  base", None, None), ("f", "oprn", None, "Depot One"), ("g", "1 km N of ring two", None, "ring one"), ("h", "1 km N of ring one", None, "ring two"),
        ("i", None, None, "x"), ("j", " ", None, None), ("k", "Nowhere", None, None), ("l", "0.5, 0.5", None, "Nur Base"), ("m", "43S CT 23715 21242", None, "grid"), ("n", "20.1234, 20.1234", None, "depot one"), ("o", "---", None, None),
    ]
    m = spark.createDataFrame(rows, "id string, raw string, declared string, name string")
    got = {r.id: r for r in places.locate(m, gaz(spark)).collect()}
    assert sorted(got) == [r[0] for r in rows]
    seen = {i: (r.format, r.via, r.round) for i, r in got.items()}
    assert seen == {
        "a": ("DD", "stated", 0), "b": ("relative", "offset", 1), "c": ("relative", "offset", 2), "d": ("toponym", "mention", 2), "e": ("relative", "offset", 1), "f": ("toponym", "gazetteer", 1),
        "g": ("relative", None, None), "h": ("relative", None, None), "i": (None, None, None), "j": (None, None, None), "k": ("toponym", None, None), "l": ("DD", "stated", 0),
        "m": ("MGRS", None, None), "n": ("DD", "stated", 0), "o": ("toponym", None, None),
    }
    # n is finer than a, so depot one is n's; the gazetteer goes before what l calls Nur Base, and its first row before its second
    assert got["b"].lat == pytest.approx(20.2137, abs=1e-3) and got["b"].lon == pytest.approx(20.1234) and got["c"].lon > got["b"].lon
    assert (got["d"].lat, got["d"].lon) == (got["b"].lat, got["b"].lon) and got["d"].precision is None and got["d"].radius_m is None
    assert got["e"].lat == pytest.approx(33.6 - 0.018, abs=1e-3) and (got["f"].lat, got["f"].precision, got["f"].radius_m, got["f"].confidence) == (33.6, "site", 1500.0, 0.9)
    assert (got["a"].radius_m, got["n"].radius_m, got["a"].confidence, got["e"].confidence) == (1500.0, 500.0, 1.0, 0.5)
    empty = places.locate(m.where("false"), gaz(spark, []))
    assert empty.count() == 0


def test_fusion_of_mentions_of_one_place(spark):
    rnd = random.Random(8)
    ids = [f"e{i:02}" for i in range(40)]
    kind = {i: rnd.choice("ub") for i in ids}
    where = {i: rnd.choice(["p", "q", "city"]) for i in ids}
    band = {i: rnd.choice(["exact"] * 4 + ["near"]) for i in ids}
    vetoes = {tuple(sorted(rnd.sample(ids, 2))) for _ in range(60)}
    expected = {}
    for t, p in itertools.product("ub", "pq"):
        classes = []
        for i in ids:
            if (kind[i], where[i], band[i]) == (t, p, "exact"):
                fit = next((c for c in classes if not any(tuple(sorted((i, x))) in vetoes for x in c)), None)
                if fit is None:
                    classes.append([i])
                else:
                    fit.append(i)
        expected |= {i: c[0] for c in classes for i in c}
    m = spark.createDataFrame([(i, where[i], band[i]) for i in ids], "id string, place string, band string")
    e = spark.createDataFrame([(i, kind[i], 1) for i in ids], "id string, type string, place int")
    p = spark.createDataFrame([("p", "pad"), ("q", "site"), ("city", "city"), ("r", None)], "place string, precision string")
    v = spark.createDataFrame(sorted(vetoes), "a string, b string")
    got = places.fuse(m, e, p, v).collect()
    assert {r.id: r["class"] for r in got if r.verdict == "same"} == expected
    assert {r.id for r in got if r.verdict == "candidate"} == {i for i in ids if where[i] != "city" and band[i] == "near"}
    assert places.fuse(m.where("false"), e, p, v).count() == 0


def test_nodes_are_stamped_with_their_place(spark):
    nodes = spark.createDataFrame([("a", None, None, None), ("b", 1.0, 2.0, "city"), ("c", 1.0, 2.0, "city"), ("d", 1.0, 2.0, None), ("e", None, None, "pad"), ("f", None, None, None)], "id string, lat double, lon double, precision string")
    m = spark.createDataFrame([("a", "p", "exact", "toponym", None), ("b", "p", "exact", "code", None), ("c", "p", "near", "proximity", 3.0), ("f", "q", "exact", "code", None)], "id string, place string, band string, via string, distance_km double")
    p = spark.createDataFrame([("p", 5.0, 6.0, "pad"), ("q", None, None, "site")], "place string, lat double, lon double, precision string")
    got = {r.id: (r.place, r.lat, r.lon, r.precision, r.location_source, r.radius_m) for r in places.stamp(nodes, m, p).collect()}
    assert got == {
        "a": ("p", 5.0, 6.0, "pad", "anchor", 500.0), "b": ("p", 1.0, 2.0, "pad", "stated", 500.0), "c": ("p", 1.0, 2.0, "city", "stated", 15000.0),
        "d": (None, 1.0, 2.0, None, "stated", None), "e": (None, None, None, "pad", None, None), "f": ("q", None, None, None, None, None),
    }
