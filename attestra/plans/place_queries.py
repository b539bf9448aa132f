"""Registered queries of locations and places, beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.config import DEFAULT as S
from attestra.functions.locations import POINTS
from attestra.operators import places
from attestra.plans.catalogue import register
from attestra.sources import star

# Each customer states a location; which form it takes follows from the key, so SQL needs no parser. Customers are named by their
# keys; those with 6 to 8 as last digit are placed from the customer before, so chains of three begin at each with 5.
_DEGREES = "(k % 80)::DOUBLE + (k % 50) / 60.0"
_EAST = "(k % 170)::DOUBLE + (k % 40) / 60.0"
_SECONDS = " + (k % 60) / 3600.0"
_KM = "(k % 90 + 1) * 0.5"


def _ahead(name: str, rows: str) -> str:
    """name: rows (id, lat, lon, km, bearing) led on over the ellipsoid, as (id, lat, lon), by the direct formula in three steps."""
    f = "(1 / 298.257223563)"
    step = "g + bb * sin(sg) * (cos(2 * st + sg) + bb / 4 * (cos(sg) * (2 * pow(cos(2 * st + sg), 2) - 1) - bb / 6 * cos(2 * st + sg) * (4 * pow(sin(sg), 2) - 3) * (4 * pow(cos(2 * st + sg), 2) - 3)))"
    return f"""{name}0 AS (SELECT id, lon, km, radians(bearing) AS w, atan((1 - {f}) * tan(radians(lat))) AS u FROM ({rows})
), {name}1 AS (SELECT *, atan2(tan(u), cos(w)) AS st, cos(u) * sin(w) AS sa FROM {name}0
), {name}2 AS (SELECT *, 1 - sa * sa AS c2, (1 - sa * sa) * (1 / pow(1 - {f}, 2) - 1) AS uu FROM {name}1
), {name}3 AS (SELECT *, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb, km / ((1 - {f}) * 6378.137 * (1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))))) AS g FROM {name}2
), {name}4 AS (SELECT *, g AS sg FROM {name}3
), {name}5 AS (SELECT * EXCLUDE (sg), {step} AS sg FROM {name}4
), {name}6 AS (SELECT * EXCLUDE (sg), {step} AS sg FROM {name}5
), {name}7 AS (SELECT * EXCLUDE (sg), {step} AS sg FROM {name}6
), {name}8 AS (SELECT *, cos(2 * st + sg) AS m, {f} / 16 * c2 * (4 + {f} * (4 - 3 * c2)) AS cc FROM {name}7
), {name} AS MATERIALIZED (SELECT id, degrees(atan2(sin(u) * cos(sg) + cos(u) * sin(sg) * cos(w), (1 - {f}) * sqrt(sa * sa + pow(sin(u) * sin(sg) - cos(u) * cos(sg) * cos(w), 2)))) AS lat,
  lon + degrees(atan2(sin(sg) * sin(w), cos(u) * cos(sg) - sin(u) * sin(sg) * cos(w)) - (1 - cc) * {f} * sa * (sg + cc * sin(sg) * (m + cc * cos(sg) * (2 * m * m - 1)))) AS lon FROM {name}8)"""


_LOCATIONS = f"""WITH said AS (SELECT c_custkey AS k, c_nationkey AS n, 'c' || c_custkey AS id FROM customer
), town AS (SELECT n_nationkey AS n, n_name AS name, n_nationkey * 2.5 AS lat, n_nationkey * 3.5 AS lon, ['site', 'city', NULL][n_nationkey % 3 + 1] AS precision FROM nation
), own AS MATERIALIZED (SELECT k, id, CASE k % 10 WHEN 0 THEN 'DMS' WHEN 1 THEN 'DMS' WHEN 2 THEN 'DMS' WHEN 3 THEN 'url' WHEN 5 THEN 'DD' END AS format,
    CASE k % 10 WHEN 0 THEN {_DEGREES}{_SECONDS} WHEN 1 THEN -({_DEGREES}{_SECONDS}) WHEN 2 THEN {_DEGREES} WHEN 3 THEN -((k % 89)::DOUBLE + 0.25) WHEN 5 THEN (k % 89)::DOUBLE + 0.0625 END AS lat,
    CASE k % 10 WHEN 0 THEN {_EAST} WHEN 1 THEN -({_EAST}) WHEN 2 THEN {_EAST} WHEN 3 THEN (k % 179)::DOUBLE + 0.75 WHEN 5 THEN -((k % 169)::DOUBLE + 0.0625) END AS lon,
    CASE k % 10 WHEN 0 THEN 'pad' WHEN 1 THEN 'pad' WHEN 2 THEN 'site' WHEN 3 THEN 'site' WHEN 5 THEN 'pad' END AS precision FROM said WHERE k % 10 IN (0, 1, 2, 3, 5)
), """ + _ahead("six", f"SELECT s.id, o.lat, o.lon, {_KM.replace('k', 's.k')} AS km, (s.k % 16) * 22.5 AS bearing FROM said s JOIN own o ON o.k = s.k - 1 WHERE s.k % 10 = 6") + ", " + _ahead("seven", f"SELECT s.id, o.lat, o.lon, {_KM.replace('k', 's.k')} AS km, (s.k % 16) * 22.5 AS bearing FROM said s JOIN six o ON o.id = 'c' || (s.k - 1) WHERE s.k % 10 = 7") + ", " + _ahead("eight", f"SELECT s.id, o.lat, o.lon, {_KM.replace('k', 's.k')} AS km, (s.k % 16) * 22.5 AS bearing FROM said s JOIN seven o ON o.id = 'c' || (s.k - 1) WHERE s.k % 10 = 8") + """, found AS (
  SELECT id, lat, lon, precision, 'stated' AS via, 1.0::DOUBLE AS confidence, 0 AS round FROM own
  UNION ALL SELECT id, lat, lon, NULL, 'offset', 0.5, 1 FROM six UNION ALL SELECT id, lat, lon, NULL, 'offset', 0.5, 2 FROM seven UNION ALL SELECT id, lat, lon, NULL, 'offset', 0.5, 3 FROM eight
  UNION ALL SELECT id, lat, lon, precision, 'gazetteer', 0.9, 1 FROM said JOIN town USING (n) WHERE k % 10 = 4
)"""


def _texts():
    k = F.col("c_custkey")
    two = lambda x, w=2: F.lpad(x.cast("string"), w, "0")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    point = star.pick(k % 16, list(POINTS))
    forms = [
        text((k % 80).cast("string"), "°", (k % 50).cast("string"), "′", (k % 60).cast("string"), "″N ", (k % 170).cast("string"), "°", (k % 40).cast("string"), "′E"),
        text(two(k % 80), two(k % 50), two(k % 60), "S ", two(k % 170, 3), two(k % 40), "00W"),
        text(two(k % 80), "-", two(k % 50), ".00N ", two(k % 170, 3), "-", two(k % 40), ".00E"),
        text("https://maps.example.com/?z=9&q=-", (k % 89).cast("string"), ".25,", (k % 179).cast("string"), ".75"),
        F.lower("n_name"),
        text((k % 89).cast("string"), ".0625, -", (k % 169).cast("string"), ".0625"),
        *[text("~", ((k % 90 + 1) * 0.5).cast("string"), " km ", point, " of customer ", (k - 1).cast("string"))] * 3,
        F.when(k % 20 == 9, text("2 km N of customer ", k.cast("string"))).when(k % 40 == 19, "43S CT 23715 21242"),
    ]
    return forms, k


def _mentions(spark, d):
    forms, k = _texts()
    c = star.table(spark, d, "customer").join(star.table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    raw = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        raw = F.when(k % 10 == i, form).otherwise(raw)
    return c.select(F.concat(F.lit("c"), k).alias("id"), raw.alias("raw"), F.lit(None).cast("string").alias("declared"), F.concat(F.lit("Customer "), k).alias("name"))


def _towns(spark, d):
    n = F.col("n_nationkey")
    precision = star.pick(n % 3, ["site", "city", None])
    return star.table(spark, d, "nation").select(n.alias("ord"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("Old "), "n_name")).alias("aliases"), F.lit(None).cast("array<string>").alias("codes"), (n * 2.5).alias("lat"), (n * 3.5).alias("lon"), precision.alias("precision"))


@register(
    _LOCATIONS
    + f""" SELECT id, CASE WHEN k % 10 IN (0, 1, 2) THEN 'DMS' WHEN k % 10 = 3 THEN 'url' WHEN k % 10 = 4 THEN 'toponym' WHEN k % 10 = 5 THEN 'DD' WHEN k % 10 IN (6, 7, 8) OR k % 20 = 9 THEN 'relative' WHEN k % 40 = 19 THEN 'MGRS' END AS format,
  round(lat, 6) AS lat, round(lon, 6) AS lon, precision, via, confidence, CASE precision WHEN 'pad' THEN 500.0 WHEN 'site' THEN 1500.0 WHEN 'city' THEN 15000.0 END::DOUBLE AS radius_m, round
FROM said LEFT JOIN found USING (id)""",
    base=False,
)
def locations_resolved(spark, d):
    got = places.locate(_mentions(spark, d), places.gazetteer(_towns(spark, d)), S)
    return got.select("id", "format", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "precision", "via", "confidence", "radius_m", "round")


_MATCHED = """WITH town AS (SELECT 'pl' || n_nationkey AS place, n_nationkey * 2.5 AS lat, n_nationkey * 3.5 AS lon, ['site', 'city', 'pad'][n_nationkey % 3 + 1] AS precision FROM nation
), ents AS (SELECT 's' || s_suppkey AS id, s_suppkey AS k, ['base', 'port'][s_suppkey % 2 + 1] AS type, 'pl' || s_nationkey AS place, CASE WHEN s_suppkey % 5 = 4 THEN 'near' ELSE 'exact' END AS band FROM supplier)"""


def _matched(spark, d):
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    towns = star.table(spark, d, "nation").select(F.concat(F.lit("pl"), n).alias("place"), (n * 2.5).alias("lat"), (n * 3.5).alias("lon"), star.pick(n % 3, ["site", "city", "pad"]).alias("precision"))
    s = star.table(spark, d, "supplier")
    ents = s.select(F.concat(F.lit("s"), k).alias("id"), k.alias("k"), star.pick(k % 2, ["base", "port"]).alias("type"))
    matches = s.select(F.concat(F.lit("s"), k).alias("id"), F.concat(F.lit("pl"), "s_nationkey").alias("place"), F.when(k % 5 == 4, "near").otherwise("exact").alias("band"), F.lit("toponym").alias("via"), F.lit(None).cast("double").alias("distance_km"))
    return towns, ents, matches


@register(
    _MATCHED
    + """, it AS (SELECT e.* FROM ents e JOIN town USING (place) WHERE precision <> 'city'
), ranked AS (SELECT *, row_number() OVER (PARTITION BY place, type ORDER BY id) AS r FROM it WHERE band = 'exact'
), heads AS (SELECT place, type, min(id) FILTER (r = 1) AS one, min(id) FILTER (r = 2) AS two FROM ranked GROUP BY 1, 2)
SELECT id, place, type, CASE WHEN r = 2 OR (r > 2 AND k % 7 = 3) THEN two ELSE one END AS class, 'same' AS verdict FROM ranked JOIN heads USING (place, type)
UNION ALL SELECT id, place, type, NULL, 'candidate' FROM it WHERE band = 'near'""",
    base=False,
)
def places_fused(spark, d):
    towns, ents, matches = _matched(spark, d)
    # the two first members of a class are apart, and so are the first and each whose key is 3 modulo 7
    first = matches.where("band = 'exact'").join(ents, "id").groupBy("place", "type").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 2).alias("_two"))
    members = matches.where("band = 'exact'").join(ents, "id").join(first, ["place", "type"])
    bars = members.where((F.col("id") == F.try_element_at("_two", F.lit(2))) | ((F.col("k") % 7 == 3) & (F.col("id") != F.col("_two")[0]))).select(F.col("_two")[0].alias("a"), F.col("id").alias("b"))
    return places.fuse(matches, ents, towns, bars)


@register(
    _MATCHED
    + """, nodes AS (SELECT id, place, band, CASE WHEN k % 3 > 0 THEN (k % 90)::DOUBLE END AS lat, CASE WHEN k % 3 > 0 THEN (k % 180)::DOUBLE END AS lon, CASE k % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'pad' WHEN 2 THEN 'district' END AS precision, k % 11 <> 0 AS met FROM ents
), stamped AS (SELECT id, CASE WHEN met THEN n.place END AS place, CASE WHEN met THEN band END AS band, CASE WHEN n.lat IS NULL AND met THEN t.lat ELSE n.lat END AS lat, CASE WHEN n.lat IS NULL AND met THEN t.lon ELSE n.lon END AS lon,
    CASE WHEN n.lat IS NULL AND met THEN t.precision WHEN n.lat IS NOT NULL AND met AND band = 'exact' THEN CASE WHEN n.precision IS NULL OR list_position(['pad', 'site', 'terminal', 'district', 'city'], t.precision) < list_position(['pad', 'site', 'terminal', 'district', 'city'], n.precision) THEN t.precision ELSE n.precision END ELSE n.precision END AS precision,
    CASE WHEN n.lat IS NOT NULL THEN 'stated' WHEN met THEN 'anchor' END AS location_source FROM nodes n JOIN town t USING (place))
SELECT *, CASE WHEN location_source IS NOT NULL THEN CASE precision WHEN 'pad' THEN 500.0 WHEN 'site' THEN 1500.0 WHEN 'district' THEN 5000.0 WHEN 'city' THEN 15000.0 END END::DOUBLE AS radius_m FROM stamped""",
    base=False,
)
def places_stamped(spark, d):
    towns, ents, matches = _matched(spark, d)
    k = F.col("k")
    nodes = ents.select("id", F.when(k % 3 > 0, (k % 90).cast("double")).alias("lat"), F.when(k % 3 > 0, (k % 180).cast("double")).alias("lon"), star.pick(k % 4, ["city", "pad", "district", None]).alias("precision"))
    met = matches.join(ents.where(k % 11 != 0), "id", "left_semi")
    return places.stamp(nodes, met, towns).select("id", "place", "band", "lat", "lon", "precision", "location_source", "radius_m")


@register(_MATCHED + ", n AS (SELECT place, count(*) AS n FROM ents GROUP BY 1), p AS (SELECT least('pl' || x.n_nationkey, 'pl' || y.n_nationkey) AS place_a, greatest('pl' || x.n_nationkey, 'pl' || y.n_nationkey) AS place_b FROM nation x JOIN nation y ON y.n_nationkey = x.n_nationkey + 1) SELECT place_a, place_b, a.n AS n_a, b.n AS n_b FROM p JOIN n a ON a.place = place_a JOIN n b ON b.place = place_b", base=False)
def barred_places(spark, d):
    towns, _, matches = _matched(spark, d)
    n = star.table(spark, d, "nation").select("n_nationkey")
    return places.barred_places(matches, n.select(F.concat(F.lit("pl"), "n_nationkey").alias("a"), F.concat(F.lit("pl"), F.col("n_nationkey") + 1).alias("b")))
