"""Locations found by name, by landmark and by what other rows say; mentions of one place fused; nodes stamped with their place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.config import DEFAULT, Settings
from attestra.functions import geo, text
from attestra.functions.locations import finer, place_of_precision, stated
from attestra.operators.clustering import clusters
from attestra.operators.graph import written

_AT = "struct<lat: double, lon: double, precision: string, via: string>"


def gazetteer(places: DataFrame, pairs: dict[str, str] | None = None) -> DataFrame:
    """(key, lat, lon, precision): the exact names of places (ord, name, aliases, codes, lat, lon, precision), normalised, one row each.

    A name of several places is the first one's by ord, its own name before its aliases and these before its codes. Places without
    coordinates name nothing. Null lists are empty.
    """
    none = F.array().cast("array<string>")
    forms = F.concat(F.array("name"), F.coalesce("aliases", none), F.coalesce("codes", none))
    named = places.where("lat is not null and lon is not null").select("ord", "lat", "lon", "precision", F.posexplode(forms).alias("_i", "_form"))
    first = named.withColumn("key", text.normalise_name(F.col("_form"), pairs)).where("key <> ''").groupBy("key").agg(F.min(F.struct("ord", "_i", "lat", "lon", "precision")).alias("_f"))
    return first.select("key", "_f.lat", "_f.lon", "_f.precision")


def locate(mentions: DataFrame, known: DataFrame, settings: Settings = DEFAULT, pairs: dict[str, str] | None = None) -> DataFrame:
    """Where each of mentions (id, raw, declared, name) is: id, format, lat, lon, precision, via, confidence, radius_m, alias, round.

    known: a gazetteer. A position in the text is stated. A name is looked up, and so is a landmark, from which the stated distance and
    bearing lead on. A mention that bears a name (null: none) lends its position to later rounds under it, unless the gazetteer has
    that name; of several in the round that first finds one the most precise lends it, ties by id. So landmarks resolve in the order in
    which they hang on each other, one round for each step; those that hang on each other in a circle, or on nothing, stay without a
    position. The radius follows the precision; a position reached from a landmark has no class of precision, so no radius. Null or
    blank texts have null columns. alias: the name that was, or was not, found. Ids are unique.
    """
    said = mentions.select("id", "name", stated(F.col("raw"), F.col("declared")).alias("s"), F.trim("raw").alias("_text"))
    alias = F.when(F.col("s.format") == "relative", F.col("s.anchor")).when(F.col("s.format") == "toponym", F.col("_text"))
    said = written(said.select("id", text.normalise_name(F.col("name"), pairs).alias("own"), "s", alias.alias("alias"), text.normalise_name(alias, pairs).alias("need")))
    here = F.when(F.col("s.lat").isNotNull(), F.struct(F.col("s.lat").alias("lat"), F.col("s.lon").alias("lon"), F.col("s.precision").alias("precision"), F.lit("stated").alias("via")))
    done = said.select("id", "own", "s", "alias", here.alias("at"), F.when(here.isNotNull(), 0).alias("round")).where("at is not null or coalesce(alias, '') = ''")
    open_ = said.where("s.lat is null and alias <> ''")
    known = written(known.select("key", "lat", "lon", "precision"))
    taken = known.select("key")
    fresh = written(known.withColumn("_via", F.lit("gazetteer")).unionByName(_lent(done, taken)))
    k = 1
    while not fresh.isEmpty():
        to = fresh.select(F.col("key").alias("need"), F.struct("lat", "lon", "precision", F.col("_via").alias("via")).alias("_to"))
        met = open_.join(to, "need", "left")
        off = geo.geodesic_destination("_to.lat", "_to.lon", "s.km", "s.bearing")
        way = met.where("_to is not null and s.format = 'relative'").withColumn("_d", off)
        led = way.select("id", "own", "s", "alias", F.struct("_d.lat", "_d.lon", F.lit(None).cast("string").alias("precision"), F.lit("offset").alias("via")).cast(_AT).alias("at"))
        got = met.where("_to is not null and s.format = 'toponym'").select("id", "own", "s", "alias", F.col("_to").cast(_AT).alias("at")).unionByName(led)
        got = written(got.withColumn("round", F.lit(k)))
        done = done.unionByName(got)
        taken = taken.unionByName(fresh.select("key"))
        open_ = written(open_.join(got.select("id"), "id", "left_anti"))
        fresh = written(_lent(got, taken))
        k += 1
    out = done.unionByName(open_.select("id", "own", "s", "alias", F.lit(None).cast(_AT).alias("at"), F.lit(None).cast("int").alias("round")))
    table = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])
    return out.select(
        "id", "s.format", "at.lat", "at.lon", "at.precision", "at.via",
        F.try_element_at(table(settings.location_confidence), F.col("at.via")).alias("confidence"),
        F.try_element_at(table(settings.precision_radius_m), F.col("at.precision")).alias("radius_m"),
        F.when(F.col("alias") != "", F.col("alias")).alias("alias"), "round",
    )


def _lent(located: DataFrame, taken: DataFrame) -> DataFrame:
    """(key, lat, lon, precision, _via): positions that located rows lend under names not yet taken."""
    fit = located.where("at is not null and own <> ''").groupBy(F.col("own").alias("key")).agg(F.min(F.struct(place_of_precision(F.coalesce("at.precision", F.lit(""))).alias("p"), "id", "at")).alias("b"))
    return fit.join(taken, "key", "left_anti").select("key", "b.at.lat", "b.at.lon", "b.at.precision", F.lit("mention").alias("_via"))


def fuse(matches: DataFrame, entities: DataFrame, places: DataFrame, vetoes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(id, place, type, class, verdict) of entities (id, type) whose matches (id, place, band) name a place that is a thing.

    Entities of one type that match one place exactly are one class, unless a veto (a, b) keeps them apart: an entity joins, in the order of
    ids, the first class that none of its vetoes has a member in. Classes are named by their smallest member, verdict same. Those
    near the place are candidates for all the place's classes of their type, one row with a null class. A place whose precision is coarser
    than settings.identity_precisions, or not known, is an area that many things share: nothing is fused on it. Pairs are not listed:
    a class and its members stand for them.
    """
    things = places.where(F.col("precision").isin(*settings.identity_precisions)).select("place")
    at = written(matches.join(things, "place", "left_semi").join(entities.select("id", "type"), "id").select("id", "place", "type", "band"))
    left, classes = at.where("band = 'exact'"), []
    bars = written(vetoes.select("a", "b").where("a <> b").distinct())
    while not left.isEmpty():
        head = left.groupBy("place", "type").agg(F.min("id").alias("head"))
        star = left.join(head, ["place", "type"])
        linked = clusters(star.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score")), bars)
        # only what hangs with the head is settled; a bar may have kept others out, and they go on without it
        own = star.join(linked.withColumnRenamed("raw", "id"), "id", "left").withColumn("_in", (F.col("id") == F.col("head")) | (F.coalesce("cluster", "id") == F.col("head")))
        own = written(own)
        classes.append(own.where("_in").select("id", "place", "type", F.col("head").alias("class"), F.lit("same").alias("verdict")))
        left = own.where("not _in").select("id", "place", "type", "band")
    out = at.where("band <> 'exact'").select("id", "place", "type", F.lit(None).cast("string").alias("class"), F.lit("candidate").alias("verdict"))
    for c in classes:
        out = out.unionByName(c)
    return out


def barred_places(matches: DataFrame, distinct: DataFrame) -> DataFrame:
    """(place_a, place_b, n_a, n_b): places (a, b) that are known to be distinct, each with the number of entities matched to it.

    No entity of the one may be merged with one of the other: all pairs of members are vetoed, but only their classes are listed.
    """
    n = matches.groupBy("place").agg(F.count("*").alias("n"))
    pair = distinct.select(F.least("a", "b").alias("place_a"), F.greatest("a", "b").alias("place_b")).where("place_a <> place_b").distinct()
    return pair.join(n.select(F.col("place").alias("place_a"), F.col("n").alias("n_a")), "place_a").join(n.select(F.col("place").alias("place_b"), F.col("n").alias("n_b")), "place_b")


def stamp(nodes: DataFrame, matches: DataFrame, places: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """nodes (id, lat, lon, precision, ...) with place, band, via, distance_km, location_source and radius_m; the first three may change.

    matches (id, place, band, via, distance_km), one a node at most; places (place, lat, lon, precision). A node without a position takes that of its place, and its
    precision, source anchor; one with a position keeps it, source stated, and, if matched exactly, the finer of both precisions. A node
    without a match keeps what it has. Without a position there is no source and no radius, nor is there a radius for an unknown precision.
    """
    p = places.select("place", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("precision").alias("_precision"))
    met = nodes.join(matches.select("id", "place", "band", "via", "distance_km"), "id", "left").join(p, "place", "left")
    bare = F.col("lat").isNull() | F.col("lon").isNull()
    adopts = bare & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    met = met.withColumns({
        "location_source": F.when(adopts, "anchor").when(~bare, "stated"),
        "precision": F.when(adopts, F.col("_precision")).when(~bare & (F.col("band") == "exact"), finer(F.col("precision"), F.col("_precision"))).otherwise(F.col("precision")),
        "_to": F.when(adopts, F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))).otherwise(F.struct("lat", "lon")),
    })
    met = met.withColumns({"lat": F.col("_to.lat"), "lon": F.col("_to.lon")})
    radius = F.try_element_at(F.create_map(*[F.lit(v) for kv in settings.precision_radius_m.items() for v in kv]), F.col("precision"))
    return met.withColumn("radius_m", F.when(F.col("location_source").isNotNull(), radius)).drop("_to", "_lat", "_lon", "_precision")
