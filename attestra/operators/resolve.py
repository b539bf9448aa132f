"""Entity resolution: candidate pairs by blocking, merge scores in bands, clusters that respect vetoes, places."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.config import DEFAULT, Settings
from attestra.functions.geo import EARTH_KM, haversine_km
from attestra.functions.text import acronym, contains_name, name_similarity, tokens
from attestra.operators.clustering import clusters as clusters
from attestra.operators.graph import components, written


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def profiles(mentions: DataFrame) -> DataFrame:
    """(id, type, attrs) over mentions (id, type, seq, attrs map): for each key the first value, by seq, that is stated."""
    kv = mentions.select("id", "seq", F.explode("attrs").alias("k", "v")).where("v is not null").groupBy("id", "k").agg(F.min_by("v", "seq").alias("v"))
    attrs = kv.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    return mentions.groupBy("id").agg(F.min_by("type", "seq").alias("type"), F.min("seq").alias("first_seq")).join(attrs, "id", "left")


def block_pairs(entities: DataFrame, keys: list[Column]) -> DataFrame:
    """(a, b) of entities (id, type, ns, name) of one type and compatible namespaces that share a block key; a < b."""
    k = entities.select("id", "type", "ns", F.explode(F.array_distinct(F.flatten(F.array(*keys)))).alias("key")).distinct()
    x, y = k.select("type", "key", F.col("id").alias("a"), F.col("ns").alias("an")), k.select("type", "key", F.col("id").alias("b"), F.col("ns").alias("bn"))
    return x.join(y, ["type", "key"]).where("a < b and (an is null or bn is null or an = bn)").select("a", "b").distinct()


def large_blocks(entities: DataFrame, keys: list[Column], limit: int) -> DataFrame:
    k = entities.select("id", "type", F.explode(F.array_distinct(F.flatten(F.array(*keys)))).alias("key")).distinct()
    return k.groupBy("type", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit)


def containment_pairs(names: DataFrame, least_added: int = 3) -> DataFrame:
    """(short, long) of names (name) where long starts with all of short's tokens: joined by first token, not crossed."""
    t = names.select("name", F.try_element_at(tokens(F.col("name")), F.lit(1)).alias("k")).where("k is not null").distinct()
    pairs = t.select("k", F.col("name").alias("short")).join(t.select("k", F.col("name").alias("long")), "k")
    return pairs.where(contains_name(F.col("short"), F.col("long"), 1, least_added)).select("short", "long")


def acronym_pairs(names: DataFrame) -> DataFrame:
    """(short, long): short is the initials of long's tokens, of which there are two or more."""
    long = names.where(F.size(tokens(F.col("name"))) >= 2).select(F.col("name").alias("long"), acronym(F.col("name")).alias("short"))
    return long.join(names.select(F.col("name").alias("short")).distinct(), "short").select("short", "long").distinct()


def shared_neighbours(edges: DataFrame, pairs: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """pairs with shared, either and jaccard of their (predicate, direction, neighbour) sets. edges: (predicate, subject, object)."""
    n = edges.select(F.col("subject").alias("id"), F.concat_ws(">", "predicate", F.lit("out"), "object").alias("n")).unionByName(edges.select(F.col("object").alias("id"), F.concat_ws(">", "predicate", F.lit("in"), "subject").alias("n")))
    if canonical is not None:
        n = n.join(canonical.select(F.col("raw").alias("id"), "canonical"), "id", "left").select(F.coalesce("canonical", "id").alias("id"), "n")
    n = n.distinct()
    size = n.groupBy("id").agg(F.count("*").alias("size"))
    both = pairs.join(n.select(F.col("id").alias("a"), "n"), "a").join(n.select(F.col("id").alias("b"), "n"), ["b", "n"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    met = pairs.join(both, ["a", "b"], "left").join(size.select(F.col("id").alias("a"), F.col("size").alias("sa")), "a", "left").join(size.select(F.col("id").alias("b"), F.col("size").alias("sb")), "b", "left")
    shared = F.coalesce("shared", F.lit(0))
    either = F.coalesce("sa", F.lit(0)) + F.coalesce("sb", F.lit(0)) - shared
    return met.select("a", "b", shared.alias("shared"), either.alias("either"), F.when(either > 0, shared / either).otherwise(0.0).alias("jaccard"))


def merge_scores(pairs: DataFrame, settings: Settings = DEFAULT, support: int = 2) -> DataFrame:
    """pairs (a, b, name_a, name_b, jaccard, shared, overlap, asserted, raised) with score, total and band.

    The band auto looks at the score without what sources assert; review takes the total, or a pair that was raised.
    """
    w = settings.merge_weights
    relational = F.col("jaccard") * F.least(F.lit(1.0), F.col("shared") / support)
    out = pairs.withColumn("attribute", name_similarity(F.col("name_a"), F.col("name_b"))).withColumn("relational", relational)
    out = out.withColumn("score", w["attribute"] * F.col("attribute") + w["relational"] * F.col("relational") + w["temporal"] * F.col("overlap"))
    out = out.withColumn("total", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.col("asserted"))))
    band = F.when(F.round("score", 9) >= settings.merge_auto, "auto").when((F.round("total", 9) >= settings.merge_review) | F.col("raised"), "review").otherwise("none")
    return out.withColumn("band", band)


def alias_classes(aliases: DataFrame) -> DataFrame:
    """(name, root): names that aliases (a, b) connect."""
    return components(aliases).select(F.col("node").alias("name"), "root")


def canonical_names(cluster_rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(cluster, canonical): a registered member, else one that an alias names, else the one of most edges, else the smallest id.

    entities: (id, registered, alias_named, degree).
    """
    met = cluster_rows.join(entities, cluster_rows.raw == entities.id)
    return met.groupBy("cluster").agg(F.min_by("raw", F.struct((~F.col("registered")).alias("r"), (~F.col("alias_named")).alias("n"), (-F.col("degree")).alias("d"), "raw")).alias("canonical"))


def identifier_conflicts(entities: DataFrame, block: int = 1000, tiles: int = 8) -> DataFrame:
    """(a, b) of one type and name whose identifiers differ, each once. entities: (id, type, name, ident).

    Pairs are as many as the square of a group. Its members are dealt over blocks of some block rows, two blocks are a tile, and a task
    has some tiles tiles: a large group is no task's alone, and a task's pairs are as many however large the input is.
    """
    # of an id that states several identifiers, the least and the greatest tell whether it differs from another
    x = entities.where("ident is not null").groupBy("id", "type", "name").agg(F.min("ident").alias("lo"), F.max("ident").alias("hi"))
    blocks = F.ceil(F.col("n") / block).cast("int").alias("blocks")
    groups = x.where("type is not null and name is not null").groupBy("type", "name").agg(F.count("*").alias("n")).select("type", "name", blocks)
    n = groups.agg(F.sum(F.expr("blocks * (blocks + 1L) div 2"))).first()[0] or 0
    parts = max(x.sparkSession.sparkContext.defaultParallelism, -(-n // tiles))
    dealt = x.join(groups, ["type", "name"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    key = ["type", "name", "i", "j"]
    a = dealt.withColumns({"i": F.col("own"), "j": F.explode(F.sequence("own", F.col("blocks") - 1))}).select(*key, F.col("id").alias("a"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    b = dealt.withColumns({"i": F.explode(F.sequence(F.lit(0), "own")), "j": F.col("own")}).select(*key, F.col("id").alias("b"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    met = a.repartition(parts, *key).hint("merge").join(b.repartition(parts, *key), key)
    return met.where("(i < j or a < b) and (la <> hb or ha <> lb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def identifier_vetoes(pairs: DataFrame, idents: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) those of one type that state different hard identifiers. idents: (id, type, ident), ident null: none stated.

    Only candidates are looked at: all pairs of a type that differ are as many as its square, and no other pair could merge.
    """
    x = idents.where("ident is not null")
    met = pairs.join(x.select(F.col("id").alias("a"), F.col("type").alias("ta"), F.col("ident").alias("ia")), "a")
    return met.join(x.select(F.col("id").alias("b"), F.col("type").alias("tb"), F.col("ident").alias("ib")), "b").where("ta = tb and ia <> ib").select("a", "b").distinct()


def identifier_classes(idents: DataFrame) -> DataFrame:
    """(type, ident, n, barred): each hard identifier's members, and how many of its type it can never be one with."""
    n = idents.where("ident is not null").groupBy("type", "ident").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("type").agg(F.sum("n").alias("all")), "type").select("type", "ident", "n", (F.col("all") - F.col("n")).alias("barred"))


def geo_conflict_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, tolerance: Column) -> Column:
    """How far two stated positions lie apart where that is too far for one thing, else null; so too without a position or a tolerance."""
    km = haversine_km(lat1, lon1, lat2, lon2)
    return F.when(km > tolerance, km)


def hard_conflict(type_a: Column, type_b: Column, attributes: list[tuple[Column, Column]], numbers: list[tuple[Column, Column, float]], apart_km: Column) -> Column:
    """Whether two entities can't be one: types differ, positions are too far apart, or a stated attribute or number contradicts.

    What only one side states is no conflict.
    """
    tests = [~type_a.eqNullSafe(type_b), apart_km.isNotNull(), *[a != b for a, b in attributes], *[numeric_conflict(a, b, t) for a, b, t in numbers]]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def unmoved_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with relocated, shared and either of their neighbours but for those of instances in which both are the same end.

    edges: (predicate, subject, object, instance). Two sites of one instance are where something was and is, so it tells nothing about
    the sites being one: those edges are left out for that pair, and relocated says so.
    """
    mine = pairs.select("a", "b").distinct()
    end = lambda e, other, way: F.struct(F.col(e).alias("id"), F.lit(way).alias("end"), F.concat_ws(">", "predicate", F.lit(way), other).alias("n"))
    n = edges.select("instance", F.explode(F.array(end("subject", "object", "out"), end("object", "subject", "in"))).alias("e")).select("instance", "e.*")
    sides = mine.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("side")), F.struct(F.col("b").alias("id"), F.lit(2).alias("side")))).alias("s"))
    # a pair's edges meet once, and stay for all that follows
    met = sides.select("a", "b", "s.*").join(n, "id").repartition("a", "b")
    both = (F.bit_or("side").over(Window.partitionBy("a", "b", "instance", "end")) == 3) & F.col("instance").isNotNull()
    met = met.withColumn("both", both).withColumn("moved", F.max("both").over(Window.partitionBy("a", "b", "instance")))
    each = met.groupBy("a", "b", "n").agg(F.bit_or(F.when(~F.col("moved"), F.col("side"))).alias("sides"), F.max("moved").alias("moved"))
    out = each.groupBy("a", "b").agg(F.max("moved").alias("moved"), F.count_if(F.col("sides") == 3).alias("shared"), F.count("sides").alias("either"))
    return mine.join(out, ["a", "b"], "left").select("a", "b", F.coalesce("moved", F.lit(False)).alias("relocated"), F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("either", F.lit(0)).alias("either"))


def numeric_conflict(a: Column, b: Column, tolerance: float) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top > 0, F.abs(a - b) / top > tolerance).otherwise(F.lit(False))


def match_places(sites: DataFrame, places: DataFrame, radius_km: float) -> DataFrame:
    """(id, place, via, distance_km, band) of sites (id, code, toponym, lat, lon).

    places: (place, code, toponym, lat, lon, ord): by code, else toponym, of several the first; else the nearest within three radii,
    near within one. Sites and places meet in cells of latitude and longitude, so neither side meets a whole belt of the other.
    """
    p = places.select("place", F.col("code").alias("pc"), F.col("toponym").alias("pt"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), "ord")
    code = sites.join(p, F.col("code") == F.col("pc")).groupBy("id").agg(F.min_by("place", "ord").alias("by_code"))
    name = sites.join(p, F.col("toponym") == F.col("pt")).groupBy("id").agg(F.min_by("place", "ord").alias("by_name"))
    # cells of at least three radii: a place within reach lies in the site's cell or a neighbour of it, across 180 degrees too
    step = max(radius_km * 3 / 111.0, 1e-6)
    cell = lambda c: F.floor(c / step).cast("int")
    far = F.greatest(F.abs(F.col("cy") - 1), F.abs(F.col("cy") + 2)) * step
    span = F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(min(radius_km * 3 / (2 * EARTH_KM), math.pi / 2)) / F.cos(F.radians(F.least(far, F.lit(89.9)))))))
    n = F.when(far >= 89.9, 1).otherwise(F.greatest(F.lit(1), F.floor(360.0 / F.greatest(span, F.lit(1e-6))).cast("int")))
    cx = lambda lon: F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * F.col("n") / 360.0).cast("int")
    near = p.withColumn("cy", F.explode(F.sequence(cell(F.col("plat")) - 1, cell(F.col("plat")) + 1))).withColumn("n", n)
    beside = F.array_distinct(F.array(*[F.pmod(cx(F.col("plon")) + i, F.col("n")) for i in (-1, 0, 1)]))
    near = near.withColumn("cx", F.explode(beside)).drop("n")
    s = sites.where("lat is not null and lon is not null").withColumn("cy", cell(F.col("lat"))).withColumn("n", n).withColumn("cx", F.pmod(cx(F.col("lon")), F.col("n"))).drop("n")
    d = s.join(near, ["cy", "cx"]).withColumn("distance_km", haversine_km(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where(F.col("distance_km") <= 3 * radius_km)
    best = d.groupBy("id").agg(F.min(F.struct("distance_km", "ord", "place")).alias("n"))
    met = sites.join(code, "id", "left").join(name, "id", "left").join(best, "id", "left")
    via = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_name").isNotNull(), "toponym").when(F.col("n").isNotNull(), "proximity")
    dist = F.when(via == "proximity", F.col("n.distance_km"))
    return met.select("id", F.coalesce("by_code", "by_name", "n.place").alias("place"), via.alias("via"), dist.alias("distance_km"), F.when(via.isin("code", "toponym"), "exact").when(dist <= radius_km, "near").when(dist.isNotNull(), "far").alias("band"))


def type_sets(mentions: DataFrame) -> DataFrame:
    """(name, types) implied by each surface form."""
    return mentions.groupBy("name").agg(F.array_sort(F.collect_set("type")).alias("types"))


def top_in_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def sign_bands(within: int, bands: int) -> list[tuple[int, int, list[int]]]:
    """(lowest bit, width, changes) of each of so many bands of 64 bits. changes are masks of few bits: the bits that all bands may change
    come to within - bands + 1, so of two values that differ in at most within bits one band differs by no more than its own."""
    cut = lambda n: [n // bands + (k < n % bands) for k in range(bands)]
    widths, few = cut(64), cut(within - bands + 1)
    masks = lambda n, r: [sum(1 << i for i in c) for k in range(r + 1) for c in itertools.combinations(range(n), k)]
    return [(sum(widths[:k]), widths[k], masks(widths[k], few[k])) for k in range(bands)]


def _sign_cost(within: int, bands: int, n: int) -> float:
    """What a value costs among n, in comparisons: each look-up counts as 50, each candidate of even values as one."""
    widths, few = [64 // bands + (k < 64 % bands) for k in range(bands)], [(within - bands + 1) // bands + (k < (within - bands + 1) % bands) for k in range(bands)]
    asked = [sum(math.comb(w, k) for k in range(r + 1)) for w, r in zip(widths, few, strict=True)]
    return sum(25 * a + n * a / 2 ** (w + 1) for a, w in zip(asked, widths, strict=True))


def sign_pairs(signs: DataFrame, within: int = 12, bands: int | None = None, block: int = 1000, work: int = 10**8) -> DataFrame:
    """(a, b, distance): all pairs a < b of (vec_id, signs long) whose 64 bits differ in at most within places.

    One side's bands are looked up as they are, the other's with the few changes of sign_bands, and every candidate is compared in full.
    A pair is asked for by its greater band alone and counted in the first band that finds it. There are the fewer bands the more values
    there are. Look-ups are dealt over tasks of some work comparisons, those of a frequent band over several. Equal signs meet once, then
    stand for all their ids, in blocks of some block of them.
    """
    one = written(signs.groupBy("signs").agg(F.count("*").alias("size")))
    n, cores = one.count(), signs.sparkSession.sparkContext.defaultParallelism
    bands = bands or min(range(min(4, within + 1), within + 2), key=lambda k: _sign_cost(within, k, n))
    parts = max(cores, math.ceil(n * _sign_cost(within, bands, n) / work))
    cut = sign_bands(within, bands)
    band = lambda c, lo, w: F.shiftrightunsigned(c, lo).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1))
    held = one.select(F.col("signs").alias("q"), F.explode(F.array(*[F.struct(F.lit(k).alias("band"), band("signs", lo, w).alias("value")) for k, (lo, w, _) in enumerate(cut)])).alias("k")).select("k.*", "q")
    changes = F.broadcast(signs.sparkSession.createDataFrame([(k, x) for k, (*_, m) in enumerate(cut) for x in m], "band int, x long"))
    asked = held.repartition(cores).join(changes, "band").withColumn("at", F.col("value").bitwiseXOR(F.col("x")))
    asked = asked.where("at <= value").select("band", F.col("at").alias("value"), (F.col("x") != 0).alias("changed"), F.col("q").alias("p"))

    key = ["band", "value"]
    times = held.groupBy(key).agg(F.count("*").alias("h")).join(asked.groupBy(key).agg(F.count("*").alias("m")), key)
    often = F.broadcast(written(times.select(*key, F.ceil(F.col("h") * F.col("m") / work).cast("int").alias("deals")).where("deals > 1")))
    deals = F.coalesce("deals", F.lit(1))
    asked = asked.join(often, key, "left").select(*key, F.pmod(F.xxhash64("p"), deals).cast("int").alias("deal"), "changed", "p")
    held = held.join(often, key, "left").select(*key, F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), "q")
    key = [*key, "deal"]
    apart = F.col("p").bitwiseXOR(F.col("q"))
    # bands that differ by no more than their own number of bits would have found the pair
    found = [F.bit_count(band(apart, lo, w)) <= max(x.bit_count() for x in m) for lo, w, m in cut]
    first = F.lit(0)
    for k in reversed(range(bands)):
        first = F.when(found[k], k).otherwise(first)
    near = asked.repartition(parts, *key).hint("merge").join(held.repartition(parts, *key), key).where((F.col("changed") | (F.col("p") < F.col("q"))) & (F.bit_count(apart) <= within))
    near = near.where(F.col("band") == first).select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), F.bit_count(apart).alias("distance"))
    near = near.unionByName(one.where("size > 1").select(F.col("signs").alias("p"), F.col("signs").alias("q"), F.lit(0).alias("distance")))

    blocks = F.ceil(F.col("size") / block).cast("int")
    size = lambda c, x: one.select(F.col("signs").alias(c), F.col("size").alias(x), blocks.alias(f"{x}_blocks"))
    near = written(near.join(size("p", "np"), "p").join(size("q", "nq"), "q"))
    parts = max(cores, -(-(near.agg(F.sum(F.col("np") * F.col("nq"))).first()[0] or 0) // (work // 10)))
    tiles = near.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("np_blocks") - 1))).withColumn("j", F.explode(F.sequence(F.when(F.col("p") == F.col("q"), F.col("i")).otherwise(0), F.col("nq_blocks") - 1)))
    ids = signs.join(one, "signs").groupBy("signs", F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("at")).agg(F.collect_list("vec_id").alias("ids"))
    of = lambda c, at, x: ids.select(F.col("signs").alias(c), F.col("at").alias(at), F.col("ids").alias(x))
    met = tiles.join(of("p", "i", "ip"), ["p", "i"]).join(of("q", "j", "iq"), ["q", "j"]).repartition(parts, "p", "q", "i", "j")
    met = met.withColumn("a", F.explode("ip")).withColumn("b", F.explode("iq")).where("a <> b and (p < q or i < j or a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
