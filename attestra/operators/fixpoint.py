"""Collective resolution: merges on evidence of identity first, then rounds in which merges change what the next are scored by.

The neighbourhood of an entity is what its edges lead to, named by what that was merged into. So a merge can bring two others closer. A
round scores the pairs whose neighbourhoods the round before touched, and no others, takes those above their floor from the best down,
without joining what is vetoed apart, and ends the rounds when it takes none. Scores of one round rest on the partition before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.config import DEFAULT, Settings
from attestra.functions.geo import haversine_km
from attestra.functions.text import acronym, contains_name, name_similarity, tokens
from attestra.operators.clustering import both_ways, clusters, relabelled
from attestra.operators.graph import kept


@dataclass
class Resolution:
    """merged: (raw, cluster) of entities that aren't alone; pairs: candidates as the last round scored them, with shared, either, score,
    total, together (in one cluster), vetoed and band; rounds: of each round how many pairs were scored and how many entities merged."""

    merged: DataFrame
    pairs: DataFrame
    rounds: list[tuple[int, int]]


def bootstrap_evidence(a: str, b: str, least_added: int = 3, least_tokens: int = 1, least_initials: int = 2) -> Column:
    """Whether two entities, the struct columns a and b (type, ns, name, alias, unique), are one by a direct statement of identity: a
    shared unique identifier, one alias class, the same name in the same namespace, or one name that extends the other or has it as its
    initials. Types have to agree, and namespaces not to differ, but for an identifier or an alias."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    ns = x("ns").isNull() | y("ns").isNull() | (x("ns") == y("ns"))

    def extends(s: Column, t: Column) -> Column:
        initials = (F.size(tokens(s)) == 1) & (F.size(tokens(t)) >= least_initials) & (s == acronym(t))
        return contains_name(s, t, least_tokens, least_added) | initials

    named = (F.length(x("name")) > 0) & (x("name") == y("name")) & x("ns").eqNullSafe(y("ns"))
    open_name = (x("type") == y("type")) & ns & (extends(x("name"), y("name")) | extends(y("name"), x("name")))
    tests = [(x("type") == y("type")) & (x("unique") == y("unique")), x("alias") == y("alias"), named, open_name]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def geo_vetoes(pairs: DataFrame, placed: DataFrame, tolerance_km: dict[str, float]) -> DataFrame:
    """Of pairs (a, b) those whose stated positions lie further apart than the stricter tolerance of their two types. A type without a
    tolerance sets none. placed: (id, type, lat, lon)."""
    km = F.create_map(*[F.lit(v) for kv in tolerance_km.items() for v in kv]) if tolerance_km else F.create_map().cast("map<string,double>")
    p = placed.where("lat is not null and lon is not null").select("id", F.try_element_at(km, F.col("type")).alias("km"), "lat", "lon")
    end = lambda e: p.select(F.col("id").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("km", "lat", "lon")])
    met = pairs.select("a", "b").join(end("a"), "a").join(end("b"), "b")
    apart = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return met.where(apart > F.least("km_a", "km_b")).select("a", "b")


def _neighbours(edges: DataFrame) -> DataFrame:
    """(id, step, other, instance) of edges (predicate, subject, object, instance), at both ends."""
    out = edges.select(F.col("subject").alias("id"), F.concat("predicate", F.lit(">out>")).alias("step"), F.col("object").alias("other"), "instance")
    return out.unionByName(edges.select(F.col("object").alias("id"), F.concat("predicate", F.lit(">in>")).alias("step"), F.col("subject").alias("other"), "instance")).distinct()


def co_instances(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, instance) where both are the same end of edges of one instance: where something was, and where it is."""
    end = lambda c: edges.where("instance is not null").select("instance", F.col(c).alias("id"), F.lit(c).alias("end"))
    ends = end("subject").unionByName(end("object")).distinct()
    return pairs.select("a", "b").join(ends.withColumnRenamed("id", "a"), "a").join(ends.withColumnRenamed("id", "b"), ["b", "instance", "end"]).select("a", "b", "instance").distinct()


def overlap(pairs: DataFrame, neighbours: DataFrame, moved: DataFrame, relocated: DataFrame) -> DataFrame:
    """pairs (a, b) with shared and either, the sizes of both and of any of their neighbourhoods, named by moved (raw, cluster), but for
    edges of instances in which the two were the same end."""

    def of(side: str) -> DataFrame:
        met = pairs.select("a", "b").join(neighbours.withColumnRenamed("id", side), side)
        return met.join(relocated, ["a", "b", "instance"], "left_anti").select("a", "b", "step", "other", F.lit(side).alias("side"))

    to = moved.select(F.col("raw").alias("other"), F.col("cluster").alias("_to"))
    sides = of("a").unionByName(of("b")).join(to, "other", "left").withColumn("other", F.coalesce("_to", "other"))
    each = sides.groupBy("a", "b", "step", "other").agg(F.count_distinct("side").alias("n"))
    met = each.groupBy("a", "b").agg(F.count_if(F.col("n") == 2).alias("shared"), F.count("*").alias("either"))
    zero = F.lit(0).cast("long")
    return pairs.join(met, ["a", "b"], "left").withColumns({"shared": F.coalesce("shared", zero), "either": F.coalesce("either", zero)})


def touched(pairs: DataFrame, neighbours: DataFrame, moved: DataFrame) -> DataFrame:
    """Those of pairs an end of which has a neighbour among moved (node)."""
    ids = neighbours.join(moved.select(F.col("node").alias("other")), "other", "left_semi").select("id").distinct()
    hit = [pairs.join(ids.select(F.col("id").alias(end)), end, "left_semi") for end in ("a", "b")]
    return hit[0].unionByName(hit[1]).select("a", "b").distinct()


def resolve(pairs: DataFrame, edges: DataFrame, vetoes: DataFrame, settings: Settings = DEFAULT, support: int = 2) -> Resolution:
    """Merges over candidate pairs until a round takes none.

    pairs: (a, b, attribute, asserted, raised, boot, floor, counts, same_type), a < b, one row each: how alike their attributes are, 0 to
    1; how strongly sources assert that they are one, which lifts a pair to review alone; whether somebody raised them for review;
    whether they are one by evidence (bootstrap_evidence), in order of (a, b); the score from which they merge; whether their
    types let neighbours count; whether their types agree. edges: (predicate, subject, object, instance). vetoes: (a, b), any order.

    score = weights of attribute, of the overlap of neighbourhoods times min(1, shared / support), and of time, which is 0 for a pair
    that was ever two ends of one instance and 1 otherwise. total adds what is asserted. Of what stays apart, band is review from
    merge_review on or if raised, of different types only if raised, else none.
    """
    w = settings.merge_weights
    neighbours = kept(_neighbours(edges))
    pairs = kept(pairs)
    relocated = kept(co_instances(edges, pairs))
    barred = kept(both_ways(vetoes))
    moving = relocated.select("a", "b").distinct().withColumn("_reloc", F.lit(True))
    known = pairs.join(barred.withColumn("vetoed", F.lit(True)), ["a", "b"], "left").join(moving, ["a", "b"], "left")
    temporal = F.when(F.col("_reloc"), 0.0).otherwise(1.0)
    known = known.withColumns({"vetoed": F.coalesce("vetoed", F.lit(False)), "fixed": w["attribute"] * F.col("attribute") + w["temporal"] * temporal}).drop("_reloc")
    known = kept(known)
    merged = kept(clusters(known.where("boot and not vetoed").select("a", "b", F.lit(1.0).alias("score")), barred).where("raw <> cluster"))
    scored = todo = None
    rounds: list[tuple[int, int]] = [(0, merged.count())]
    while True:
        todo = known.select("a", "b") if scored is None else todo
        fresh = overlap(todo, neighbours, merged, relocated)
        scored = kept(fresh if scored is None else scored.join(todo, ["a", "b"], "left_anti").unionByName(fresh))
        both = known.join(scored, ["a", "b"])
        near = F.when(F.col("counts") & (F.col("either") > 0), F.col("shared") / F.col("either") * F.least(F.lit(1.0), F.col("shared") / support)).otherwise(0.0)
        both = both.withColumn("score", F.round(F.col("fixed") + w["relational"] * near, 9))
        at = relabelled(both.withColumns({"raw_a": F.col("a"), "raw_b": F.col("b")}), merged.select(F.col("raw").alias("node"), F.col("cluster").alias("root")))
        auto = at.where("not vetoed and score >= floor and a <> b")
        auto = kept(auto.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score")))
        moved = None
        if not auto.isEmpty():
            apart = relabelled(barred, merged.select(F.col("raw").alias("node"), F.col("cluster").alias("root"))).distinct()
            moved = kept(clusters(auto, apart).where("raw <> cluster").select(F.col("raw").alias("node"), F.col("cluster").alias("root")))
        n_moved = moved.count() if moved is not None else 0
        rounds.append((todo.count(), n_moved))
        if not n_moved:
            return Resolution(merged, _judged(at, settings), rounds)
        # what moved, and all that had been merged into it
        again = merged.join(moved.withColumnRenamed("node", "cluster"), "cluster", "left")
        gone = again.where("root is not null").select(F.col("raw").alias("node")).unionByName(moved.select("node"))
        merged = kept(again.select("raw", F.coalesce("root", "cluster").alias("cluster")).unionByName(moved.select(F.col("node").alias("raw"), F.col("root").alias("cluster"))))
        todo = kept(touched(known, neighbours, gone))


def _judged(at: DataFrame, settings: Settings) -> DataFrame:
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("score") + settings.merge_weights.get("asserted", 0.0) * F.col("asserted"), 9)))
    out = at.withColumn("together", F.col("a") == F.col("b")).withColumn("total", total)
    ask = ~F.col("together") & ~F.col("vetoed") & (F.col("same_type") | F.col("raised")) & ((F.col("total") >= settings.merge_review) | F.col("raised"))
    band = F.when(F.col("together"), "merged").when(F.col("vetoed"), "vetoed").when(ask, "review").otherwise("none")
    return out.select(F.col("raw_a").alias("a"), F.col("raw_b").alias("b"), "shared", "either", "score", "total", "together", "vetoed", band.alias("band"))


def scored_names(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """pairs (a, b) with the struct columns _a and _b of entities and attribute, the likeness of their names, each pair of names once."""
    e = entities.withColumn("_s", F.struct(*[c for c in entities.columns if c != "id"])).hint("merge")
    met = pairs.join(e.select(F.col("id").alias("a"), F.col("_s").alias("_a")), "a").join(e.select(F.col("id").alias("b"), F.col("_s").alias("_b")), "b")
    names = met.select(F.col("_a.name").alias("_x"), F.col("_b.name").alias("_y")).distinct().withColumn("attribute", name_similarity(F.col("_x"), F.col("_y")))
    return met.withColumns({"_x": F.col("_a.name"), "_y": F.col("_b.name")}).join(names, ["_x", "_y"]).drop("_x", "_y")
