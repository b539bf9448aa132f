"""From the log to a view: claims become assessed edges and nodes, with what identity resolution decided beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.config import DEFAULT, Settings
from attestra.operators import assessment, supersede
from attestra.operators.graph import placed, written

#: Relations that say who is who. They are used up by resolution and never drawn.
IDENTITY = ("same-as", "coref-same-as")


def drawn(claims: DataFrame) -> DataFrame:
    """claims without those of identity relations."""
    return claims.where(~F.col("predicate").isin(*IDENTITY))


def edge_instance(subject: Column, predicate: Column, obj: Column, functional: tuple[str, ...] = ()) -> Column:
    """What an edge is an instance of: a relation that can hold for one object at a time leaves its object out."""
    return F.concat_ws(":", F.lit("edge"), subject, predicate, F.when(~predicate.isin(*functional), obj) if functional else obj)


def canonical(claims: DataFrame, merges: DataFrame) -> DataFrame:
    """claims whose ends are those that they were merged into. merges: (member, canonical), one row for each member.

    merges should come from a table: by a guess they count as too many to broadcast, and claims then move by their ends, of which few may
    hold most claims.
    """
    out = claims
    for end in ("subject", "object"):
        to = merges.select(F.col("member").alias(end), F.col("canonical").alias(f"_{end}"))
        out = out.join(to, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return out.withColumn("element_id", F.concat_ws(":", F.lit("e"), "subject", "predicate", "object")).select(*claims.columns)


def minted_name(node_id: Column) -> Column:
    """The name inside an id minted as ent:type:name, else the id itself."""
    return F.coalesce(F.nullif(F.when(node_id.startswith("ent:"), F.regexp_extract(node_id, r"(?s)^ent:[^:]*:(.*)$", 1)), F.lit("")), node_id)


def with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, type, name, n_claims), and a node of unknown type for each end of edges that is none of them."""
    ends = edges.select(F.col("source").alias("id"), "n_claims").unionByName(edges.select(F.col("target").alias("id"), "n_claims"))
    missing = ends.groupBy("id").agg(F.sum("n_claims").alias("n_claims")).join(nodes.select("id"), "id", "left_anti")
    return nodes.select("id", "type", "name", "n_claims").unionByName(missing.select("id", F.lit("unknown").alias("type"), minted_name(F.col("id")).alias("name"), "n_claims"))


def merge_provenance(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """nodes with resolved_from: (member, confidence) of what was merged into each, in order. merges: (member, canonical, confidence)."""
    of = merges.groupBy(F.col("canonical").alias("id")).agg(F.array_sort(F.collect_list(F.struct("member", "confidence"))).alias("resolved_from"))
    return nodes.join(of, "id", "left")


def resolution_edges(node_ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of undecided pairs and of vetoes, which no score is given to. pairs: (a, b, type, merge_confidence).

    A pair shows only where both of its ends are nodes (id).
    """
    ids = node_ids.select("id").distinct()
    both = pairs.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    name = F.concat(F.col("type"), F.lit(":"), F.least("a", "b"), F.lit("|"), F.greatest("a", "b"))
    return both.select(name.alias("id"), "type", F.col("a").alias("source"), F.col("b").alias("target"), "merge_confidence").dropDuplicates(["id"])


def assessed_edges(kept: DataFrame, sources: DataFrame, insufficient: Callable[[DataFrame], DataFrame], functional: tuple[str, ...] = (), settings: Settings = DEFAULT, among: DataFrame | None = None) -> DataFrame:
    """(id, instance, type, source, target, n_claims, confidence, status, gates) of the elements of claims with canonical ends, kept by id.

    kept: read by each step by element, so it should be kept that way (graph.placed); then only rows of elements move. insufficient: makes (element_id, insufficient) of claims. Of a functional relation's targets the older is retired where the newest is
    later, is strong enough and isn't denied; targets that can't be ordered contradict each other. among: see assess.
    """
    ends = ["element_id", "subject", "predicate", "object"]
    sources = written(sources)
    drawn_edges = kept.groupBy(*ends).agg(F.countDistinct("claim_id").alias("n_claims")).withColumn("instance", edge_instance(F.col("subject"), F.col("predicate"), F.col("object"), functional))
    state = kept.where(F.col("predicate").isin(*functional)) if functional else kept.limit(0)
    state = state.select(edge_instance(F.col("subject"), F.col("predicate"), F.col("object"), functional).alias("instance"), F.col("element_id").alias("target"), "claim_id", F.col("event_date").alias("lo"), F.col("event_date").alias("hi"))
    nominated = written(supersede.nominate(supersede.target_intervals(state)).drop("claim_ids"))
    contradicted = nominated.where("relation = 'contradiction'").select(F.col("target").alias("element_id"), F.lit(True).alias("contradicted"))
    flagged = kept.select("element_id").distinct().join(insufficient(kept), "element_id", "left").join(contradicted, "element_id", "left")
    first = placed(assessment.assess(kept, sources, settings, flagged, among=among), "element_id")
    met = nominated.select("instance", F.col("target").alias("element_id")).join(first, "element_id")
    retired = supersede.promote(nominated, met.select("instance", F.col("element_id").alias("target"), "confidence", "denied"), settings).where("verdict = 'retired'").select(F.col("target").alias("element_id"), F.lit(True).alias("_gone"))
    flags = F.array_compact(F.array(F.lit("superseded"), F.when(F.col("denied"), F.lit("adversary-denial")), F.when(F.col("decoy_risk"), F.lit("decoy-risk"))))
    scored = first.join(retired, "element_id", "left").select("element_id", "confidence", F.when(F.col("_gone"), "stale").otherwise(F.col("status")).alias("status"), F.when(F.col("_gone"), F.array_join(flags, ",")).otherwise(F.col("gates")).alias("gates"))
    edges = drawn_edges.join(scored, "element_id").select(F.col("element_id").alias("id"), "instance", F.col("predicate").alias("type"), F.col("subject").alias("source"), F.col("object").alias("target"), "n_claims", "confidence", "status", "gates")
    return placed(edges, "id")


def rebuild(claims: DataFrame, sources: DataFrame, entities: DataFrame, merges: DataFrame, pairs: DataFrame, insufficient: Callable[[DataFrame], DataFrame], functional: tuple[str, ...] = (), settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a view.

    claims: what is valid and not retracted; entities: (id, type, name, n_claims); insufficient: see assessed_edges.
    """
    merges = written(merges)  # see canonical
    return composed(placed(canonical(drawn(claims), merges), "element_id"), sources, entities, merges, pairs, insufficient, functional, settings)


def composed(kept: DataFrame, sources: DataFrame, entities: DataFrame, merges: DataFrame, pairs: DataFrame, insufficient: Callable[[DataFrame], DataFrame], functional: tuple[str, ...] = (), settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """rebuild of drawn claims whose ends are canonical already. kept: see assessed_edges."""
    edges = assessed_edges(kept, sources, insufficient, functional, settings)
    nodes = with_ends(entities.join(merges.select(F.col("member").alias("id")), "id", "left_anti"), edges)
    undecided = resolution_edges(nodes, pairs)
    return merge_provenance(nodes, merges), edges.unionByName(undecided, allowMissingColumns=True)


def status_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, before, after, change) of elements (id, status) whose status isn't the same in two views: new, gone or changed."""
    met = before.select("id", F.col("status").alias("before")).join(after.select("id", F.col("status").alias("after")), "id", "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").otherwise("changed")
    return met.where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", change)


def effective_day(claims: DataFrame, pinned: str | None) -> DataFrame:
    """One row (as_of): the pinned day, else the latest on which a claim was available, else null."""
    return claims.agg(F.coalesce(F.lit(pinned).cast("date"), F.max(F.coalesce("report_date", "event_date"))).alias("as_of"))


def best_dated(claims: DataFrame) -> DataFrame:
    """(element_id, claim_id, event_date): of each element the claim with the latest day; undated ones come last, ties go to the larger id."""
    pick = F.max(F.struct(F.col("event_date").isNotNull().alias("dated"), F.col("event_date"), F.col("claim_id"))).alias("p")
    return claims.groupBy("element_id").agg(pick).select("element_id", F.col("p.claim_id").alias("claim_id"), F.col("p.event_date").alias("event_date"))


def inherit_day(claims: DataFrame) -> DataFrame:
    """claims (doc, claim_id, method, event_date) with event_date and inherited: an undated image claim takes the latest day that the
    text of its document states; without one it stays undated."""
    stated = claims.where("method <> 'vlm' and event_date is not null").groupBy("doc").agg(F.max("event_date").alias("_day"))
    met = claims.join(stated, "doc", "left")
    takes = (F.col("method") == "vlm") & F.col("event_date").isNull() & F.col("_day").isNotNull()
    return met.withColumn("inherited", takes).withColumn("event_date", F.when(takes, F.col("_day")).otherwise(F.col("event_date"))).drop("_day")


def area_pins(pins: DataFrame) -> DataFrame:
    """Pins (id, lat, lon, radius) that stand for one area, those of equal place and radius, as one: (id, n, members). A pin without a
    radius is a point and stays alone."""
    key = F.when(F.col("radius").isNull(), F.col("id"))
    g = pins.groupBy("lat", "lon", "radius", key.alias("_own")).agg(F.array_sort(F.collect_list("id")).alias("members"))
    return g.select(F.col("members")[0].alias("id"), "lat", "lon", "radius", F.size("members").alias("n"), "members")
