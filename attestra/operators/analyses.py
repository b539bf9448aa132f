"""Standing questions to a view: one node, what it hangs on, and by whom that is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.graph import reach, shortest_paths, written
from attestra.operators.query import incident


def node_card(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """One row: the node's own columns, with how many edges leave and enter it; none if there is no such node."""
    of = incident(edges).where(F.col("node") == node)
    n = lambda way: F.count(F.when(F.col("direction") == way, 1))
    met = nodes.where(F.col("id") == node).join(of.groupBy(F.col("node").alias("id")).agg(n("out").alias("n_out"), n("in").alias("n_in")), "id", "left")
    return met.fillna(0, ["n_out", "n_in"])


def assertable(status: Column, band: tuple[str, ...]) -> Column:
    """Whether an answer may rest on an element of this status. An empty band lets nothing pass."""
    return F.coalesce(status.isin(*band), F.lit(False)) if band else F.lit(False)


def band_place(status: Column, band: tuple[str, ...]) -> Column:
    """The status's place in the band, from 0; what isn't in it comes after all that is."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in band]), status), F.lit(0)) if band else F.lit(0)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(band)))


def best_links(links: DataFrame, band: tuple[str, ...]) -> DataFrame:
    """Of each part's supplier links (part, supplier, id, status, confidence) the best: by band, confidence, then supplier.

    weighed counts the others whose status is below the band: they were looked at and not carried.
    """
    order = F.struct(band_place(F.col("status"), band).alias("place"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), "supplier", "id", "status")
    below = F.count(F.when(~assertable(F.col("status"), band), 1))
    g = links.groupBy("part").agg(F.min(order).alias("b"), below.alias("below"))
    carried = F.col("b.place") < len(band)
    return g.select("part", F.when(carried, F.col("b.supplier")).alias("supplier"), F.when(carried, F.col("b.id")).alias("id"), F.when(carried, F.col("b.status")).alias("status"), F.col("below").alias("weighed"))


def best_variant(variants: DataFrame) -> DataFrame:
    """(subject, variant): of each subject's variants (subject, variant, confidence) the surest; ties go to the smaller id."""
    return variants.groupBy("subject").agg(F.min(F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), "variant")).alias("b")).select("subject", F.col("b.variant").alias("variant"))


def near(edges: DataFrame, anchor: str, hops: int = 4) -> DataFrame:
    """(node) within hops, 4 at most, of anchor."""
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return reach(e, edges.sparkSession.createDataFrame([(anchor,)], "node string"), min(hops, 4)).select("node")


def chokepoint_pool(chokes: DataFrame, evidence: DataFrame, scope: DataFrame) -> DataFrame:
    """(node, chokepoint, place) of nominated chokepoints in scope: by confidence, then how much text is cited, then id.

    evidence: (node, confidence, cited), cited the length of all cited spans. Places are counted inside a confidence, on top of the
    counts of those above it.
    """
    met = chokes.where("chokepoint <> 'none'").join(scope.select("node").distinct(), "node", "left_semi").join(evidence, "node", "left")
    met = met.select("node", "chokepoint", F.coalesce("confidence", F.lit(0.0)).alias("_c"), F.coalesce("cited", F.lit(0)).alias("_s"))
    above = Window.orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each confidence
    before = met.groupBy("_c").agg(F.count("*").alias("n")).select("_c", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_c").orderBy(F.desc("_s"), "node"))
    return met.withColumn("_own", own).join(before, "_c").select("node", "chokepoint", (F.col("_before") + F.col("_own")).alias("place"))


def sole_source_split(chokes: DataFrame, states: DataFrame, scope: DataFrame) -> DataFrame:
    """(node, verdict) in scope: confirmed where a sole source is known, candidate where a nominated chokepoint's alternates are unknown.

    One row of nulls with the verdict insufficient where there is neither.
    """
    met = chokes.join(states, "node").join(scope.select("node").distinct(), "node", "left_semi")
    verdict = F.when(F.col("state") == "sole", "confirmed").when((F.col("chokepoint") == "candidate") & (F.col("state") == "unknown"), "candidate")
    got = met.select("node", verdict.alias("verdict")).where("verdict is not null")
    none = got.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("node"), F.lit("insufficient").alias("verdict"))
    return got.unionByName(none)


def variant_makers(variants: DataFrame, pool: DataFrame, links: DataFrame, band: tuple[str, ...]) -> DataFrame:
    """(variant, component, maker, maker_of, link, status, weighed) of variants (variant).

    component: the first of the variant's nominated chokepoints in pool (variant, component, place), ties by id. maker: who supplies it by
    links (part, supplier, id, status, confidence), if the best such link is in the band; else the maker of the variant itself, on the same terms.
    maker_of says which part the maker was found for. weighed counts the links that were looked at on the way and are below the band.
    """
    first = pool.groupBy("variant").agg(F.min(F.struct("place", "component")).alias("_p")).select("variant", F.col("_p.component").alias("component"))
    best = best_links(links, band)
    of = lambda key, p: best.select(F.col("part").alias(key), F.struct("supplier", "id", "status", "weighed").alias(p))
    met = variants.select("variant").distinct().join(first, "variant", "left").join(of("component", "_c"), "component", "left").join(of("variant", "_v"), "variant", "left")
    near = F.col("_c.supplier").isNotNull()
    won = F.when(near, F.col("_c")).when(F.col("_v.supplier").isNotNull(), F.col("_v"))
    weighed = F.coalesce("_c.weighed", F.lit(0)) + F.when(near, 0).otherwise(F.coalesce("_v.weighed", F.lit(0)))
    return met.select("variant", "component", won["supplier"].alias("maker"), F.when(near, F.col("component")).when(won.isNotNull(), F.col("variant")).alias("maker_of"), won["id"].alias("link"), won["status"].alias("status"), weighed.alias("weighed"))


def weighed_links(makers: DataFrame, links: DataFrame, band: tuple[str, ...]) -> DataFrame:
    """(variant, part, supplier, id, status): what variant_makers weighed and did not carry, as it is below the band.

    The links of a variant itself were looked at only where its component has no maker.
    """
    below = links.where(~assertable(F.col("status"), band)).select("part", "supplier", "id", "status")
    seen = makers.select("variant", F.col("component").alias("part")).unionByName(makers.where("component is null or maker_of is null or maker_of <> component").select("variant", F.col("variant").alias("part")))
    return seen.where("part is not null").join(below, "part").select("variant", "part", "supplier", "id", "status")


def supply_chains(subjects: DataFrame, variants: DataFrame, pool: DataFrame, links: DataFrame, edges: DataFrame, band: tuple[str, ...], unmet: DataFrame, observed: tuple[str, ...] = ("basing_site", "unit"), hops: int = 4) -> DataFrame:
    """One row for each of subjects (id, type): the chain from where it is seen back to who makes what it depends on, or why there is none.

    variants (subject, variant, confidence): the surest is the subject's, its own if it is one. A subject of an observed type is where the
    chain starts, of any other its variant. The chain ends with the maker of variant_makers, without one with the component, and is
    the first shortest path along edges (id, type, a, b), at most hops long. Null ends meet nothing.

    verdict: traced (path_nodes, path_edges); partial, where the start isn't connected but the variant is, with that part of the chain;
    refused, without any. missing names what is lacking unless traced: the variant, both maker and component, else the open slots
    of unmet (component, slot), else the path and, without a maker, the link to one.
    """
    mine = best_variant(variants).withColumnRenamed("subject", "id")
    of = subjects.select("id", "type").join(mine, "id", "left").withColumn("variant", F.when(F.col("type") == "variant", F.col("id")).otherwise(F.col("variant")))
    makers = written(variant_makers(of.where("variant is not null"), pool, links, band))
    of = of.join(makers, "variant", "left").withColumn("start", F.when(F.col("type").isin(*observed), F.col("id")).otherwise(F.col("variant"))).withColumn("end", F.coalesce("maker", "component"))
    of = written(of)
    steps = written(edges.select("id", "type", "a", "b"))

    # one walk for both, as most variants are a start themselves
    open_ = of.where("maker is not null and start <> variant")
    ends = of.select("start", "end").unionByName(open_.select(F.col("variant").alias("start"), "end")).distinct()
    paths = shortest_paths(steps, ends.select(F.col("start").alias("src"), F.col("end").alias("dst")), hops).select(F.col("src").alias("start"), F.col("dst").alias("end"), F.struct("nodes", "edges").alias("_path"))
    full = of.join(paths, ["start", "end"], "left").join(paths.select(F.col("start").alias("variant"), "end", F.col("_path").alias("_part")), ["variant", "end"], "left")
    slots = unmet.groupBy("component").agg(F.array_sort(F.collect_set("slot")).alias("_slots"))
    full = full.join(slots, "component", "left")
    path = F.col("_path").isNotNull()
    part = ~path & F.col("maker").isNotNull() & (F.col("start") != F.col("variant")) & F.col("_part").isNotNull()
    gap = lambda *c: F.concat(*[F.lit(x) if x.endswith(":") or x == "->" else F.col(x) for x in c])
    missing = (
        F.when(F.col("variant").isNull(), F.array(F.lit("variant"))).when(F.col("end").isNull(), F.array(F.lit("maker_or_component"))).when(path, F.array().cast("array<string>"))
        .when(F.col("_slots").isNotNull(), F.col("_slots")).when(F.col("maker").isNotNull(), F.array(gap("path:", "start", "->", "maker")))
        .otherwise(F.array(gap("maker:", "component"), gap("path:", "start", "->", "component")))
    )
    chain = F.when(path, F.col("_path")).when(part, F.col("_part"))
    verdict = F.when(path, "traced").when(part, "partial").otherwise("refused")
    return full.select("id", "variant", "component", "maker", "maker_of", "status", "weighed", "start", "end", verdict.alias("verdict"), chain["nodes"].alias("path_nodes"), chain["edges"].alias("path_edges"), missing.alias("missing"))
