"""What a surface form stands for: mentions linked to entities, anchors resolved by tiers, names found by likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.fuzzy import weighted_ratio
from attestra.functions.text import bm25, normalise_name, query_form, squash
from attestra.operators.clustering import both_ways
from attestra.operators.graph import written


def with_class(rows: DataFrame, column: str, classes: DataFrame | None) -> DataFrame:
    """rows with key: the alias class of a column's normalised name, else that name; null for a name without letters. classes: (name, root)."""
    named = rows.withColumn("_name", F.nullif(normalise_name(F.col(column)), F.lit("")))
    if classes is None:
        return named.withColumnRenamed("_name", "key")
    of = classes.select(F.col("name").alias("_name"), F.concat(F.lit("class:"), "root").alias("_root"))
    return named.join(of, "_name", "left").withColumn("key", F.coalesce("_root", "_name")).drop("_name", "_root")


def endpoint_types(edges: DataFrame, lanes: DataFrame) -> DataFrame:
    """(form, implied, allowed) of the ends of edges (predicate, subject, object).

    lanes: (predicate, from_types, to_types), arrays, null or empty where an end may be anything. implied: the types that some end alone
    declares; allowed: those that all of a form's declared ends admit, null where none declares any.
    """
    met = edges.join(lanes, "predicate")
    ends = met.select(F.col("subject").alias("form"), F.col("from_types").alias("types")).unionByName(met.select(F.col("object").alias("form"), F.col("to_types").alias("types")))
    # a form's many edges have few different declarations
    said = ends.where(F.size("types") > 0).select("form", F.array_sort(F.array_distinct("types")).alias("types")).distinct()
    n = said.groupBy("form").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("types") == 1, F.col("types")))))).alias("implied"))
    each = said.select("form", F.explode("types").alias("type")).groupBy("form", "type").agg(F.count("*").alias("k"))
    admitted = each.join(n.select("form", "n"), "form").where("k = n").groupBy("form").agg(F.array_sort(F.collect_list("type")).alias("allowed"))
    return n.join(admitted, "form", "left").select("form", "implied", F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"))


def link_mentions(forms: DataFrame, entities: DataFrame, vetoes: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(form, verdict, target, type, reason) of each distinct form (form, implied, allowed).

    entities: (id, type, name, registered); vetoes: (a, b) of ids; classes: (name, root). A form that is an id is known. Else it may be any
    entity of its alias class or name:

    * refused (veto-straddle) where two of those must never be one, since to pick one would merge them;
    * of one type, or of none and with one implied type, it is attached to the entity ent:type:form, or mints it;
    * of several types it is attached only where what is allowed leaves one of them, to the one registered entity of that type, else to
      ent:type:form if there is one; else refused (types-contradict), and nothing is minted;
    * refused (untyped) where nothing says what it is.

    What a form may be is worked out once for each class, so no pair of a form and an entity is made.
    """
    e = with_class(entities, "name", classes)
    per_type = e.where("key is not null").groupBy("key", "type").agg(F.count_if("registered").alias("n"), F.min(F.when(F.col("registered"), F.col("id"))).alias("id"))
    known = per_type.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("type", "n", "id"))).alias("by_type"))
    keys = lambda end: e.select(F.col("id").alias(end), F.col("key").alias(f"key_{end}"))
    straddled = vetoes.join(keys("a"), "a").join(keys("b"), "b").where("key_a = key_b and a <> b").select(F.col("key_a").alias("key")).distinct().withColumn("straddled", F.lit(True))
    f = with_class(forms, "form", classes).join(known, "key", "left").join(straddled, "key", "left")
    ids = entities.select(F.col("id").alias("form")).distinct().withColumn("is_id", F.lit(True))
    f = f.join(ids, "form", "left")
    types = F.transform(F.coalesce("by_type", F.array().cast("array<struct<type:string,n:bigint,id:string>>")), lambda x: x["type"])
    f = f.withColumn("types", types).withColumn("left", F.array_intersect("types", F.coalesce("allowed", F.array().cast("array<string>"))))
    one = F.when(F.size("types") == 1, F.col("types")[0]).when((F.size("types") == 0) & (F.size("implied") == 1), F.col("implied")[0]).when((F.size("types") > 1) & (F.size("left") == 1), F.col("left")[0])
    f = f.withColumn("type", one).withColumn("minted", F.concat(F.lit("ent:"), "type", F.lit(":"), "form"))
    f = f.withColumn("own", F.try_element_at(F.filter("by_type", lambda x: (x["type"] == F.col("type")) & (x["n"] == 1)), F.lit(1)).getField("id"))
    there = entities.select(F.col("id").alias("minted")).distinct().withColumn("there", F.lit(True))
    f = f.join(there, "minted", "left")
    several = F.size("types") > 1
    verdict = (
        F.when(F.col("is_id"), "known")
        .when(F.col("straddled"), "refused")
        .when(F.col("type").isNull(), "refused")
        .when(several, F.when(F.col("own").isNotNull() | F.col("there"), "attached").otherwise("refused"))
        .when(F.col("there"), "attached")
        .otherwise("minted")
    )
    f = f.withColumn("verdict", verdict)
    target = F.when(F.col("verdict") == "known", F.col("form")).when(F.col("verdict") == "attached", F.when(several, F.coalesce("own", "minted")).otherwise(F.col("minted"))).when(F.col("verdict") == "minted", F.col("minted"))
    reason = F.when(F.col("verdict") == "refused", F.when(F.col("straddled"), "veto-straddle").when(several, "types-contradict").otherwise("untyped"))
    return f.select("form", "verdict", target.alias("target"), F.when(F.col("verdict").isin("attached", "minted"), F.col("type")).alias("type"), reason.alias("reason"))


def straddles(entities: DataFrame, vetoes: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(a, b) of vetoes whose ends share a name or alias class: what to ask an analyst about a refused form."""
    e = with_class(entities, "name", classes)
    end = lambda c: e.select(F.col("id").alias(c), F.col("key").alias(f"key_{c}"))
    return vetoes.join(end("a"), "a").join(end("b"), "b").where("key_a = key_b and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def resolve_anchors(anchors: DataFrame, nodes: DataFrame, registry: DataFrame, classes: DataFrame) -> DataFrame:
    """(anchor, node, via) of anchors (anchor): literal if it is a node's id, else registry-alias, else alias-class, else both null.

    nodes: (id, type, forms array, ord), of several that fit the first by ord is taken; registry: (entity_id, type, forms array), whose
    entry's name or alias a node of its type must bear; classes: (name, root). Each tier is one equi-join, and a later one
    only meets the anchors that the earlier ones left. Anchors meet the first node of a form or class, never all that bear it.
    """
    anchors = anchors.select("anchor").distinct()
    literal = anchors.join(nodes.select(F.col("id").alias("anchor")).distinct(), "anchor", "left_semi").select("anchor", F.col("anchor").alias("node"), F.lit("literal").alias("via"))
    left = anchors.join(literal.select("anchor"), "anchor", "left_anti")
    form = lambda df, *keep: df.select(*keep, F.explode("forms").alias("_f")).withColumn("form", F.nullif(normalise_name(F.col("_f")), F.lit(""))).where("form is not null").drop("_f").distinct()
    borne = form(nodes, "id", "type", "ord")
    first = F.min(F.struct("ord", "id")).alias("first")
    least = lambda met: met.groupBy("anchor").agg(F.min("first").alias("first")).select("anchor", F.col("first.id").alias("node"))
    wanted = form(registry.withColumnRenamed("entity_id", "anchor"), "anchor", "type")
    by_registry = least(left.join(wanted, "anchor").join(borne.groupBy("type", "form").agg(first), ["type", "form"])).withColumn("via", F.lit("registry-alias"))
    rest = left.join(by_registry.select("anchor"), "anchor", "left_anti")
    by_class = least(with_class(rest, "anchor", classes).join(with_class(borne, "form", classes).groupBy("key").agg(first), "key")).withColumn("via", F.lit("alias-class"))
    found = literal.unionByName(by_registry).unionByName(by_class)
    return anchors.join(found, "anchor", "left")


def find_entity(surfaces: DataFrame, text: str, type_hint: str | None = None, vetoes: DataFrame | None = None, cutoff: float = 60.0, top: int = 3) -> DataFrame:
    """(place, id, score, surface, tier, resolution, resolved): the ranked candidates for a name; none where nothing is like it.

    surfaces: (id, type, surface, kind), the names (kind name) and other forms of nodes. exact: a node's name is the text; squashed: any
    surface is, but for punctuation; suggested: up to top nodes of cutoff or more by 0.85 of the best weighted ratio and 0.15 of the
    best BM25, as a share of the highest, of 100. The first tier that has any is taken. resolution is ambiguous for several exact or squashed
    candidates, else exact or near; resolved only for a single one of those that need not be told apart from another candidate by a veto
    (a, b): what is like a name is suggested and never taken for it.
    """
    s = surfaces if type_hint is None else surfaces.where(F.col("type") == type_hint)
    s = s.withColumns({"_norm": query_form(F.col("surface")), "_sq": squash(F.col("surface"))})
    want = s.sparkSession.range(1).select(query_form(F.lit(text)).alias("q"), squash(F.lit(text)).alias("s")).first()
    hit = F.when((F.col("kind") == "name") & (F.col("_norm") == want.q), 0).when((F.col("_sq") == want.s) & (F.col("_sq") != ""), 1)
    near = s.withColumn("_tier", hit).where("_tier is not null")
    first = near.agg(F.min("_tier").alias("t")).first().t
    if first is not None:
        out = near.where(F.col("_tier") == first).groupBy("id").agg(F.min("surface").alias("surface"))
        out = out.select("id", F.lit(100.0 - 5.0 * first).alias("score"), "surface", F.lit("squashed" if first else "exact").alias("tier"))
    else:
        out = _alike(s, want.q, cutoff, top)
    n = Window.partitionBy()  # of candidates, which are few
    out = written(out).withColumns({"place": F.row_number().over(n.orderBy(F.desc("score"), "id")), "_n": F.count("*").over(n)})
    barred = F.lit(False)
    if vetoes is not None:
        ids = out.select("id")
        inside = both_ways(vetoes).join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
        out = out.join(inside.select(F.col("a").alias("id")).distinct().withColumn("_barred", F.lit(True)), "id", "left")
        barred = F.coalesce("_barred", F.lit(False))
    sure = F.col("tier") != "suggested"
    resolution = F.when(sure & (F.col("_n") > 1), "ambiguous").when(F.col("tier") == "exact", "exact").otherwise("near")
    return out.select("place", "id", "score", "surface", "tier", resolution.alias("resolution"), (sure & (F.col("_n") == 1) & ~barred).alias("resolved"))


def _alike(s: DataFrame, wanted: str, cutoff: float, top: int) -> DataFrame:
    """Each distinct surface is compared once."""
    each = written(s.where("_norm <> ''").groupBy("_norm").agg(F.count("*").alias("n")))
    words = bm25(each.select(F.col("_norm").alias("id"), F.split("_norm", " ").alias("tokens")), wanted.split(" ")).select(F.col("id").alias("_norm"), F.col("score").alias("_bm"))
    scored = written(each.withColumn("_ratio", weighted_ratio(F.col("_norm"), F.lit(wanted))).join(words, "_norm", "left"))
    node = s.join(scored, "_norm").groupBy("id").agg(F.max("_ratio").alias("_r"), F.max("_bm").alias("_b"), F.min_by("surface", F.struct(-F.col("_ratio"), "surface")).alias("surface"))
    most = scored.agg(F.max("_bm").alias("m")).first().m
    score = F.round(0.85 * F.col("_r") + (F.coalesce("_b", F.lit(0.0)) * (15.0 / most) if most else F.lit(0.0)), 6)
    return node.select("id", score.alias("score"), "surface", F.lit("suggested").alias("tier")).where(F.col("score") >= cutoff).orderBy(F.desc("score"), "id").limit(top)
