"""Registered queries of collective resolution, beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.config import DEFAULT as S
from attestra.functions import text
from attestra.operators import fixpoint, linking
from attestra.plans.catalogue import register
from attestra.sources import star

# Parts in fours; the neighbours of a part are its size class and the part that its pair derives from, eight pairs from one. So a merge
# of one pair brings the eight that derive from it closer. Names, made up of two words, are the attribute.
_FLOOR = 0.6
_SQL_ROUNDS = 8


def _word(k: str) -> str:
    return f"'p' || lpad(({k})::VARCHAR, 9, '0')"


_PARENT = "(k // 16) * 2 + k % 2"
_PAIRS = f"""WITH part_ AS (SELECT p_partkey AS k, {_word('p_partkey')} AS id, p_name AS name, p_size AS z FROM part
), near AS (SELECT id, 'derives>' AS step, {_word(_PARENT)} AS other FROM part_ UNION SELECT id, 'sized>', 'z' || (k // 2 % 5) FROM part_ UNION SELECT {_word(_PARENT)}, 'derived-by>', id FROM part_
), cand AS MATERIALIZED (
  SELECT x.k // 4 AS q, x.k % 4 AS i, x.id AS a, y.id AS b, x.k % 50 = 0 AS boot,
    round(0.5 * jaro_winkler_similarity(array_to_string(list_sort(string_split(x.name, ' ')), ' '), array_to_string(list_sort(string_split(y.name, ' ')), ' ')) + 0.2, 12) AS fixed
  FROM part_ x JOIN part_ y ON y.k = x.k + 1 AND x.k % 4 < 3
), bars AS MATERIALIZED (SELECT k // 4 AS q FROM part_ WHERE k % 4 = 0 AND z % 2 = 0 AND k + 3 IN (SELECT k FROM part_))"""


def _walk_sql(n: int, labels: str, wanted: str) -> str:
    """labels{n}: the labels after taking what wanted{n} (q, x, y, s) lists from the best down, but where both ends of a barred four would meet."""
    return f""", queue{n} AS MATERIALIZED (SELECT q, x, y, row_number() OVER (PARTITION BY q ORDER BY s DESC, x, y) AS turn FROM {wanted}
), fours{n} AS (SELECT CAST(substr(id, 2) AS BIGINT) // 4 AS q, list(label ORDER BY id) AS lab, list(id ORDER BY id) AS ids FROM {labels} GROUP BY 1
), walk{n} AS (
  WITH RECURSIVE w(q, turn, lab, ids) AS (
    SELECT q, 0::BIGINT, lab, ids FROM fours{n}
    UNION ALL
    SELECT w.q, u.turn, CASE WHEN u.lx = u.ly OR (u.barred AND least(u.lx, u.ly) = least(lab[1], lab[4]) AND greatest(u.lx, u.ly) = greatest(lab[1], lab[4])) THEN lab
      ELSE list_transform(lab, lambda l: CASE WHEN l = greatest(u.lx, u.ly) THEN least(u.lx, u.ly) ELSE l END) END, ids
    FROM w JOIN LATERAL (SELECT k.turn, lab[list_position(ids, k.x)] AS lx, lab[list_position(ids, k.y)] AS ly, w.q IN (SELECT q FROM bars) AS barred FROM queue{n} k WHERE k.q = w.q AND k.turn = w.turn + 1) u ON true
  ) SELECT q, arg_max(lab, turn) AS lab, arg_max(ids, turn) AS ids FROM w GROUP BY q
), labels{n} AS MATERIALIZED (SELECT unnest(ids) AS id, unnest(lab) AS label FROM walk{n})"""


def _rounds_sql() -> str:
    out = _PAIRS + ", labels AS MATERIALIZED (SELECT id, id AS label FROM part_), wanted0 AS (SELECT q, a AS x, b AS y, 1.0 AS s FROM cand WHERE boot)" + _walk_sql(0, "labels", "wanted0")
    for n in range(1, _SQL_ROUNDS + 1):
        out += f""", named{n} AS MATERIALIZED (SELECT DISTINCT near.id, step, coalesce(label, other) AS other FROM near LEFT JOIN labels{n - 1} l ON l.id = other
), size{n} AS (SELECT id, count(*) AS n FROM named{n} GROUP BY 1
), shared{n} AS (SELECT a, b, count(*) AS n FROM cand JOIN named{n} x ON x.id = a JOIN named{n} y ON y.id = b AND x.step = y.step AND x.other = y.other GROUP BY 1, 2
), scored{n} AS MATERIALIZED (
  SELECT q, a, b, coalesce(s.n, 0) AS shared, i.n + j.n - coalesce(s.n, 0) AS either, round(fixed + 0.3 * coalesce(s.n, 0) / (i.n + j.n - coalesce(s.n, 0)) * least(1.0, coalesce(s.n, 0) / 2), 9) AS score, x.label AS x, y.label AS y
  FROM cand LEFT JOIN shared{n} s USING (a, b) JOIN size{n} i ON i.id = a JOIN size{n} j ON j.id = b JOIN labels{n - 1} x ON x.id = a JOIN labels{n - 1} y ON y.id = b
), wanted{n} AS (SELECT q, least(x, y) AS x, greatest(x, y) AS y, max(score) AS s FROM scored{n} WHERE score >= {_FLOOR} AND x <> y GROUP BY ALL)""" + _walk_sql(n, f"labels{n - 1}", f"wanted{n}")
    return out


def _resolution(spark, d) -> fixpoint.Resolution:
    p, k = star.table(spark, d, "part"), F.col("p_partkey")
    name = lambda c: F.concat(F.lit("p"), F.lpad(c.cast("string"), 9, "0"))
    parent = name(F.floor(k / 16) * 2 + k % 2)
    edges = p.select(F.lit("derives").alias("predicate"), name(k).alias("subject"), parent.alias("object"), F.lit(None).cast("string").alias("instance"))
    edges = edges.unionByName(p.select(F.lit("sized").alias("predicate"), name(k).alias("subject"), F.concat(F.lit("z"), F.floor(k / 2) % 5).alias("object"), F.lit(None).cast("string").alias("instance")))
    entities = p.select(name(k).alias("id"), F.col("p_name").alias("name"))
    pairs = p.where(k % 4 < 3).select(name(k).alias("a"), name(k + 1).alias("b"), (k % 50 == 0).alias("boot"))
    pairs = fixpoint.scored_names(pairs, entities).select("a", "b", "boot", "attribute")
    pairs = pairs.withColumns({"asserted": F.lit(0.0), "raised": F.lit(False), "floor": F.lit(_FLOOR), "counts": F.lit(True), "same_type": F.lit(True)})
    vetoes = p.where((k % 4 == 0) & (F.col("p_size") % 2 == 0)).select(name(k).alias("a"), name(k + 3).alias("b"))
    return fixpoint.resolve(pairs, edges, vetoes)


@register(_rounds_sql() + f" SELECT id AS raw, label AS cluster FROM labels{_SQL_ROUNDS} WHERE id <> label", base=False)
def merge_fixpoint(spark, d):
    return _resolution(spark, d).merged


@register(_rounds_sql() + f" SELECT a, b, shared, either, score, x = y AS together, CASE WHEN x = y THEN 'merged' WHEN score >= {S.merge_review} THEN 'review' ELSE 'none' END AS band FROM scored{_SQL_ROUNDS}", base=False)
def merge_fixpoint_pairs(spark, d):
    return _resolution(spark, d).pairs.select("a", "b", "shared", "either", "score", "together", "band")


# -- mentions

_MENTIONS = """WITH ents AS (
  SELECT CASE WHEN p_partkey % 40 = 0 THEN 'reg' || p_partkey ELSE 'ent:' || lower(p_type) || ':' || p_brand || ' ' || p_name END AS id, lower(p_type) AS type, p_brand || ' ' || p_name AS name, p_partkey % 40 = 0 AS registered FROM part WHERE p_partkey % 3 = 0
), entities AS MATERIALIZED (SELECT DISTINCT id, type, trim(regexp_replace(lower(name), '[^0-9a-z]+', ' ', 'g')) AS norm, registered FROM ents
), classes AS MATERIALIZED (SELECT DISTINCT trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^0-9a-z]+', ' ', 'g')) AS norm, 'class:' || lower(p_brand) AS root FROM part WHERE p_size = 7
), keyed AS (SELECT id, type, registered, coalesce(root, norm) AS key FROM entities LEFT JOIN classes USING (norm)
), vetoes AS (SELECT DISTINCT a.id AS a, b.id AS b FROM keyed a JOIN keyed b ON a.key = b.key AND a.id < b.id AND length(a.id) % 5 = 0 AND length(b.id) % 5 = 1
), straddled AS (SELECT DISTINCT x.key FROM vetoes JOIN keyed x ON x.id = a JOIN keyed y ON y.id = b WHERE x.key = y.key
), lanes(predicate, f, t) AS (VALUES ('A', ['economy', 'small'], ['standard']), ('N', ['economy'], NULL), ('R', ['economy', 'promo', 'small'], ['standard', 'large'])
), facts AS (SELECT DISTINCT l_returnflag AS predicate, p_brand || ' ' || p_name AS subject, CASE WHEN p_partkey % 9 = 4 THEN 'reg' || (p_partkey // 40 * 120) ELSE 'Site ' || p_size END AS object FROM lineitem JOIN part ON p_partkey = l_partkey
), ends AS (SELECT DISTINCT * FROM (SELECT subject AS form, f AS types FROM facts JOIN lanes USING (predicate) UNION ALL SELECT object, t FROM facts JOIN lanes USING (predicate)) WHERE len(types) > 0
), allowed AS (
  SELECT form, list_sort(list_distinct(flatten(list(CASE WHEN len(types) = 1 THEN types ELSE [] END)))) AS implied,
    list_sort(list_filter(list_distinct(flatten(list(types))), lambda t: len(list_filter(list(types), lambda s: list_contains(s, t))) = count(*))) AS allowed FROM ends GROUP BY 1)"""
_LANES = [("A", ["economy", "small"], ["standard"]), ("N", ["economy"], None), ("R", ["economy", "promo", "small"], ["standard", "large"])]


def _mentions(spark, d):
    p, k = star.table(spark, d, "part"), F.col("p_partkey")
    name = F.concat("p_brand", F.lit(" "), "p_name")
    entities = p.where(k % 3 == 0).select(F.when(k % 40 == 0, F.concat(F.lit("reg"), k)).otherwise(F.concat(F.lit("ent:"), F.lower("p_type"), F.lit(":"), name)).alias("id"), F.lower("p_type").alias("type"), name.alias("name"), (k % 40 == 0).alias("registered")).distinct()
    classes = p.where("p_size = 7").select(text.normalise_name(name).alias("name"), F.lower("p_brand").alias("root")).distinct()
    keyed = linking.with_class(entities, "name", classes).select("id", "key")
    n = F.length("id") % 5
    vetoes = keyed.where(n == 0).withColumnRenamed("id", "a").join(keyed.where(n == 1).withColumnRenamed("id", "b"), "key").where("a < b").select("a", "b")
    x = star.table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("predicate")).distinct().join(p, F.col("l_partkey") == k)
    facts = x.select("predicate", name.alias("subject"), F.when(k % 9 == 4, F.concat(F.lit("reg"), F.floor(k / 40) * 120)).otherwise(F.concat(F.lit("Site "), "p_size")).alias("object")).distinct()
    lanes = spark.createDataFrame(_LANES, "predicate string, from_types array<string>, to_types array<string>")
    return facts, lanes, entities, vetoes, classes


@register(_MENTIONS + " SELECT form, array_to_string(implied, ',') AS implied, array_to_string(allowed, ',') AS allowed FROM allowed", base=False)
def mention_types(spark, d):
    facts, lanes, *_ = _mentions(spark, d)
    return linking.endpoint_types(facts, lanes).select("form", F.array_join("implied", ",").alias("implied"), F.array_join("allowed", ",").alias("allowed"))


@register(
    _MENTIONS
    + """, known AS (SELECT key, list_sort(list(DISTINCT type)) AS types FROM keyed GROUP BY 1
), own AS (SELECT key, type, min(id) FILTER (registered) AS reg, count(*) FILTER (registered) AS n FROM keyed GROUP BY 1, 2
), met AS (
  SELECT form, implied, allowed, key, coalesce(types, []) AS types, list_filter(coalesce(types, []), lambda t: list_contains(allowed, t)) AS rest, form IN (SELECT id FROM entities) AS is_id, key IN (SELECT key FROM straddled) AS straddled
  FROM (SELECT a.*, coalesce(c.root, trim(regexp_replace(lower(form), '[^0-9a-z]+', ' ', 'g'))) AS key FROM allowed a LEFT JOIN classes c ON c.norm = trim(regexp_replace(lower(form), '[^0-9a-z]+', ' ', 'g'))) LEFT JOIN known USING (key)
), typed AS (SELECT *, CASE WHEN len(types) = 1 THEN types[1] WHEN len(types) = 0 AND len(implied) = 1 THEN implied[1] WHEN len(types) > 1 AND len(rest) = 1 THEN rest[1] END AS t FROM met
), found AS (SELECT m.*, 'ent:' || t || ':' || form AS eid, CASE WHEN o.n = 1 THEN o.reg END AS reg, ('ent:' || t || ':' || form) IN (SELECT id FROM entities) AS there FROM typed m LEFT JOIN own o ON o.key = m.key AND o.type = m.t
), judged AS (SELECT *, CASE WHEN is_id THEN 'known' WHEN straddled OR t IS NULL THEN 'refused' WHEN len(types) > 1 THEN CASE WHEN reg IS NOT NULL OR there THEN 'attached' ELSE 'refused' END WHEN there THEN 'attached' ELSE 'minted' END AS verdict FROM found)
SELECT form, verdict, CASE verdict WHEN 'known' THEN form WHEN 'attached' THEN CASE WHEN len(types) > 1 THEN coalesce(reg, eid) ELSE eid END WHEN 'minted' THEN eid END AS target, CASE WHEN verdict IN ('attached', 'minted') THEN t END AS type,
  CASE WHEN verdict = 'refused' THEN CASE WHEN straddled THEN 'veto-straddle' WHEN len(types) > 1 THEN 'types-contradict' ELSE 'untyped' END END AS reason FROM judged""",
    base=False,
)
def link_mentions(spark, d):
    facts, lanes, entities, vetoes, classes = _mentions(spark, d)
    return linking.link_mentions(linking.endpoint_types(facts, lanes), entities, vetoes, classes)


@register(
    """WITH nodes AS (SELECT 'p' || p_partkey AS id, lower(p_type) AS type, lower(p_brand || ' ' || p_name) AS form, p_partkey AS ord FROM part WHERE p_partkey % 2 = 0
), anchors AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'p' || p_partkey WHEN 1 THEN 'e' || p_partkey WHEN 2 THEN upper(p_brand) || '  ' || p_name ELSE 'Nowhere ' || p_partkey END AS anchor FROM part
), norm AS (SELECT id, type, ord, trim(regexp_replace(form, '[^0-9a-z]+', ' ', 'g')) AS f FROM nodes
), reg AS (SELECT 'e' || p_partkey AS anchor, lower(p_type) AS type, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^0-9a-z]+', ' ', 'g')) AS f FROM part WHERE p_partkey % 4 = 1
), classes AS (SELECT DISTINCT trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^0-9a-z]+', ' ', 'g')) AS f, 'class:' || p_size AS root FROM part WHERE p_size < 4 QUALIFY row_number() OVER (PARTITION BY f ORDER BY p_size) = 1
), one AS (SELECT anchor, anchor AS node, 'literal' AS via FROM anchors WHERE anchor IN (SELECT id FROM nodes)
), two AS (SELECT anchor, arg_min(id, ord) AS node, 'registry-alias' AS via FROM anchors JOIN reg USING (anchor) JOIN norm USING (type, f) WHERE anchor NOT IN (SELECT anchor FROM one) GROUP BY 1
), rest AS (SELECT anchor, trim(regexp_replace(lower(anchor), '[^0-9a-z]+', ' ', 'g')) AS f FROM anchors WHERE anchor NOT IN (SELECT anchor FROM one UNION SELECT anchor FROM two)
), three AS (SELECT anchor, arg_min(id, ord) AS node, 'alias-class' AS via FROM (SELECT anchor, coalesce(root, f) AS key FROM rest LEFT JOIN classes USING (f)) JOIN (SELECT id, ord, coalesce(root, f) AS key FROM norm LEFT JOIN classes USING (f)) USING (key) GROUP BY 1)
SELECT anchor, node, via FROM anchors LEFT JOIN (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) USING (anchor)""",
    base=False,
)
def anchor_ladder(spark, d):
    p, k = star.table(spark, d, "part"), F.col("p_partkey")
    name = F.concat("p_brand", F.lit(" "), "p_name")
    id_ = lambda x: F.concat(F.lit(x), k)
    nodes = p.where(k % 2 == 0).select(id_("p").alias("id"), F.lower("p_type").alias("type"), F.array(name).alias("forms"), k.alias("ord"))
    registry = p.where(k % 4 == 1).select(id_("e").alias("entity_id"), F.lower("p_type").alias("type"), F.array(name).alias("forms"))
    classes = p.where("p_size < 4").groupBy(text.normalise_name(name).alias("name")).agg(F.min("p_size").cast("string").alias("root"))
    anchor = F.when(k % 4 == 0, id_("p")).when(k % 4 == 1, id_("e")).when(k % 4 == 2, F.concat(F.upper("p_brand"), F.lit("  "), "p_name")).otherwise(id_("Nowhere "))
    return linking.resolve_anchors(p.select(anchor.alias("anchor")), nodes, registry, classes)


def _surfaces(spark, d):
    p = star.table(spark, d, "part")
    id_ = F.concat(F.lit("p"), "p_partkey")
    full = F.concat("p_brand", F.lit(" "), "p_name", F.lit(" "), "p_partkey")
    return p.select(id_.alias("id"), F.lower("p_type").alias("type"), full.alias("surface"), F.lit("name").alias("kind")).unionByName(p.select(id_.alias("id"), F.lower("p_type").alias("type"), F.col("p_name").alias("surface"), F.lit("alias").alias("kind")))


@register(
    """WITH s AS (SELECT 'p' || p_partkey AS id, p_brand || ' ' || p_name || ' ' || p_partkey AS full_, p_name FROM part),
a AS (SELECT id, full_ AS surface FROM s WHERE lower(full_) = (SELECT lower(full_) FROM s WHERE id = 'p17')),
b AS (SELECT id, p_name AS surface FROM s WHERE regexp_replace(p_name, '[^0-9a-z]', '', 'g') = 'smallring')
SELECT 'name' AS probe, row_number() OVER (ORDER BY id)::INTEGER AS place, id, 100.0::DOUBLE AS score, surface, 'exact' AS tier, 'exact' AS resolution, true AS resolved FROM a
UNION ALL SELECT 'alias', row_number() OVER (ORDER BY id)::INTEGER, id, 95.0::DOUBLE, surface, 'squashed', CASE WHEN (SELECT count(*) FROM b) > 1 THEN 'ambiguous' ELSE 'near' END, (SELECT count(*) FROM b) = 1 FROM b""",
    base=False,
)
def find_entity_tiers(spark, d):
    s = _surfaces(spark, d)
    name = s.where("id = 'p17' and kind = 'name'").first().surface  # the question
    find = lambda probe, said: linking.find_entity(s, said).select(F.lit(probe).alias("probe"), "place", "id", "score", "surface", "tier", "resolution", "resolved")
    return find("name", f"  {name.upper()} ").unionByName(find("alias", "Small-Ring"))


@register()
def find_entity_suggested(spark, d):
    """Names like a misspelt one; likeness is not SQL's, so tests hold it against plain code."""
    return linking.find_entity(_surfaces(spark, d), "smal rnig of brand 2")
