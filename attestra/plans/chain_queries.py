"""Registered query of supply chains in full, beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import analyses
from attestra.plans.catalogue import register
from attestra.sources import star

_BAND = ("confirmed", "probable")
_HOPS = 4

# Customers are sites of units, units field parts, components are part of three parts each, suppliers make components (line 1) and build
# parts (line 2); what a line item's quantity says is the link's status.
_CHAINS = f"""WITH RECURSIVE sites AS (SELECT c_custkey AS k, c_custkey // 4 AS j FROM customer
), fields AS (SELECT DISTINCT 'f' || j AS id, j, j + 1 AS v FROM sites WHERE j % 6 <> 0 UNION SELECT DISTINCT 'g' || j, j, j + 2 FROM sites WHERE j % 4 = 1
), parts AS (SELECT p_partkey AS v FROM part
), links AS MATERIALIZED (SELECT CASE l_linenumber WHEN 1 THEN 'm' ELSE 'p' END || l_partkey AS part, 's' || l_suppkey AS supplier, 'l' || l_orderkey || ':' || l_linenumber AS id, l_linenumber AS line,
    CASE WHEN l_quantity > 40 THEN 'confirmed' WHEN l_quantity > 25 THEN 'probable' WHEN l_quantity > 10 THEN 'possible' ELSE 'insufficient' END AS status, l_discount AS confidence FROM lineitem WHERE l_linenumber < 3
), edges AS MATERIALIZED (SELECT 'b' || k AS id, 'based-at' AS type, 'c' || k AS a, 'u' || j AS b FROM sites WHERE k % 9 <> 0 UNION ALL SELECT id, 'fields', 'u' || j, 'p' || v FROM fields
  UNION ALL SELECT 'h' || v, 'part-of', 'm' || (v // 3), 'p' || v FROM parts WHERE v % 5 <> 0 UNION ALL SELECT id, CASE line WHEN 1 THEN 'makes' ELSE 'builds' END, supplier, part FROM links
), steps AS MATERIALIZED (SELECT type || chr(31) || id AS key, id, a AS x, b AS y FROM edges UNION ALL SELECT type || chr(31) || id, id, b, a FROM edges
), pool AS (SELECT 'p' || v AS variant, 'm' || (v // 3) AS component, 1 AS place FROM parts WHERE v % 7 <> 0 UNION ALL SELECT 'p' || v, 'm' || (v // 3 + 1), 2 FROM parts WHERE v % 11 <> 0
), ranked AS (SELECT *, CASE status WHEN 'confirmed' THEN 0 WHEN 'probable' THEN 1 ELSE 2 END AS place FROM links
), best AS MATERIALIZED (SELECT part, arg_min(supplier, (place, -confidence, supplier, id)) AS supplier, arg_min(status, (place, -confidence, supplier, id)) AS status, min(place) AS place, count(*) FILTER (place = 2) AS weighed FROM ranked GROUP BY 1
), mine AS (SELECT 'c' || k AS id, arg_min('p' || v, (-(v % 10) / 10.0, 'p' || v)) AS variant FROM sites JOIN fields USING (j) WHERE k % 9 <> 0 GROUP BY 1
), subjects AS (SELECT 'c' || k AS id, 'c' || k AS start, variant FROM sites LEFT JOIN mine ON mine.id = 'c' || k UNION ALL SELECT 'p' || v, 'p' || v, 'p' || v FROM parts
), chosen AS (SELECT s.*, arg_min(component, (place, component)) AS component FROM subjects s LEFT JOIN pool USING (variant) GROUP BY ALL
), made AS MATERIALIZED (SELECT s.*, CASE WHEN c.place < 2 THEN c.supplier WHEN o.place < 2 THEN o.supplier END AS maker, CASE WHEN c.place < 2 THEN component WHEN o.place < 2 THEN variant END AS maker_of, CASE WHEN c.place < 2 THEN c.status WHEN o.place < 2 THEN o.status END AS status,
    CASE WHEN variant IS NOT NULL THEN coalesce(c.weighed, 0) + CASE WHEN c.place < 2 THEN 0 ELSE coalesce(o.weighed, 0) END END AS weighed FROM chosen s LEFT JOIN best c ON c.part = component LEFT JOIN best o ON o.part = variant
), ends AS (SELECT *, coalesce(maker, component) AS "end" FROM made
), far AS (SELECT DISTINCT "end" AS dst, "end" AS node, 0 AS away FROM ends WHERE "end" IS NOT NULL UNION SELECT dst, y, away + 1 FROM far JOIN steps ON x = node WHERE away < {_HOPS}
), dist AS MATERIALIZED (SELECT dst, node, min(away) AS away FROM far GROUP BY 1, 2
), nxt AS MATERIALIZED (SELECT d.dst, d.node, d.away, arg_min(s.id, s.key) AS id, arg_min(s.y, s.key) AS y FROM dist d JOIN steps s ON s.x = d.node JOIN dist e ON e.dst = d.dst AND e.node = s.y AND e.away = d.away - 1 GROUP BY 1, 2, 3
), pairs AS (SELECT start AS src, "end" AS dst FROM ends UNION SELECT variant, "end" FROM ends WHERE maker IS NOT NULL
), walk AS (SELECT src, pairs.dst, src AS spot, [src] AS nodes, []::VARCHAR[] AS ids FROM pairs JOIN dist ON dist.dst = pairs.dst AND node = src AND away > 0
  UNION ALL SELECT src, w.dst, y, list_append(nodes, y), list_append(ids, id) FROM walk w JOIN nxt ON nxt.dst = w.dst AND nxt.node = w.spot
), path AS MATERIALIZED (SELECT src, dst, array_to_string(nodes, ' ') AS nodes, array_to_string(ids, ' ') AS ids FROM walk WHERE spot = dst
), met AS (SELECT e.*, f.nodes AS fn, f.ids AS fi, g.nodes AS gn, g.ids AS gi, component IS NOT NULL AND CAST(substr(component, 2) AS BIGINT) % 4 = 0 AS short
  FROM ends e LEFT JOIN path f ON f.src = start AND f.dst = e."end" LEFT JOIN path g ON g.src = variant AND g.dst = e."end" AND maker IS NOT NULL AND start <> variant)
SELECT id, variant, component, maker, maker_of, status, weighed, start, "end", CASE WHEN fn IS NOT NULL THEN 'traced' WHEN gn IS NOT NULL THEN 'partial' ELSE 'refused' END AS verdict, coalesce(fn, gn) AS path_nodes, coalesce(fi, gi) AS path_edges,
  CASE WHEN variant IS NULL THEN 'variant' WHEN "end" IS NULL THEN 'maker_or_component' WHEN fn IS NOT NULL THEN '' WHEN short THEN 'imagery trade' WHEN maker IS NOT NULL THEN 'path:' || start || '->' || maker ELSE 'maker:' || component || ' path:' || start || '->' || component END AS missing FROM met"""


def _tables(spark, d):
    k, v, x = F.col("k"), F.col("v"), star.table(spark, d, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), c)
    down = lambda c, n: F.floor(c / n).cast("long")
    sites = star.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), down(F.col("c_custkey"), 4).alias("j"))
    units, j = sites.select("j").distinct(), F.col("j")
    fields = units.where(j % 6 != 0).select(name("f", j).alias("id"), "j", (j + 1).alias("v")).unionByName(units.where(j % 4 == 1).select(name("g", j).alias("id"), "j", (j + 2).alias("v")))
    parts = star.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("v"))
    q = F.col("l_quantity")
    status = F.when(q > 40, "confirmed").when(q > 25, "probable").when(q > 10, "possible").otherwise("insufficient")
    line = F.col("l_linenumber")
    links = x.where(line < 3).select(F.concat(F.when(line == 1, "m").otherwise("p"), "l_partkey").alias("part"), name("s", F.col("l_suppkey")).alias("supplier"), F.concat(F.lit("l"), "l_orderkey", F.lit(":"), "l_linenumber").alias("id"), status.alias("status"), F.col("l_discount").alias("confidence"))
    made = links.select("id", F.when(F.col("part").startswith("m"), "makes").otherwise("builds").alias("type"), F.col("supplier").alias("a"), F.col("part").alias("b"))
    based = sites.where(k % 9 != 0)
    edges = (
        based.select(name("b", k).alias("id"), F.lit("based-at").alias("type"), name("c", k).alias("a"), name("u", j).alias("b"))
        .unionByName(fields.select("id", F.lit("fields").alias("type"), name("u", j).alias("a"), name("p", v).alias("b")))
        .unionByName(parts.where(v % 5 != 0).select(name("h", v).alias("id"), F.lit("part-of").alias("type"), name("m", down(v, 3)).alias("a"), name("p", v).alias("b")))
        .unionByName(made)
    )
    pool = parts.where(v % 7 != 0).select(name("p", v).alias("variant"), name("m", down(v, 3)).alias("component"), F.lit(1).alias("place"))
    pool = pool.unionByName(parts.where(v % 11 != 0).select(name("p", v).alias("variant"), name("m", down(v, 3) + 1).alias("component"), F.lit(2).alias("place")))
    variants = based.join(fields, "j").select(name("c", k).alias("subject"), name("p", v).alias("variant"), (v % 10 / 10.0).alias("confidence"))
    subjects = sites.select(name("c", k).alias("id"), F.lit("basing_site").alias("type")).unionByName(parts.select(name("p", v).alias("id"), F.lit("variant").alias("type")))
    c = F.col("component")
    unmet = pool.select("component").distinct().where(F.substring(c, 2, 20).cast("long") % 4 == 0).select("component", F.explode(F.array(F.lit("trade"), F.lit("imagery"))).alias("slot"))
    return subjects, variants, pool, links, edges, unmet


@register(_CHAINS, base=False)
def supply_chains(spark, d):
    subjects, variants, pool, links, edges, unmet = _tables(spark, d)
    got = analyses.supply_chains(subjects, variants, pool, links, edges, _BAND, unmet, hops=_HOPS)
    return got.withColumns({c: F.array_join(c, " ") for c in ("path_nodes", "path_edges", "missing")})
