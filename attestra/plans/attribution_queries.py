"""Registered query of attribution, beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import attribution
from attestra.plans.catalogue import register
from attestra.sources import star

# Customers are sites. Orders are what images show of them, or texts that place a part there, directly or through a unit; line items describe
# parts and units, and a third of the orders that are urgent are already premises.
_LEGS = """WITH sites AS (SELECT 'c' || c_custkey AS site FROM customer
), shapes AS (SELECT 'c' || o_custkey AS site, 'o' || o_orderkey AS observation, o_orderdate AS ord FROM orders WHERE o_orderstatus = 'F'
), premises AS (SELECT 'o' || o_orderkey AS claim FROM orders WHERE o_orderpriority = '1-URGENT'
), hops AS (SELECT 'u' || (p_partkey % 50) AS node, 'p' || p_partkey AS variant, -p_size AS ord FROM part
), presence AS (SELECT 'c' || o_custkey AS site, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_orderkey % 2000) ELSE 'u' || (o_orderkey % 60) END AS other, CASE WHEN o_orderkey % 3 = 0 THEN 'variant' ELSE 'unit' END AS other_type, 'o' || o_orderkey AS claim, o_orderdate AS ord FROM orders WHERE o_orderstatus = 'O'
), marks AS (SELECT CASE WHEN l_linenumber = 1 THEN 'p' || l_partkey ELSE 'u' || (l_partkey % 50) END AS holder, CASE WHEN l_linenumber = 1 THEN 'o' || l_orderkey ELSE 'l' || l_orderkey || ':' || l_linenumber || ':' || l_partkey END AS claim, CASE WHEN l_tax > 0.02 THEN ' ' || l_shipdate::DATE ELSE '' END AS geometry, l_extendedprice AS ord FROM lineitem WHERE l_linenumber = 1 OR (l_linenumber = 5 AND l_quantity < 5)
)"""


@register(
    _LEGS
    + """, shape AS (SELECT site, observation FROM shapes QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord, observation) = 1
), hop AS (SELECT node, variant FROM hops QUALIFY row_number() OVER (PARTITION BY node ORDER BY ord, variant) = 1
), there AS (SELECT site, claim AS textual, CASE WHEN other_type = 'variant' THEN other ELSE variant END AS variant FROM presence LEFT JOIN hop ON node = other WHERE other_type = 'variant' OR variant IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord, claim) = 1
), held AS (SELECT holder AS variant, 0 AS far, 0 AS spot, ord, claim, geometry FROM marks UNION ALL SELECT variant, 1, h.ord, m.ord, claim, geometry FROM hops h JOIN marks m ON m.holder = h.node
), mark AS (SELECT variant, claim AS reference, trim(geometry) AS geometry FROM held WHERE trim(geometry) <> '' QUALIFY row_number() OVER (PARTITION BY variant ORDER BY far, spot, ord, claim) = 1
), met AS (SELECT site, variant, observation, textual, reference, geometry, CASE WHEN observation IS NULL THEN 'no-shape-observation' WHEN observation IN (SELECT claim FROM premises) THEN 'already-attributed' WHEN variant IS NULL THEN 'no-textual-variant' WHEN reference IS NULL OR reference = textual THEN 'no-fingerprint' ELSE 'candidate' END AS verdict
  FROM sites LEFT JOIN shape USING (site) LEFT JOIN there USING (site) LEFT JOIN mark USING (variant))
SELECT site, verdict, """
    + ", ".join(f"CASE WHEN verdict = 'candidate' THEN {c} END AS {c}" for c in ("variant", "observation", "textual", "reference", "geometry"))
    + " FROM met",
    base=False,
)
def attribution_candidates(spark, d):
    name = lambda letter, c: F.concat(F.lit(letter), c)
    o, k = star.table(spark, d, "orders"), F.col("o_orderkey")
    sites = star.table(spark, d, "customer").select(name("c", F.col("c_custkey")).alias("site"))
    shapes = o.where("o_orderstatus = 'F'").select(name("c", F.col("o_custkey")).alias("site"), name("o", k).alias("observation"), F.col("o_orderdate").alias("ord"))
    premises = o.where("o_orderpriority = '1-URGENT'").select(name("o", k).alias("claim"))
    p = F.col("p_partkey")
    hops = star.table(spark, d, "part").select(name("u", p % 50).alias("node"), name("p", p).alias("variant"), (-F.col("p_size")).alias("ord"))
    direct = k % 3 == 0
    presence = o.where("o_orderstatus = 'O'").select(name("c", F.col("o_custkey")).alias("site"), F.when(direct, name("p", k % 2000)).otherwise(name("u", k % 60)).alias("other"), F.when(direct, "variant").otherwise("unit").alias("other_type"), name("o", k).alias("claim"), F.col("o_orderdate").alias("ord"))
    x, line = star.table(spark, d, "lineitem"), F.col("l_linenumber")
    first = line == 1
    claim = F.when(first, name("o", F.col("l_orderkey"))).otherwise(F.concat(F.lit("l"), "l_orderkey", F.lit(":"), "l_linenumber", F.lit(":"), "l_partkey"))
    geometry = F.when(F.col("l_tax") > 0.02, name(" ", F.date_format("l_shipdate", "yyyy-MM-dd"))).otherwise("")
    marks = x.where(first | ((line == 5) & (F.col("l_quantity") < 5))).select(F.when(first, name("p", F.col("l_partkey"))).otherwise(name("u", F.col("l_partkey") % 50)).alias("holder"), claim.alias("claim"), geometry.alias("geometry"), F.col("l_extendedprice").alias("ord"))
    return attribution.attribution_candidates(sites, shapes, premises, presence, hops, marks)
