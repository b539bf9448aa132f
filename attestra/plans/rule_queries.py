"""Registered queries over dates, document families, vetoes and gated alerts, beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import dates
from attestra.operators import filters, monitor, resolve
from attestra.plans import catalogue
from attestra.plans.catalogue import register
from attestra.sources import star

# -- dates

#: Kinds of phrase, each with the SQL of its bounds; a is the order's date, k its key.
_PHRASES = [
    (lambda a, k: F.concat_ws(" ", F.date_format(a, "MMMM"), F.year(a)), "date_trunc('month', a)", "last_day(a)", "label"),
    (lambda a, k: F.concat(F.lit("early "), F.year(a)), "make_date(year(a), 1, 1)", "make_date(year(a), 6, 30)", "label"),
    (lambda a, k: F.concat(F.lit("Mid "), F.year(a)), "make_date(year(a), 1, 1)", "make_date(year(a), 12, 31)", "label"),
    (lambda a, k: F.concat(F.lit("2nd half of "), F.year(a)), "make_date(year(a), 7, 1)", "make_date(year(a), 12, 31)", "label"),
    (lambda a, k: F.concat_ws(" ", F.dayofmonth(a), F.date_format(a, "MMMM"), F.year(a)), "a", "a", "exact"),
    (lambda a, k: F.concat(F.date_format(a, "MMM"), F.lit(" "), F.dayofmonth(a), F.lit("th, "), F.year(a)), "a", "a", "exact"),
    (lambda a, k: F.concat((k % 9 + 1).cast("string"), F.lit(" weeks ago")), "a - (7 * (k % 9 + 1) + 3)::INTEGER", "a - (7 * (k % 9 + 1) - 3)::INTEGER", "relative"),
    (lambda a, k: F.concat((k % 9 + 1).cast("string"), F.lit(" months ago")), "a - (30 * (k % 9 + 1) + 15)::INTEGER", "a - (30 * (k % 9 + 1) - 15)::INTEGER", "relative"),
    (lambda a, k: F.concat(F.lit("over "), (k % 4 + 1).cast("string"), F.lit(" years ago")), "make_date(year(a) - k % 4 - 1, 1, 1)", "make_date(year(a) - k % 4 - 1, 12, 31)", "relative"),
    (lambda a, k: F.lit("this quarter"), "date_trunc('quarter', a)", "last_day(date_trunc('quarter', a) + INTERVAL 2 MONTH)", "relative"),
    (lambda a, k: F.lit("seen recently"), "a - 30", "a", "relative"),
    (lambda a, k: F.concat(F.lit("as of "), F.year(a)), "make_date(year(a), 1, 1)", "make_date(year(a), 12, 31)", "as_of"),
    (lambda a, k: F.concat(F.lit("from Q1 "), F.year(a), F.lit(" to "), F.date_format(a, "MMMM"), F.lit(" "), F.year(a) + 1), "make_date(year(a), 1, 1)", "last_day(make_date(year(a) + 1, month(a), 1))", "range"),
    (lambda a, k: F.concat(F.lit("between "), F.year(a), F.lit(" and "), F.year(a) + 2), "make_date(year(a), 1, 1)", "make_date(year(a) + 2, 12, 31)", "range"),
    (lambda a, k: F.concat_ws(" ", F.date_format(a, "MMMM"), F.when(F.month(a) == 2, F.least(F.dayofmonth(a), F.lit(28))).otherwise(F.dayofmonth(a))), "make_date(year(a), month(a), CASE WHEN month(a) = 2 THEN least(day(a), 28) ELSE day(a) END)", "make_date(year(a), month(a), CASE WHEN month(a) = 2 THEN least(day(a), 28) ELSE day(a) END)", "exact"),
    (lambda a, k: F.concat(F.year(a), F.lit("/"), F.month(a), F.lit("/45")), "last_day(a)", "last_day(a)", "exact"),
    (lambda a, k: F.lit("31 November 2014"), "NULL", "NULL", None),
    (lambda a, k: F.lit("in due course"), "NULL", "NULL", None),
]


def _phrase_sql(i: int) -> str:
    whens = " ".join(f"WHEN {n} THEN ({p[i]})::DATE" for n, p in enumerate(_PHRASES))
    return f"CASE k % {len(_PHRASES)} {whens} END"


_KINDS = " ".join(f"WHEN {n} THEN " + (f"'{p[3]}'" if p[3] else "NULL") for n, p in enumerate(_PHRASES))


@register(f"SELECT k AS o_orderkey, {_phrase_sql(1)} AS lo, {_phrase_sql(2)} AS hi, CASE k % {len(_PHRASES)} {_KINDS} END AS kind FROM (SELECT o_orderkey AS k, o_orderdate::DATE AS a FROM orders)", base=False)
def date_phrases(spark, d):
    o = star.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("a"))
    said = F.lit(None).cast("string")
    for n, p in enumerate(_PHRASES):
        said = F.when(F.col("k") % len(_PHRASES) == n, p[0](F.col("a"), F.col("k")).cast("string")).otherwise(said)
    return o.withColumn("said", said).select(F.col("k").alias("o_orderkey"), dates.normalise(F.col("said"), F.col("a")).alias("b")).select("o_orderkey", "b.lo", "b.hi", "b.kind")


# -- documents


def _has(column: str, cues) -> str:
    return " + ".join(f"contains({column}, '{c}')::INT" for c in cues)


def _looks(family: str) -> str:
    cues, token = filters.FAMILIES[family]
    return f"({_has('t', cues)} >= 2" + (f" OR contains(t, '{token}'))" if token else ")")


_HINTED = {k: f"({_has('h', v)} > 0)" for k, v in filters.HINTS.items()}
_HINT_WORDS = ["", "Customs desk", "press-office", "social feed", "satellite tasking", "wire", "NOTAM office"]
_FAMILY_SQL = (
    f"CASE WHEN {_HINTED['notam']} THEN 'notam_navwarning' WHEN {_HINTED['official']} THEN CASE WHEN {_looks('notam_navwarning')} THEN 'notam_navwarning' ELSE 'prose_claim' END "
    f"WHEN {_HINTED['trade']} THEN CASE WHEN NOT {_looks('customs_gd_bol')} AND {_looks('tender_procurement')} THEN 'tender_procurement' ELSE 'customs_gd_bol' END "
    f"WHEN {_HINTED['social']} THEN 'social_post' WHEN {_HINTED['satellite']} THEN 'imagery_geoint' " + " ".join(f"WHEN {_looks(f)} THEN '{f}'" for f in filters.FAMILIES) + " ELSE 'prose_claim' END"
)


@register(f"SELECT doc_id, {_FAMILY_SQL} AS family FROM (SELECT doc_id, upper(coalesce(text, '')) AS t, lower({_HINT_WORDS!r}[doc_id % {len(_HINT_WORDS)} + 1]) AS h FROM documents)", base=False)
def document_families(spark, d):
    hint = star.pick(F.col("doc_id") % len(_HINT_WORDS), _HINT_WORDS)
    return star.table(spark, d, "documents").select("doc_id", filters.document_family(F.col("text"), hint).alias("family"))


# -- resolution

_NARROW = [("ring", "part", ("ring", "bolt"), ()), ("small", "part", (), ("small pin", "small gear"))]


@register("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'site' WHEN split_part(lower(p_name), ' ', -1) IN ('ring', 'bolt') THEN 'ring' WHEN lower(p_name) IN ('small pin', 'small gear') THEN 'small' ELSE 'part' END AS type FROM part", base=False)
def refined_types(spark, d):
    kind = F.when(F.col("p_partkey") % 4 == 0, "site").otherwise("part")
    return star.table(spark, d, "part").select("p_partkey", filters.refined_type(kind, F.col("p_name"), _NARROW).alias("type"))


_IDENTS = "idents AS (SELECT 'p' || p_partkey AS id, p_type AS type, CASE WHEN p_partkey % 3 <> 0 THEN 'BL-' || (p_partkey % 50) END AS ident FROM part)"


def _idents(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 != 0, F.concat(F.lit(" BL-"), k % 50)).otherwise(F.concat(F.lit("bill BL-"), k % 50))
    p = star.table(spark, d, "part").select(F.concat(F.lit("p"), k).alias("id"), F.col("p_type").alias("type"), name.alias("name"))
    rules = {t: [r"BL-\d+", r"GD \d+"] for t in (r.p_type for r in star.table(spark, d, "part").select("p_type").distinct().collect())}
    return p.select("id", "type", filters.hard_identifier(F.col("type"), F.col("name"), rules).alias("ident"))


@register(f"WITH {_IDENTS}, pairs AS (SELECT 'p' || p_partkey AS a, 'p' || (p_partkey + s) AS b FROM part, range(1, 6) AS r(s)) SELECT a, b FROM pairs JOIN idents x ON x.id = a JOIN idents y ON y.id = b WHERE x.type = y.type AND x.ident <> y.ident", base=False)
def identifier_vetoes(spark, d):
    k = F.col("p_partkey")
    pairs = star.table(spark, d, "part").select(F.concat(F.lit("p"), k).alias("a"), F.explode(F.array(*[F.concat(F.lit("p"), k + s) for s in range(1, 6)])).alias("b"))
    return resolve.identifier_vetoes(pairs, _idents(spark, d))


@register(f"WITH {_IDENTS}, n AS (SELECT type, ident, count(*) AS n FROM idents WHERE ident IS NOT NULL GROUP BY 1, 2) SELECT type, ident, n, (sum(n) OVER (PARTITION BY type) - n)::BIGINT AS barred FROM n", base=False)
def identifier_classes(spark, d):
    return resolve.identifier_classes(_idents(spark, d))


_THINGS = "things AS (SELECT c_custkey AS k, c_mktsegment AS type, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nation, c_acctbal AS bal, CASE WHEN c_custkey % 4 <> 1 THEN (c_custkey % 600) / 10.0 END AS lat, (c_custkey % 900) / 10.0 AS lon FROM customer)"


@register(f"""WITH {_THINGS}, met AS (SELECT x.k, x.type AS ta, y.type AS tb, x.nation AS na, y.nation AS nb, x.bal AS ba, y.bal AS bb,
  2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) AS km FROM things x JOIN things y ON y.k = x.k + 100)
SELECT k, CASE WHEN km > 1300 AND ta <> 'MACHINERY' THEN round(km, 6) END AS apart_km, ta <> tb OR coalesce(km > 1300 AND ta <> 'MACHINERY', false) OR coalesce(na <> nb, false) OR coalesce(abs(ba - bb) / greatest(abs(ba), abs(bb)) > 0.9, false) AS conflict FROM met""", base=False)
def hard_conflicts(spark, d):
    c, k = star.table(spark, d, "customer"), F.col("c_custkey")
    t = c.select(k.alias("k"), F.struct(F.col("c_mktsegment").alias("type"), F.when(k % 5 != 0, F.col("c_nationkey")).alias("nation"), F.col("c_acctbal").alias("bal"), F.when(k % 4 != 1, (k % 600) / 10.0).alias("lat"), ((k % 900) / 10.0).alias("lon")).alias("x"))
    met = t.join(t.select((F.col("k") - 100).alias("k"), F.col("x").alias("y")), "k")
    x, y = F.col("x"), F.col("y")
    far = resolve.geo_conflict_km(x["lat"], x["lon"], y["lat"], y["lon"], F.when(x["type"] != "MACHINERY", 1300.0))
    clash = resolve.hard_conflict(x["type"], y["type"], [(x["nation"], y["nation"])], [(x["bal"], y["bal"], 0.9)], far)
    return met.select("k", F.round(far, 6).alias("apart_km"), clash.alias("conflict"))


@register("""WITH edges AS (SELECT DISTINCT 'supplies' AS p, 's' || l_suppkey AS s, 'p' || l_partkey AS o, 'i' || (l_orderkey % 1000) AS i FROM lineitem),
pairs AS (SELECT 'p' || p_partkey AS a, 'p' || (p_partkey + 1) AS b FROM part), co AS (SELECT DISTINCT a, b, x.i FROM pairs JOIN edges x ON x.o = a JOIN edges y ON y.o = b AND x.i = y.i),
n AS (SELECT DISTINCT a, b, s, 'a' AS side FROM pairs JOIN edges e ON e.o = a WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.a = pairs.a AND co.b = pairs.b AND co.i = e.i) UNION SELECT DISTINCT a, b, s, 'b' FROM pairs JOIN edges e ON e.o = b WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.a = pairs.a AND co.b = pairs.b AND co.i = e.i)),
g AS (SELECT a, b, s, count(*) AS sides FROM n GROUP BY ALL), c AS (SELECT a, b, count(*) FILTER (sides = 2) AS shared, count(*) AS either FROM g GROUP BY 1, 2)
SELECT a, b, EXISTS (SELECT 1 FROM co WHERE co.a = pairs.a AND co.b = pairs.b) AS relocated, coalesce(shared, 0) AS shared, coalesce(either, 0) AS either FROM pairs LEFT JOIN c USING (a, b)""", base=False)
def unmoved_neighbours(spark, d):
    x, k = star.table(spark, d, "lineitem"), F.col("p_partkey")
    edges = x.select(F.lit("supplies").alias("predicate"), F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.concat(F.lit("p"), "l_partkey").alias("object"), F.concat(F.lit("i"), F.col("l_orderkey") % 1000).alias("instance"))
    return resolve.unmoved_neighbours(edges, star.table(spark, d, "part").select(F.concat(F.lit("p"), k).alias("a"), F.concat(F.lit("p"), k + 1).alias("b")))


# -- alerts

_GATED = catalogue._VIEWS.replace("max(event_id) AS a FROM", "max(event_id) AS a, arg_max(value, event_id) FILTER (ts < TIMESTAMP '2024-01-15') AS v0, arg_max(value, event_id) AS v1 FROM")


def _valued(spark, d):
    e = star.table(spark, d, "events").withColumn("wire", F.concat(F.lit("u"), "user_id"))
    view = lambda x: x.groupBy("wire").agg(F.max_by("event_type", "event_id").alias("state"), F.max_by("value", "event_id").alias("value"), F.array(F.concat(F.lit("ev-"), F.max("event_id"))).alias("claim_ids"))
    return view(e.where("ts < timestamp_ntz'2024-01-15 00:00:00'")), view(e)


@register(f"WITH {_GATED} SELECT wire, before AS before_state, after AS after_state, 'ev-' || b || ',ev-' || a AS claims FROM views WHERE before <> after AND before <> 'error' AND v1 > 20 AND v0 IS DISTINCT FROM v1 AND v1 < 90 AND wire LIKE '%1'", base=False)
def gated_crossing(spark, d):
    before, after = _valued(spark, d)
    trigger = {
        "state_field": "state",
        "where_before": [{"field": "state", "op": "ne", "value": "error"}],
        "where_after": [{"field": "value", "op": "gt", "value": 20}],
        "where_change": [{"field": "value", "op": "lt", "value": 90}],
    }
    scope = after.where("wire like '%1'").select(F.col("wire").alias("node"))
    return monitor.evaluate(before, after, trigger, scope).withColumn("claims", F.array_join("claim_ids", ",")).drop("claim_ids")


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(20.0 - {0} / 2) / 2), 2) + cos(radians({0} / 2)) * cos(radians(20.0)) * pow(sin(radians(40.0 - {0}) / 2), 2))))"
_INSIDE = "CASE WHEN {0} <= 2500 THEN 'inside' WHEN {0} > 2500 THEN 'outside' END"


@register(f"WITH {_GATED}, sides AS (SELECT wire, {_INSIDE.format(_KM.format('v0'))} AS before_state, {_INSIDE.format(_KM.format('v1'))} AS after_state FROM views) SELECT * FROM sides WHERE before_state <> after_state", base=False)
def geofence_crossing(spark, d):
    views = (monitor.fenced(v.withColumn("lat", F.col("value") / 2), "lat", "value", (20.0, 40.0), 2500.0) for v in _valued(spark, d))
    return monitor.crossings(*views).drop("claim_ids")
