"""Registered queries over views, analyses and small rules, beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.config import DEFAULT as S
from attestra.functions import marks
from attestra.operators import analyses, credibility, graph, incremental, query, view
from attestra.plans import catalogue
from attestra.plans.catalogue import _CHOKES, _GRAPH_SQL, _REACH_SQL, _SLOT_SQL, _SLOTS, _chokes, _graph, register
from attestra.sources import star

_FUNCTIONAL = ("maintains",)
_BAND = ("confirmed", "probable")

# -- the whole view

_MERGED = "CASE WHEN CAST(substr(subject, 2) AS BIGINT) % 10 = 3 THEN 'p' || (CAST(substr(subject, 2) AS BIGINT) - 1) ELSE subject END"
_VIEW_SQL = (
    f"WITH {star.SQL}, merged AS MATERIALIZED ("
    f"SELECT * REPLACE ({_MERGED} AS subject, concat_ws(':', 'e', {_MERGED}, predicate, object) AS element_id) FROM standing)"
    + catalogue.STATUS.replace("FROM standing c", "FROM merged c")
    + _SLOT_SQL.replace("FROM standing c", "FROM merged c")
    + f""", targets AS (SELECT 'edge:' || subject || ':' || predicate AS instance, element_id AS target, min(event_date) AS lo, max(event_date) AS hi FROM merged WHERE predicate = 'maintains' GROUP BY ALL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY instance) AS n_targets, row_number() OVER (PARTITION BY instance ORDER BY lo DESC, hi DESC, target DESC) AS k FROM targets),
related AS (SELECT r.target AS element_id, r.hi < t.lo AS ordered, NOT r.hi < t.lo AND NOT (r.lo = t.lo AND r.hi = t.hi AND r.lo <> r.hi) AS contradicted, t.target AS newest FROM ranked r JOIN ranked t ON r.instance = t.instance AND t.k = 1 WHERE r.n_targets > 1 AND r.k > 1),
flagged AS (
  SELECT s.*, NOT (imagery OR trade) AS insufficient, coalesce(contradicted, false) AS contradicted, coalesce(ordered, false) AS ordered, newest
  FROM strong s JOIN slots USING (element_id) LEFT JOIN related USING (element_id)
), retired AS (SELECT f.*, ordered AND n.confidence >= {S.supersede_floor} AND NOT n.denied AS gone FROM flagged f LEFT JOIN gated n ON n.element_id = f.newest),
final AS (
  SELECT element_id, confidence,
    CASE WHEN gone THEN 'stale' WHEN insufficient THEN 'insufficient' WHEN contradicted THEN 'contradicted' WHEN strong AND NOT (aging OR stale) THEN 'confirmed' WHEN strong AND stale THEN 'stale' WHEN likely THEN 'probable' ELSE 'possible' END AS status,
    concat_ws(',', CASE WHEN gone THEN 'superseded' WHEN insufficient THEN 'insufficient-evidence' WHEN contradicted THEN 'credible-contradiction' WHEN strong AND NOT (aging OR stale) THEN NULL WHEN strong AND stale THEN 'stale-demotion'
      WHEN likely THEN CASE WHEN denied OR decoy_risk THEN 'capped-at-probable' WHEN strong AND (aging OR stale) THEN 'aging-not-fresh' WHEN effective_looks < 2 THEN 'single-independent-look' END ELSE 'below-probable-floor' END,
      CASE WHEN denied THEN 'adversary-denial' END, CASE WHEN decoy_risk THEN 'decoy-risk' END) AS gates
  FROM retired
), facts AS (
  SELECT element_id AS id, CASE predicate WHEN 'maintains' THEN 'edge:' || subject || ':' || predicate ELSE 'edge:' || subject || ':' || predicate || ':' || object END AS instance, predicate AS type, subject AS source, object AS target, count(DISTINCT claim_id) AS n_claims
  FROM merged GROUP BY ALL
), declared AS (SELECT 'p' || p_partkey AS id, 'part' AS type, p_name AS name, 0::BIGINT AS n_claims FROM part WHERE p_partkey % 10 <> 3),
ends AS (SELECT source AS id, n_claims FROM facts UNION ALL SELECT target, n_claims FROM facts),
nodes AS (SELECT * FROM declared UNION ALL SELECT id, 'unknown', id, sum(n_claims)::BIGINT FROM ends WHERE id NOT IN (SELECT id FROM declared) GROUP BY id)"""
)


def _insufficient(spark, d):
    def of(kept):
        typed = kept.join(star.sources(spark, d).select("source_id", "source_type"), "source_id", "left")
        slots = query.slot_counts(typed, _SLOTS, F.coalesce(credibility.lookup(F.col("source_type"), S.disciplines), F.lit(S.default_discipline)), S.as_of)
        return query.sufficiency(slots, any_of=["imagery", "trade"]).select("element_id", (~F.col("satisfied")).alias("insufficient"))

    return of


def _merges(part):
    name, k = (lambda c: F.concat(F.lit("p"), c)), F.col("p_partkey")
    return part.where(k % 10 == 3).select(name(k).alias("member"), name(k - 1).alias("canonical"), F.lit(0.9).alias("confidence"))


def _rebuilt(spark, d):
    part = star.table(spark, d, "part")
    merges = view.written(_merges(part))
    name = lambda c: F.concat(F.lit("p"), c)
    k = F.col("p_partkey")
    pairs = part.where(k % 100 == 7).select(name(k).alias("a"), name(k + 1).alias("b"), F.lit("same-as").alias("type"), F.lit(0.7).alias("merge_confidence"))
    pairs = pairs.unionByName(part.where(k % 100 == 9).select(name(k).alias("a"), name(k + 2).alias("b"), F.lit("distinct-from").alias("type"), F.lit(None).cast("double").alias("merge_confidence")))
    entities = part.select(name(k).alias("id"), F.lit("part").alias("type"), F.col("p_name").alias("name"), F.lit(0).cast("long").alias("n_claims"))
    kept = view.drawn(star.standing_placed(spark, d, merges))
    return view.composed(kept, star.sources(spark, d), entities, merges, pairs, _insufficient(spark, d), _FUNCTIONAL)


@register(_VIEW_SQL + """ SELECT id, instance, type, source, target, n_claims, round(confidence::DECIMAL(18, 9), 6)::DOUBLE AS confidence, status, gates, NULL::DOUBLE AS merge_confidence FROM facts JOIN final ON id = element_id
UNION ALL SELECT 'same-as:' || least(a, b) || '|' || greatest(a, b), NULL, 'same-as', a, b, NULL, NULL, NULL, NULL, 0.7::DOUBLE FROM (SELECT 'p' || p_partkey AS a, 'p' || (p_partkey + 1) AS b FROM part WHERE p_partkey % 100 = 7) WHERE a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes)
UNION ALL SELECT 'distinct-from:' || least(a, b) || '|' || greatest(a, b), NULL, 'distinct-from', a, b, NULL, NULL, NULL, NULL, NULL FROM (SELECT 'p' || p_partkey AS a, 'p' || (p_partkey + 2) AS b FROM part WHERE p_partkey % 100 = 9) WHERE a IN (SELECT id FROM nodes) AND b IN (SELECT id FROM nodes)""", base=False)
def rebuild(spark, d):
    return _rebuilt(spark, d)[1].withColumn("confidence", F.round(F.col("confidence").cast("decimal(18,9)"), 6).cast("double"))


@register(_VIEW_SQL + " SELECT id, type, name, n_claims, CASE WHEN substr(id, 1, 1) = 'p' AND CAST(substr(id, 2) AS BIGINT) % 10 = 2 AND CAST(substr(id, 2) AS BIGINT) + 1 IN (SELECT p_partkey FROM part) THEN 'p' || (CAST(substr(id, 2) AS BIGINT) + 1) || '@0.9' ELSE '' END AS resolved_from FROM nodes", base=False)
def rebuild_nodes(spark, d):
    n = _rebuilt(spark, d)[0]
    said = F.transform(F.coalesce("resolved_from", F.array().cast("array<struct<member:string,confidence:double>>")), lambda m: F.concat(m["member"], F.lit("@"), m["confidence"].cast("string")))
    return n.select("id", "type", "name", "n_claims", F.array_join(said, ",").alias("resolved_from"))


@register(_VIEW_SQL + " SELECT id, instance, type, source, target, n_claims, round(confidence::DECIMAL(18, 9), 6)::DOUBLE AS confidence, status, gates FROM facts JOIN final ON id = element_id", base=False)
def rebuild_incremental(spark, d):
    """All but a tenth of the orders first, with what is retracted or excluded later on; then the rest, and what leaves: the same view."""
    merges = graph.written(_merges(star.table(spark, d, "part")))
    log = view.drawn(star.claims_placed(spark, d, merges))
    gone = star.retractions(log, "element_id", "stated").select(F.col("target").alias("claim_id")).unionByName(log.where("excluded").select("claim_id"))
    facts, late = log.where("kind <> 'retraction'").drop("stated", "excluded"), F.col("orderkey") % 10 == 0
    live = incremental.LiveView.over(facts.where(~late), star.sources(spark, d), merges, _insufficient(spark, d), _FUNCTIONAL)
    return live.advance(facts.where(late), gone).edges.withColumn("confidence", F.round(F.col("confidence").cast("decimal(18,9)"), 6).cast("double"))


_HALVES = "b AS (SELECT 'u' || user_id AS id, arg_max(event_type, event_id) AS status FROM events WHERE event_id % 3 <> 0 GROUP BY 1), a AS (SELECT 'u' || user_id AS id, arg_max(event_type, event_id) AS status FROM events WHERE event_id % 3 <> 1 GROUP BY 1)"


@register(f"WITH {_HALVES} SELECT id, b.status AS before, a.status AS after, CASE WHEN b.status IS NULL THEN 'new' WHEN a.status IS NULL THEN 'gone' ELSE 'changed' END AS change FROM b FULL JOIN a USING (id) WHERE b.status IS DISTINCT FROM a.status", base=False)
def status_diff(spark, d):
    e = star.table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("id"), "event_type", "event_id")
    last = lambda k: e.where(F.col("event_id") % 3 != k).groupBy("id").agg(F.max_by("event_type", "event_id").alias("status"))
    return view.status_diff(last(0), last(1))


@register(" SELECT max(coalesce(report_date, event_date)) AS as_of FROM claims")
def effective_day(spark, d):
    return view.effective_day(star.claims(spark, d), None)


@register(" SELECT element_id, arg_max(claim_id, (event_date, claim_id)) AS claim_id, max(event_date) AS event_date FROM claims GROUP BY 1")
def best_dated_claim(spark, d):
    return view.best_dated(star.claims(spark, d))


@register(" , c AS (SELECT orderkey::VARCHAR AS doc, claim_id, CASE WHEN kind = 'observation' THEN 'llm' ELSE 'vlm' END AS method, CASE WHEN kind = 'observation' OR fingerprint IS NULL THEN event_date END AS day FROM claims), t AS (SELECT doc, max(day) AS latest FROM c WHERE method = 'llm' GROUP BY 1) SELECT claim_id, coalesce(day, CASE WHEN method = 'vlm' THEN latest END) AS event_date, method = 'vlm' AND day IS NULL AND latest IS NOT NULL AS inherited FROM c LEFT JOIN t USING (doc)")
def inherited_day(spark, d):
    c = star.claims(spark, d)
    text = F.col("kind") == "observation"
    rows = c.select(F.col("orderkey").cast("string").alias("doc"), "claim_id", F.when(text, "llm").otherwise("vlm").alias("method"), F.when(text | F.col("fingerprint").isNull(), F.col("event_date")).alias("event_date"))
    return view.inherit_day(rows).select("claim_id", "event_date", "inherited")


@register("SELECT min(id) AS id, lat, lon, radius, count(*)::INTEGER AS n, array_to_string(list_sort(list(id)), ',') AS members FROM (SELECT 'c' || c_custkey AS id, (c_nationkey * 2)::DOUBLE AS lat, (c_nationkey * 3)::DOUBLE AS lon, CASE WHEN c_custkey % 3 <> 0 THEN 500.0::DOUBLE * (c_custkey % 4) END AS radius FROM customer) GROUP BY lat, lon, radius, CASE WHEN radius IS NULL THEN id END", base=False)
def area_pins(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pins = star.table(spark, d, "customer").select(F.concat(F.lit("c"), k).alias("id"), (n * 2).cast("double").alias("lat"), (n * 3).cast("double").alias("lon"), F.when(k % 3 != 0, F.lit(500.0) * (k % 4)).alias("radius"))
    return view.area_pins(pins).withColumn("members", F.array_join("members", ","))


# -- analyses


@register(_GRAPH_SQL + " SELECT id, type, (SELECT count(*) FROM edges WHERE source = 'n3') AS n_out, (SELECT count(*) FROM edges WHERE target = 'n3') AS n_in FROM (SELECT 'n' || n_nationkey AS id, n_name AS type FROM nation) WHERE id = 'n3'")
def get_node(spark, d):
    nodes = star.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("type"))
    return analyses.node_card(nodes, _graph(spark, d), "n3")


_NEAR_SQL = _REACH_SQL.replace(" , ", "", 1).strip()
_SURE = "round((s_suppkey % 20) / 20.0, 2)::DOUBLE"


def _supplier_evidence(spark, d):
    s = star.table(spark, d, "supplier")
    return s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.round(F.col("s_suppkey") % 20 / 20.0, 2).alias("confidence"), F.length("s_name").cast("long").alias("cited"))


@register(_CHOKES + ", " + _NEAR_SQL + f" SELECT node, chokepoint, row_number() OVER (ORDER BY conf DESC, cited DESC, node) AS place FROM chokes JOIN (SELECT 's' || s_suppkey AS node, {_SURE} AS conf, length(s_name) AS cited FROM supplier) USING (node) WHERE chokepoint <> 'none' AND node IN (SELECT node FROM reached)")
def analyze_chokepoint(spark, d):
    return analyses.chokepoint_pool(_chokes(spark, d), _supplier_evidence(spark, d), analyses.near(_graph(spark, d), "r1", 3))


@register(_CHOKES + ", " + _NEAR_SQL + """, split AS (SELECT c.node, CASE WHEN s.state = 'sole' THEN 'confirmed' WHEN c.chokepoint = 'candidate' AND s.state = 'unknown' THEN 'candidate' END AS verdict FROM chokes c JOIN states2 s USING (node) WHERE c.node IN (SELECT node FROM reached))
SELECT node, verdict FROM split WHERE verdict IS NOT NULL UNION ALL SELECT NULL, 'insufficient' WHERE NOT EXISTS (SELECT 1 FROM split WHERE verdict IS NOT NULL)""")
def analyze_sole_source(spark, d):
    return analyses.sole_source_split(_chokes(spark, d), catalogue._states_of(spark, d), analyses.near(_graph(spark, d), "r1", 3))


_LINKS = "links AS (SELECT 'p' || l_partkey AS part, 's' || l_suppkey AS supplier, 'l' || l_orderkey || ':' || l_linenumber AS id, CASE WHEN l_quantity > 40 THEN 'confirmed' WHEN l_quantity > 25 THEN 'probable' WHEN l_quantity > 10 THEN 'possible' ELSE 'insufficient' END AS status, l_discount AS confidence FROM lineitem)"


@register(f"WITH {_LINKS}, ranked AS (SELECT *, CASE status WHEN 'confirmed' THEN 0 WHEN 'probable' THEN 1 ELSE 2 END AS place FROM links), best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY part ORDER BY place, confidence DESC, supplier, id, status) = 1) SELECT part, CASE WHEN place < 2 THEN supplier END AS supplier, CASE WHEN place < 2 THEN id END AS id, CASE WHEN place < 2 THEN status END AS status, (SELECT count(*) FROM ranked r WHERE r.part = best.part AND place = 2) AS weighed FROM best", base=False)
def analyze_supply_chain(spark, d):
    x, q = star.table(spark, d, "lineitem"), F.col("l_quantity")
    status = F.when(q > 40, "confirmed").when(q > 25, "probable").when(q > 10, "possible").otherwise("insufficient")
    links = x.select(F.concat(F.lit("p"), "l_partkey").alias("part"), F.concat(F.lit("s"), "l_suppkey").alias("supplier"), F.concat(F.lit("l"), "l_orderkey", F.lit(":"), "l_linenumber").alias("id"), status.alias("status"), F.col("l_discount").alias("confidence"))
    return analyses.best_links(links, _BAND)


@register("SELECT p_brand AS subject, 'p' || arg_min(p_partkey, (-p_retailprice, 'p' || p_partkey)) AS variant FROM part GROUP BY 1", base=False)
def best_variant(spark, d):
    p = star.table(spark, d, "part").select(F.col("p_brand").alias("subject"), F.concat(F.lit("p"), "p_partkey").alias("variant"), F.col("p_retailprice").alias("confidence"))
    return analyses.best_variant(p)


# -- small rules

_WORDS = "['occupied','Garrisoned','empty-pads','dormant','','Manned'][l_partkey % 6 + 1]"
_SEES = "(contains(lower(w), 'occupied') OR contains(lower(w), 'garrison') OR contains(lower(w), 'manned'))"


@register(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag = 'A' THEN true WHEN w = '' THEN false ELSE NOT {_SEES} END AS vacant, l_quantity > 5 AND {_SEES} AND l_linenumber <> 4 AND l_linenumber <> 2 AS eligible FROM (SELECT *, {_WORDS} AS w FROM lineitem)", base=False)
def occupancy_rules(spark, d):
    x = star.table(spark, d, "lineitem")
    word = star.pick(F.col("l_partkey") % 6, ["occupied", "Garrisoned", "empty-pads", "dormant", "", "Manned"])
    n = F.col("l_linenumber")
    vacant = marks.states_vacancy(F.when(F.col("l_returnflag") == "A", "negative").otherwise("positive"), word)
    eligible = marks.may_corroborate((F.col("l_quantity") > 5).cast("int"), word, F.when(n == 4, "Insufficient (10 m)"), F.when(n == 2, "oblique").when(n == 3, "Nadir"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", vacant.alias("vacant"), eligible.alias("eligible"))


@register("SELECT c_custkey, c_custkey % 5 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 3 = 0) AS locatable, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey % 7 END AS low, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey % 7 + 3 END AS high, (CASE WHEN c_acctbal < 0 THEN 2 WHEN c_acctbal / 10000 < 0.25 THEN 1 WHEN c_acctbal / 10000 < 0.5 THEN 2 WHEN c_acctbal / 10000 < 0.75 THEN 3 ELSE 4 END)::INTEGER AS dots FROM customer", base=False)
def site_rules(spark, d):
    c, k = star.table(spark, d, "customer"), F.col("c_custkey")
    low = F.col("c_acctbal") < 0
    r = marks.count_range(k % 7, k % 7 + 3, low)
    return c.select("c_custkey", marks.locatable(F.when(k % 5 == 0, "pl"), F.when(k % 2 == 0, 1.0), F.when(k % 3 == 0, 2.0)).alias("locatable"), r["low"].alias("low"), r["high"].alias("high"), marks.dots(F.when(~low, F.col("c_acctbal") / 10000)).alias("dots"))


@register("SELECT event_id, CASE WHEN event_type = 'click' THEN 'TransferEvent' WHEN user_id % 5 = 4 AND NOT (user_id % 2 = 0 OR user_id % 3 = 0) THEN CASE WHEN user_id % 7 = 0 THEN 'SightingEvent' END WHEN user_id % 2 = 0 AND user_id % 3 = 0 THEN 'TransferEvent' WHEN user_id % 7 = 0 AND user_id % 5 <> 4 THEN 'InductionEvent' ELSE 'SightingEvent' END AS type FROM (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 AND (user_id % 5 <> 4 OR user_id % 2 = 0 OR user_id % 3 = 0 OR user_id % 7 = 0) THEN 'click' END AS event_type FROM events)", base=False)
def event_typing(spark, d):
    e, u = star.table(spark, d, "events"), F.col("user_id")
    name = lambda ok: F.when(ok, "x").otherwise("")
    return e.select("event_id", marks.event_type(F.when(F.col("event_id") % 11 == 0, "transfer"), name(u % 5 != 4), name(u % 2 == 0), name(u % 3 == 0), name(u % 7 == 0)).alias("type"))


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber = 1 THEN 'row' || l_partkey WHEN l_linenumber = 2 THEN 'l' || l_partkey WHEN l_linenumber = 3 THEN 'f' || l_partkey WHEN l_linenumber = 4 THEN 'p' || l_partkey WHEN l_linenumber = 5 THEN CASE WHEN l_partkey % 2 = 0 THEN 'img' ELSE 'topleft' || l_partkey END WHEN l_linenumber = 6 THEN 'c' || l_partkey ELSE 'c0' END AS locator FROM lineitem", base=False)
def locator_stems(spark, d):
    x, n, p = star.table(spark, d, "lineitem"), F.col("l_linenumber"), F.col("l_partkey")
    at = lambda k: F.when(n == k, p)
    region = F.when(n == 5, F.when(p % 2 == 0, " --").otherwise(F.concat(F.lit("Top-Left "), p)))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", marks.locator(at(1), at(2), at(3), at(4), region, at(6)).alias("locator"))


@register("SELECT l_orderkey, arg_min(l_linenumber, (CASE WHEN l_partkey % 3 = 0 THEN l_suppkey ELSE 1e18 END, CASE WHEN l_partkey % 3 = 1 THEN l_suppkey ELSE 1e18 END, l_linenumber)) AS first_line FROM lineitem GROUP BY 1", base=False)
def earliest_place(spark, d):
    x, p, s = star.table(spark, d, "lineitem"), F.col("l_partkey"), F.col("l_suppkey")
    none = F.lit(None).cast("long")
    key = marks.place_order(F.when(p % 3 == 0, s), F.when(p % 3 == 0, s), F.when(p % 3 == 1, s), none, none, none, F.lit(None).cast("string"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    return x.groupBy("l_orderkey").agg(F.min_by("l_linenumber", key).alias("first_line"))


@register("SELECT doc_id, t <> '' AND contains(t, q) AND q <> '' AS supported FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t, trim(regexp_replace(substr(coalesce(text, ''), 11, 30), '\\s+', ' ', 'g')) AS q FROM documents)", base=False)
def quotes_supported(spark, d):
    t = F.coalesce("text", F.lit(""))
    return star.table(spark, d, "documents").select("doc_id", marks.quote_supported(F.substring(t, 11, 30), t).alias("supported"))


@register("SELECT p_partkey, trim(regexp_replace(p_type, '[-_]', ' ', 'g')) AS shown, CASE WHEN p_partkey % 3 = 0 THEN p_name || ':' || p_size ELSE p_name END AS name FROM part", base=False)
def shown_names(spark, d):
    p = star.table(spark, d, "part")
    minted = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("ent:part:"), "p_name", F.lit(":"), "p_size")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("ent:part:"), "p_name")).otherwise(F.col("p_name"))
    return p.select("p_partkey", marks.humanised(F.col("p_type")).alias("shown"), view.minted_name(minted).alias("name"))


@register("SELECT s_suppkey, array_to_string(list_sort(list_intersect([['site','unit','part'], ['unit','org'], ['part']][s_suppkey % 3 + 1], [['unit','part'], ['org'], ['site','part','org']][s_nationkey % 3 + 1])), ',') AS allowed FROM supplier", base=False)
def narrowed_types(spark, d):
    sets = lambda c, of: F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in of]), (c % 3 + 1).cast("int"))
    a, b = sets(F.col("s_suppkey"), [["site", "unit", "part"], ["unit", "org"], ["part"]]), sets(F.col("s_nationkey"), [["unit", "part"], ["org"], ["site", "part", "org"]])
    return star.table(spark, d, "supplier").select("s_suppkey", F.array_join(marks.types_allowed(a, b), ",").alias("allowed"))
