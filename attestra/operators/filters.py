"""Which claims take part: retraction, exclusion, rewind; and how a fact is oriented and typed."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.text import normalise_name

UNKNOWN = "UNKNOWN"


def drop_retracted(claims: DataFrame, retractions: DataFrame) -> DataFrame:
    """claims without retractions and without what they retract. retractions: (target)."""
    return claims.where("kind <> 'retraction'").join(retractions.select(F.col("target").alias("claim_id")).distinct(), "claim_id", "left_anti")


def drop_retracted_within(claims: DataFrame, *by: str) -> DataFrame:
    """claims without retractions and without the first claim, by id, of each group that has one: what drop_retracted leaves where
    retractions take back a claim of their own group."""
    own = Window.partitionBy(*by)
    marked = claims.withColumns({"_first": F.min("claim_id").over(own), "_taken": F.max(F.col("kind") == "retraction").over(own)})
    return marked.where("kind <> 'retraction' and not (_taken and claim_id = _first)").drop("_first", "_taken")


def drop_excluded(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """claims without the ids that decisions exclude. decisions: (exclude_claims array<string>)."""
    return claims.join(decisions.select(F.explode("exclude_claims").alias("claim_id")).distinct(), "claim_id", "left_anti")


def as_of(claims: DataFrame, day: str, available: str = "report_date") -> DataFrame:
    """What was known on day; a claim without a date stays."""
    return claims.where(F.col(available).isNull() | (F.col(available) <= F.lit(day).cast("date")))


def split_valid(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a retraction needs a target, an inference premises, and the form must be that asserted."""
    ok = ~((F.col("kind") == "retraction") & F.col("target").isNull()) & ~((F.col("kind") == "inference") & (F.coalesce(F.size("premises"), F.lit(0)) <= 0)) & (F.col("asserts") == F.col("form"))
    ok = F.coalesce(ok, F.lit(False))
    return claims.where(ok), claims.where(~ok)


def dedup_replay(log: DataFrame) -> DataFrame:
    """The first row, by seq, of each claim id."""
    return log.groupBy("claim_id").agg(F.min_by(F.struct(*[c for c in log.columns if c != "claim_id"]), "seq").alias("r")).select("claim_id", "r.*")


def type_index(entities: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(designator, type): what an entity claim says, else the gazetteer."""
    both = entities.select("designator", "type", F.lit(0).alias("p")).unionByName(gazetteer.select("designator", "type", F.lit(1).alias("p")))
    return both.groupBy("designator").agg(F.min_by("type", F.struct("p", "type")).alias("type"))


def orient(facts: DataFrame, types: DataFrame, lanes: DataFrame) -> DataFrame:
    """facts (subject, predicate, object, has_value) with subject and object swapped where only that fits the relation's ends better.

    lanes: (predicate, from_type, to_type, symmetric). A fact with a value, of a symmetric relation or between ends of one type stays.
    """
    t = lambda end: types.select(F.col("designator").alias(end), F.col("type").alias(f"{end}_type"))
    met = facts.join(t("subject"), "subject", "left").join(t("object"), "object", "left").join(F.broadcast(lanes), "predicate", "left")
    fit = lambda a, b: F.coalesce((F.col(a) == F.col("from_type")).cast("int"), F.lit(0)) + F.coalesce((F.col(b) == F.col("to_type")).cast("int"), F.lit(0))
    fixed = F.col("has_value") | F.coalesce("symmetric", F.lit(False)) | F.coalesce(F.col("subject_type") == F.col("object_type"), F.lit(False))
    swap = ~fixed & (fit("object_type", "subject_type") > fit("subject_type", "object_type"))
    keep = [c for c in facts.columns if c not in ("subject", "object")]
    return met.withColumn("swapped", swap).select(*keep, F.when(swap, F.col("object")).otherwise(F.col("subject")).alias("subject"), F.when(swap, F.col("subject")).otherwise(F.col("object")).alias("object"), "swapped")


def relane(facts: DataFrame, lanes: DataFrame) -> DataFrame:
    """facts (predicate, subject_type, object_type) with lane and verdict: kept, relaned, reversed or rejected.

    lanes: (from_type, to_type, edge). A pair of types that names another relation gets that; one that names one backwards is reversed.
    """
    fwd = F.broadcast(lanes.select(F.col("from_type").alias("subject_type"), F.col("to_type").alias("object_type"), F.col("edge").alias("fwd")))
    rev = F.broadcast(lanes.select(F.col("to_type").alias("subject_type"), F.col("from_type").alias("object_type"), F.col("edge").alias("rev")))
    allowed = F.broadcast(lanes.select(F.col("from_type").alias("subject_type"), F.col("to_type").alias("object_type"), F.col("edge").alias("predicate"), F.lit(True).alias("ok")))
    met = facts.join(allowed, ["subject_type", "object_type", "predicate"], "left").join(fwd.groupBy("subject_type", "object_type").agg(F.min("fwd").alias("fwd")), ["subject_type", "object_type"], "left")
    met = met.join(rev.groupBy("subject_type", "object_type").agg(F.min("rev").alias("rev")), ["subject_type", "object_type"], "left")
    verdict = F.when(F.col("ok"), "kept").when(F.col("fwd").isNotNull(), "relaned").when(F.col("rev").isNotNull(), "reversed").otherwise("rejected")
    return met.withColumn("verdict", verdict).withColumn("lane", F.when(F.col("ok"), F.col("predicate")).otherwise(F.coalesce("fwd", "rev"))).drop("ok", "fwd", "rev")


def fact_date(stated: Column, observed: Column, reported: Column, decays: Column) -> Column:
    """struct(date, rung): as stated, else observed, else reported for relations that decay, else undated."""
    rung = F.when(stated.isNotNull(), "stated").when(decays & observed.isNotNull(), "observation").when(decays & reported.isNotNull(), "report").otherwise("undated")
    return F.struct(F.when(rung == "stated", stated).when(rung == "observation", observed).when(rung == "report", reported).alias("date"), rung.alias("rung"))


def constraint(value: Column, op: str, arg) -> Column:
    """match, excluded or indeterminate. A null or UNKNOWN value is indeterminate, but for exists and not_exists."""
    known = value.isNotNull() & (value != UNKNOWN)
    if op in ("exists", "not_exists"):
        return F.when(known if op == "exists" else ~known, "match").otherwise("excluded")
    if op in ("=", "!="):
        ok = (value == str(arg)) if op == "=" else (value != str(arg))
    elif op == "in":
        ok = value.isin(list(arg)) if isinstance(arg, (list, tuple)) else F.lit(False)
    elif op in ("<", "<=", ">", ">="):
        n, m = value.try_cast("double"), F.lit(arg).try_cast("double")
        ok = F.coalesce({"<": n < m, "<=": n <= m, ">": n > m, ">=": n >= m}[op], F.lit(False))
    else:
        ok = F.lit(False)
    return F.when(~F.coalesce(known, F.lit(False)), "indeterminate").when(ok, "match").otherwise("excluded")


def verdict(parts: list[Column]) -> Column:
    """Of a row's constraints: excluded if any is, else indeterminate if any is, else match."""
    if not parts:
        return F.lit("match")
    names = F.array(*parts)
    return F.when(F.array_contains(names, "excluded"), "excluded").when(F.array_contains(names, "indeterminate"), "indeterminate").otherwise("match")


def condition(value: Column, op: str, arg=None, present: Column | None = None) -> Column:
    """A tripwire's test. Here UNKNOWN is a string like others; eq and ne fail where the field is missing (present is false)."""
    present = F.lit(True) if present is None else present
    if op in ("exists", "not_exists"):
        there = present & value.isNotNull()
        return there if op == "exists" else ~there
    if op == "eq":
        ok = value.eqNullSafe(F.lit(arg))
    elif op == "ne":
        ok = ~value.eqNullSafe(F.lit(arg))
    else:
        n, m = value.try_cast("double"), F.lit(arg).try_cast("double")
        ok = F.coalesce({"lt": n < m, "le": n <= m, "gt": n > m, "ge": n >= m}[op], F.lit(False))
    return present & ok


def gated_unknown(attr: Column) -> Column:
    return F.coalesce(F.upper(F.trim(attr)) == UNKNOWN, F.lit(False))


#: Fixed order of document formats and the cues that tell them; two cues decide, the first format that has them wins.
FORMAT_CUES = (
    ("markup", ("<html", "<div", "</")),
    ("licence", ("license", "copyright", "rights reserved")),
    ("listing", ("def ", "import ", "return ")),
    ("table", (" | ", "\t")),
    ("prose", (". ", ", ")),
)


def sniff_format(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, cues in FORMAT_CUES:
        hits = sum((low.contains(c).cast("int") for c in cues[1:]), low.contains(cues[0]).cast("int"))
        test = hits >= 2
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("other")


#: Families of source documents by what their text holds (in capitals) and by hints in the source's type.
#: A family takes a document by two of its cues or by one decisive token, in this order.
FAMILIES = {
    "notam_navwarning": (("NOTAM", "NAVAREA", "NAVWARN", " RWY ", "AERODROME", "AIRAC", " WEF ", "Q) O", "ARP "), "NOTAM"),
    "customs_gd_bol": (("GD NO", "B/L NO", "BILL OF LADING", "CONSIGNEE", "SHIPPER", "HS CODE", "PORT OF DISCHARGE", "DECLARED VALUE", "WEBOC", "MANIFEST"), "GD NO"),
    "tender_procurement": (("TENDER", "BID ", "BIDDER", "ANNEXURE", "EARNEST MONEY", "EMD", "PROCUREMENT", "[REDACTED]", "ELIGIBILITY", "OEM"), None),
    "social_post": (("HANDLE:", "STATUS URL", "FOLLOWERS", "@", "#", "REPOST", "RETWEET", "POSTED"), "STATUS URL"),
    "imagery_geoint": (("WGS-84", "WGS84", "OFF-NADIR", "CENTROID", "REVETMENT", "PETAL/RING", "MULTI-PASS"), "GEOSPATIAL INTELLIGENCE"),
}
HINTS = {
    "notam": ("notam", "navarea", "navwarn", "navigation-warning"),
    "official": ("official", "press", "statement", "ispr", "pr-", "-pr", "govt"),
    "trade": ("customs", "tender", "procurement", "weboc", "bol", "bill"),
    "social": ("social", "twitter", "telegram", "forum", "handle"),
    "satellite": ("satellite", "imagery", "geoint", "geospatial"),
}


def document_family(text: Column, source_type: Column) -> Column:
    """Which family a document is of: the source's type narrows it, the text decides what is left; prose where nothing tells."""
    up, hint = F.upper(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(source_type, F.lit("")))

    def looks(family: str) -> Column:
        cues, token = FAMILIES[family]
        enough = sum((F.contains(up, F.lit(c)).cast("int") for c in cues), F.lit(0)) >= 2
        return enough if token is None else enough | F.contains(up, F.lit(token))

    def hinted(name: str) -> Column:
        return functools.reduce(lambda a, b: a | b, [F.contains(hint, F.lit(w)) for w in HINTS[name]])

    prose = F.lit("prose_claim")
    out = F.when(hinted("notam"), "notam_navwarning").when(hinted("official"), F.when(looks("notam_navwarning"), "notam_navwarning").otherwise(prose))
    out = out.when(hinted("trade"), F.when(~looks("customs_gd_bol") & looks("tender_procurement"), "tender_procurement").otherwise("customs_gd_bol"))
    out = out.when(hinted("social"), "social_post").when(hinted("satellite"), "imagery_geoint")
    for family in FAMILIES:
        out = out.when(looks(family), family)
    return out.otherwise(prose)


def refined_type(node_type: Column, name: Column, refinements: list[tuple[str, str, tuple[str, ...], tuple[str, ...]]]) -> Column:
    """The narrower type that a name earns: (type, base, last words, whole names), the first of the list that fits; else node_type."""
    flat = normalise_name(name)
    out = F.when(F.lit(False), node_type)
    for narrow, base, heads, names in refinements:
        named = flat.isin(*names) if names else F.lit(False)
        head = F.element_at(F.split(flat, " "), -1).isin(*heads) if heads else F.lit(False)
        out = out.when((node_type == base) & (flat != "") & (named | head), narrow)
    return out.otherwise(node_type)


def hard_identifier(node_type: Column, name: Column, patterns: dict[str, list[str]]) -> Column:
    """The name where it is wholly a reference of the kind that its type declares, else null: a prose name states none."""
    bare, out = F.trim(name), F.when(F.lit(False), name)
    for t, rules in patterns.items():
        out = out.when((node_type == t) & bare.rlike("^(?:" + "|".join(f"(?:{r})" for r in rules) + ")$"), bare)
    return out
