"""How far a claim can be believed: the source's reliability, integrity penalties and decay with age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.config import DEFAULT, Settings
from attestra.operators.graph import listed


def lookup(key: Column, values: dict) -> Column:
    """values[key], null where it is missing."""
    if not values:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def reliability(source_type: Column, settings: Settings = DEFAULT) -> Column:
    """The weighted mean of the factors that the class has; 0 for a class without factors."""
    table = {}
    for cls, factors in settings.class_factors.items():
        present = {f: w for f, w in settings.factor_weights.items() if f in factors}
        total = sum(present.values())
        table[cls] = sum(w * factors[f] for f, w in present.items()) / total if total > 0 else 0.0
    return F.coalesce(lookup(source_type, table), F.lit(0.0))


def recycled(claims: DataFrame, among: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """claims with first_seen: original for the first of a fingerprint, in order of event_date and id, else recycled.

    among: the claims of which it is the first, if more than these. by: a column of both by which claims lie and stay; the first claims come
    to them, which are at most one for each image.
    """
    images, order = (claims if among is None else among).where("fingerprint is not null").groupBy("fingerprint"), F.struct(F.col("event_date").isNull(), "event_date", "claim_id")
    # the first is found on the map side, so that an image that many claims share is no single task's
    if by is not None:
        met = listed(claims, images.agg(F.min_by(F.struct(by, "claim_id"), order).alias("f")).select("f.*"), by, "claim_id", "_first")
        return met.select(*claims.columns, F.when(F.col("fingerprint").isNotNull(), F.when(F.col("_first"), "original").otherwise("recycled")).alias("first_seen"))
    first = images.agg(F.min_by("claim_id", order).alias("_first"))
    # only claims with an image meet it: those without would all go under one null, to one task
    met = claims.where("fingerprint is not null").join(first, "fingerprint", "left").select(*claims.columns, F.when(F.col("claim_id") == F.col("_first"), "original").when(F.col("_first").isNotNull(), "recycled").alias("first_seen"))
    return met.unionByName(claims.where("fingerprint is null").withColumn("first_seen", F.lit(None).cast("string")))


def coordination_flag(claims: DataFrame, flagged_origins: DataFrame | None = None) -> DataFrame:
    """claims (joined to sources) with coordination_flag: an analyst's flag of the origin, else the claim's own, else the source's.

    flagged_origins: (origin, flag).
    """
    own = F.coalesce("coordination", F.when(F.col("coordinated"), "suspected"), F.lit("independent"))
    if flagged_origins is None:
        return claims.withColumn("coordination_flag", own)
    return claims.join(flagged_origins.select("origin", "flag"), "origin", "left").withColumn("coordination_flag", F.coalesce("flag", own)).drop("flag")


def integrity(settings: Settings = DEFAULT) -> Column:
    """The product of the penalties of artifact, first_seen, caption and coordination_flag; a missing signal costs nothing."""
    caption = lookup(F.col("caption"), {"consistent": "consistent", "inconsistent": "mismatched", "no-caption": "uncheckable"})
    out = F.lit(1.0)
    for name, flag in (("artifact", F.col("artifact")), ("first_seen", F.col("first_seen")), ("caption", caption), ("coordination", F.col("coordination_flag"))):
        own = {k.split(".", 1)[1]: v for k, v in settings.penalties.items() if k.startswith(f"{name}.")}
        out = out * F.coalesce(lookup(flag, own), F.lit(1.0))
    return out


def half_life(predicate: Column, settings: Settings = DEFAULT, variant: Column | None = None) -> tuple[Column, Column]:
    """(days, the class whose default was taken): relation.variant, else relation, else the default of its freshness class."""
    exact = lookup(predicate, settings.half_lives)
    if variant is not None:
        exact = F.coalesce(lookup(F.concat_ws(".", predicate, variant), settings.half_lives), exact)
    cls = lookup(predicate, settings.freshness_class)
    default = lookup(cls, settings.half_life_defaults)
    return F.coalesce(exact, default), F.when(exact.isNull() & default.isNotNull(), cls)


def anchor_date() -> Column:
    return F.coalesce("event_date", "report_date")


def decay(settings: Settings = DEFAULT) -> Column:
    """base ** (-age / half-life); 1 for what doesn't age, has no date, or isn't past."""
    days, _ = half_life(F.col("predicate"), settings)
    age = F.datediff(F.lit(settings.as_of).cast("date"), anchor_date())
    return F.when(days.isNull() | age.isNull() | (age <= 0), 1.0).otherwise(F.pow(F.lit(settings.decay_base), -(age / days)))


def score_claims(claims: DataFrame, sources: DataFrame, settings: Settings = DEFAULT, flagged_origins: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """claims with their source's columns, reliability, integrity, decay and credibility, the product of the three. among: see recycled.

    Claims that lie by element stay so where sources are few enough to be sent to them.
    """
    met = coordination_flag(recycled(claims, among, "element_id").join(sources, "source_id", "left"), flagged_origins)
    met = met.withColumn("reliability", reliability(F.col("source_type"), settings)).withColumn("integrity", integrity(settings)).withColumn("decay", decay(settings))
    return met.withColumn("credibility", F.col("reliability") * F.col("integrity") * F.col("decay"))


def element_freshness(claims: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(element_id, last_support, half_life_days, decay_factor, aging, stale) over the decaying, dated looks of each element."""
    days, _ = half_life(F.col("predicate"), settings)
    at = claims.select("element_id", "claim_id", anchor_date().alias("at"), days.alias("days"), decay(settings).alias("decay"))
    at = at.withColumn("aged", F.datediff(F.lit(settings.as_of).cast("date"), F.col("at")) > F.col("days"))
    # the latest date; of several, the smallest id, which comes first in an element's list. Elements without such a look stay, so all is one pass
    look = F.col("days").isNotNull() & F.col("at").isNotNull()
    best = at.groupBy("element_id").agg(F.min_by(F.struct("at", "days", "decay", "aged"), F.when(look, F.struct(-F.unix_date("at"), F.col("claim_id")))).alias("b"), F.max(F.when(look, F.col("aged"))).alias("aging"))
    return best.select("element_id", F.col("b.at").alias("last_support"), F.col("b.days").alias("half_life_days"), F.coalesce("b.decay", F.lit(1.0)).alias("decay_factor"), F.coalesce("aging", F.lit(False)).alias("aging"), F.coalesce("b.aged", F.lit(False)).alias("stale"))
