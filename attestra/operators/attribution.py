"""Which system a site's shape may belong to: an image of the site, a text that places the system there, a reference that describes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; one struct for each key is all that is shuffled."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_f")).select(key, "_f.*")


def attribution_candidates(sites: DataFrame, shapes: DataFrame, premises: DataFrame, presence: DataFrame, hops: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(site, verdict, variant, observation, textual, reference, geometry), one row for each of sites (site).

    shapes (site, observation, ord): what images show of a site. premises (claim): what inferences already rest on. presence
    (site, other, other_type, claim, ord): what texts place at a site. hops (node, variant, ord): variants one step from a unit or component; fingerprints
    (holder, claim, geometry, ord): descriptions in references. Of several the first by ord, then by id, is meant.

    verdict: candidate, or the first that fails of no-shape-observation, already-attributed (the first observation is a premise),
    no-textual-variant (the first presence that is a variant or a step from one) and no-fingerprint (one held by the variant, else by what is a step from it; the claim that
    places it there doesn't count). Each leg is cut to one row a site, holder or variant before legs are joined, so no join makes more rows
    than there are sites or hops, however many claims a site, a unit or a variant has. Blank and null geometries describe nothing.
    """
    shape = _first(shapes.select("site", "ord", "observation"), "site", ["ord", "observation"]).drop("ord")
    used = premises.select(F.col("claim").alias("observation")).distinct().withColumn("_used", F.lit(True))
    step = _first(hops.select(F.col("node").alias("other"), "ord", F.col("variant").alias("_step")), "other", ["ord", "_step"]).drop("ord")
    there = presence.join(step, "other", "left").withColumn("variant", F.when(F.col("other_type") == "variant", F.col("other")).otherwise(F.col("_step")))
    there = _first(there.where("variant is not null").select("site", "ord", F.col("claim").alias("textual"), "variant"), "site", ["ord", "textual"]).drop("ord")
    best = _first(fingerprints.where("trim(geometry) <> ''").select("holder", "ord", "claim", F.trim("geometry").alias("geometry")), "holder", ["ord", "claim"])
    own = best.select(F.col("holder").alias("variant"), F.lit(0).alias("far"), F.lit(None).cast(hops.schema["ord"].dataType).alias("at"), "ord", F.col("claim").alias("reference"), "geometry")
    beside = hops.select(F.col("node").alias("holder"), "variant", F.col("ord").alias("at")).join(best, "holder").select("variant", F.lit(1).alias("far"), "at", "ord", F.col("claim").alias("reference"), "geometry")
    mark = own.unionByName(beside)
    mark = _first(mark, "variant", ["far", "at", "ord", "reference"]).select("variant", "reference", "geometry")
    met = sites.select("site").distinct().join(shape, "site", "left").join(used, "observation", "left").join(there, "site", "left").join(mark, "variant", "left")
    verdict = (
        F.when(F.col("observation").isNull(), "no-shape-observation").when(F.col("_used"), "already-attributed").when(F.col("variant").isNull(), "no-textual-variant")
        .when(F.col("reference").isNull() | (F.col("reference") == F.col("textual")), "no-fingerprint").otherwise("candidate")
    )
    met = met.withColumn("verdict", verdict)
    kept = lambda c: F.when(F.col("verdict") == "candidate", F.col(c)).alias(c)
    return met.select("site", "verdict", *[kept(c) for c in ("variant", "observation", "textual", "reference", "geometry")])
