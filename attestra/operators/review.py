"""Analysts' part: what needs a look, in which order, and what their decisions do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escalates(confidence: Column, materiality: Column, novelty: Column, sure: float = 0.85, most: float = 0.5) -> Column:
    """Only what is sure, minor and known passes by itself; an unknown value escalates."""
    return ~F.coalesce((confidence >= sure) & (materiality < most) & (novelty < most), F.lit(False))


def queue_order(items: DataFrame) -> DataFrame:
    """Pinned items by priority and id, then ranked ones by rank, then the rest by id."""
    return items.orderBy(F.when(F.col("pinned"), 0).otherwise(1), F.when(F.col("pinned"), F.col("priority")), F.when(~F.col("pinned"), F.col("rank")).asc_nulls_last(), "id")


def apply_decisions(elements: DataFrame, decisions: DataFrame) -> DataFrame:
    """elements (element_id, status) with the last status that decisions (seq, element_id, set_status) gave, and the flags they added."""
    last = decisions.groupBy("element_id").agg(F.max_by("set_status", F.when(F.col("set_status").isNotNull(), F.col("seq"))).alias("set_status"), F.array_sort(F.collect_set("flag")).alias("flags"))
    return elements.join(last, "element_id", "left").withColumn("status", F.coalesce("set_status", "status")).withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))).drop("set_status")


def accepted_aliases(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, barred) as (a, b): what merge decisions (a, b, verdict) accept becomes an alias; what they refuse is barred."""
    ok = F.lower("verdict").isin("accept", "accepted", "yes", "true")
    return decisions.where(ok).select("a", "b"), decisions.where(~ok).select("a", "b")


STEP = {"promote": {"possible": "probable", "probable": "confirmed"}, "demote": {"confirmed": "probable", "probable": "possible"}}


def step_status(status: Column, way: str) -> Column:
    out = status
    for a, b in STEP[way].items():
        out = F.when(status == a, b).otherwise(out)
    return out


def known_gaps(assessed: DataFrame) -> DataFrame:
    """(gap_id, element_id, missing) of insufficient elements."""
    return assessed.where("not satisfied").select(F.concat(F.lit("gap:"), "element_id").alias("gap_id"), "element_id", "missing")
