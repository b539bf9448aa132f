"""Alerts from the difference of two snapshots."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.geo import within_area
from attestra.operators.filters import condition


def wire_key(parts: list[str], fallback: list[str]) -> Column:
    """The parts joined by |, or the fallback's where one is missing."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & F.col(p).isNotNull()
    return F.when(whole, F.concat_ws("|", *parts)).otherwise(F.concat_ws("|", *fallback))


def _met(before: DataFrame, after: DataFrame, how: str) -> DataFrame:
    pre = before.select(F.col("wire").alias("_w"), *[F.col(c).alias(f"before_{c}") for c in before.columns if c != "wire"])
    return after.join(pre, after.wire == pre._w, how)


def provenance() -> Column:
    """Claims behind an alert: those before, then those after that are new."""
    return F.array_distinct(F.concat(F.coalesce("before_claim_ids", F.array().cast("array<string>")), "claim_ids"))


def gates(trigger: dict) -> Column | None:
    """What a trigger's where_before, where_after and where_change ask of a wire before and after; None where it asks nothing.

    Each is a list of {field, op, value}. Without a view before, where_before and where_change never hold. where_change asks that the
    field differs and, where an op is given, tests the new value.
    """
    seen, tests = F.col("_w").isNotNull(), []
    for c in trigger.get("where_after") or ():
        tests.append(condition(F.col(c["field"]), c.get("op") or "exists", c.get("value")))
    for c in trigger.get("where_before") or ():
        tests.append(seen & condition(F.col(f"before_{c['field']}"), c.get("op") or "exists", c.get("value"), seen))
    for c in trigger.get("where_change") or ():
        tests.append(seen & ~F.col(f"before_{c['field']}").eqNullSafe(F.col(c["field"])))
        if c.get("op"):
            tests.append(condition(F.col(c["field"]), c["op"], c.get("value")))
    return functools.reduce(lambda a, b: a & b, tests) if tests else None


def crossings(before: DataFrame, after: DataFrame, gate: Column | None = None) -> DataFrame:
    """Wires whose known state differs: (wire, before_state, after_state, claim_ids). Views: (wire, state, claim_ids, ...)."""
    out = _met(before, after, "inner").where(F.col("before_state").isNotNull() & F.col("state").isNotNull() & (F.col("before_state") != F.col("state")))
    out = out if gate is None else out.where(gate)
    return out.select("wire", "before_state", F.col("state").alias("after_state"), provenance().alias("claim_ids"))


def fenced(view: DataFrame, lat: str, lon: str, center: tuple[float, float], km: float) -> DataFrame:
    """view with state inside or outside of an area, null without coordinates: what crosses its border is a crossing of states."""
    inside = within_area(F.col(lat), F.col(lon), center, km)
    return view.withColumn("state", F.when(inside, "inside").when(~inside, "outside"))


def appearances(before: DataFrame, after: DataFrame, gate: Column | None = None) -> DataFrame:
    """Wires that weren't there before."""
    out = _met(before, after, "left").where("_w is null")
    out = out if gate is None else out.where(gate)
    return out.select("wire", F.col("state").alias("after_state"), "claim_ids")


def matches(before: DataFrame, after: DataFrame, field: str, op: str, arg, gate: Column | None = None) -> DataFrame:
    """Wires for which the condition holds now and didn't before."""
    was = F.coalesce(condition(F.col(f"before_{field}"), op, arg, F.col("_w").isNotNull()), F.lit(False))
    met = _met(before, after, "left").where(condition(F.col(field), op, arg) & ~was)
    return (met if gate is None else met.where(gate)).select("wire", F.col(field).cast("string").alias("after_state"), provenance().alias("claim_ids"))


def in_scope(alerts: DataFrame, scope: DataFrame | None, subject: str) -> DataFrame:
    """Alerts whose subject is in scope (node); no scope lets all through, and so does a null subject."""
    if scope is None:
        return alerts
    return alerts.join(scope.select(F.col("node").alias("_n")).distinct(), alerts[subject] == F.col("_n"), "left").where(F.col("_n").isNotNull() | F.col(subject).isNull()).drop("_n")


def compile_trigger(trigger: dict) -> tuple[str, list[str]]:
    """(mode, keys that nothing reads): crossing, exists, match or armed."""
    known = {"mode", "state_field", "op", "value", "match_on", "where_before", "where_after", "where_change", "scope", "severity"}
    mode = trigger.get("mode") or ("match" if "op" in trigger else "crossing" if "state_field" in trigger else "armed")
    return mode, sorted(set(trigger) - known)


def evaluate(before: DataFrame | None, after: DataFrame, trigger: dict, scope: DataFrame | None = None) -> DataFrame:
    """(wire, before_state, after_state, claim_ids) of a trigger; a first view raises nothing, nor does an armed one.

    The trigger's gates must hold for each wire. scope: (node), the wires that may raise alerts; None lets all through.
    """
    return in_scope(_fired(before, after, trigger), scope, "wire")


def _fired(before: DataFrame | None, after: DataFrame, trigger: dict) -> DataFrame:
    mode, _ = compile_trigger(trigger)
    gate = gates(trigger)
    empty = after.where("false").select("wire", F.lit(None).cast("string").alias("before_state"), F.col("state").alias("after_state"), "claim_ids")
    if before is None or mode == "armed":
        return empty
    if mode == "crossing":
        return crossings(before, after, gate)
    if mode == "exists":
        return empty.unionByName(appearances(before, after, gate), allowMissingColumns=True)
    return empty.unionByName(matches(before, after, trigger.get("state_field", "state"), trigger["op"], trigger.get("value"), gate), allowMissingColumns=True)


def disposition_stats(dispositions: DataFrame) -> DataFrame:
    """(observable, fired, useful, noise, open, noise_rate) over dispositions (observable, verdict; null: open)."""
    of = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    g = dispositions.groupBy("observable").agg(F.count("*").alias("fired"), of("useful").alias("useful"), of("noise").alias("noise"), F.count(F.when(F.col("verdict").isNull(), 1)).alias("open"))
    return g.withColumn("noise_rate", F.when(F.col("useful") + F.col("noise") > 0, F.col("noise") / (F.col("useful") + F.col("noise"))))
