"""Questions to a view: find, neighbours, constraints, evidence, sufficiency."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.filters import constraint, verdict
from attestra.operators.graph import reach


def incident(edges: DataFrame) -> DataFrame:
    """Each edge at both of its ends: (node, other, direction, id, type). A loop comes twice."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit("out").alias("direction"), "id", "type")
    return out.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit("in").alias("direction"), "id", "type"))


def neighbours(edges: DataFrame, node: str, types: list[str] | None = None, direction: str = "both", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a node's edges by type and id, with total and has_more."""
    n = incident(edges).where(F.col("node") == node)
    if types:
        n = n.where(F.col("type").isin(types))
    if direction != "both":
        n = n.where(F.col("direction") == direction)
    total = n.count()
    page = n.orderBy("type", "id", "direction").offset(offset).limit(limit)
    return page.withColumn("total", F.lit(total).cast("long")).withColumn("has_more", F.lit(offset + limit < total))


def partition_by_constraints(rows: DataFrame, constraints: list[tuple[str, str, object]]) -> DataFrame:
    """rows with verdict: match, excluded or indeterminate. constraints: (column, op, value)."""
    return rows.withColumn("verdict", verdict([constraint(F.col(c).cast("string"), op, v) for c, op, v in constraints]))


def anchored(nodes: DataFrame, edges: DataFrame, anchor: str, hops: int = 4) -> DataFrame:
    """The nodes within hops of anchor, itself included."""
    seeds = nodes.where(F.col("id") == anchor).select(F.col("id").alias("node"))
    return nodes.join(reach(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), seeds, min(hops, 4)).select(F.col("node").alias("id")), "id", "left_semi")


def extreme(rows: DataFrame, value: str, how: str) -> DataFrame:
    """count, min (ties: the smallest id), max (ties: the largest) or rank of rows (id, value)."""
    if how == "count":
        return rows.agg(F.count("*").alias("count"))
    if how in ("min", "max"):
        pick = F.min if how == "min" else F.max
        return rows.where(F.col(value).isNotNull()).agg(pick(F.struct(value, "id")).alias("p")).select(F.col("p.id").alias("id"), F.col(f"p.{value}").alias(value))
    return rows.where(F.col(value).isNotNull()).orderBy(F.desc(value), "id")


def evidence(element_claims: DataFrame, sources: DataFrame, groups: DataFrame) -> DataFrame:
    """(element_id, n_claims, n_sources, n_groups, first, last, source_types) behind each element."""
    g = groups.groupBy("element_id").agg(F.countDistinct("group_id").alias("n_groups"))
    e = element_claims.join(sources.select("source_id", "source_type"), "source_id", "left")
    out = e.groupBy("element_id").agg(F.count("*").alias("n_claims"), F.countDistinct("source_id").alias("n_sources"), F.min("event_date").alias("first"), F.max("event_date").alias("last"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"))
    return out.join(g, "element_id", "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))


def lens(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, hops: int, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) in scope: reached first, filtered then, so a path may run through a node that goes. Edges keep both ends."""
    near = reach(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), anchors, hops)
    inside = nodes.join(near.select(F.col("node").alias("id"), "hops"), "id").where(keep)
    ids = inside.select("id")
    return inside, edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def slot_counts(claims: DataFrame, slots: dict[str, tuple[int, int | None]], slot: Column, day: str) -> DataFrame:
    """(element_id, one column for each slot): whether it has that many claims within so many days; undated ones pass."""
    c = claims.withColumn("_slot", slot)
    aggs = []
    for name, (least, within) in slots.items():
        ok = F.col("_slot") == name
        if within is not None:
            ok = ok & F.coalesce(F.datediff(F.lit(day).cast("date"), F.col("event_date")) <= within, F.lit(True))
        aggs.append((F.count(F.when(ok, 1)) >= least).alias(name))
    return c.groupBy("element_id").agg(*aggs)


def sufficiency(slots: DataFrame, any_of: list[str] | None = None, all_of: list[str] | None = None) -> DataFrame:
    """(element_id, satisfied, missing). An unmet any_of misses all of its slots; an unknown slot is never met."""
    met = lambda s: F.col(s) if s in slots.columns else F.lit(False)
    names = any_of or all_of or []
    hit = [met(s) for s in names]
    ok = F.lit(not names)
    for h in hit:
        ok = (ok | h) if any_of else (h if ok is None else ok)
    if all_of:
        ok = F.lit(True)
        for h in hit:
            ok = ok & h
        missing = F.array_compact(F.array(*[F.when(~h, F.lit(s)) for s, h in zip(names, hit, strict=True)]))
    else:
        missing = F.when(ok, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(s) for s in names]))
    return slots.select("element_id", ok.alias("satisfied"), F.array_join(missing, ",").alias("missing"))


_CITE = re.compile(r"\[([^\]]*)\]")


def check_answer(lines: list[str], known: set[str], counts: set[int]) -> list[tuple[int, str]]:
    """(line, fault) of a short written answer: every line cites, what is cited exists, and numbers are among those counted."""
    faults = []
    for i, line in enumerate(lines):
        cites = [c.strip() for m in _CITE.findall(line) for c in m.split(",") if c.strip()]
        if not cites:
            faults.append((i, "uncited"))
        faults += [(i, f"unknown claim {c}") for c in cites if c not in known]
        faults += [(i, f"count {n} is not among those found") for n in map(int, re.findall(r"(?<![\w-])\d+(?![\w-])", _CITE.sub("", line))) if n not in counts]
    return faults
