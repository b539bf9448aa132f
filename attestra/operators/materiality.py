"""What fails if one supplier does: sole sources, chokepoints, and how many a node depends on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.operators.graph import closure


def slots(edges: DataFrame, ends: DataFrame, roles: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(id, dependent, supplier, type, role, inferred): sustaining edges as suppliers and dependents.

    edges: (id, type, source, target, status); ends: (type, supplier_end: from or to, supplier_type); roles: (node, role, node_type).
    Edges of types that ends lacks are no supply; a supplier of another type than declared is passed over.
    """
    met = edges.join(F.broadcast(ends), "type")
    swap = F.col("supplier_end") == "to"
    met = met.select("id", "type", "status", "supplier_type", F.when(swap, F.col("target")).otherwise(F.col("source")).alias("supplier"), F.when(swap, F.col("source")).otherwise(F.col("target")).alias("dependent"))
    met = met.join(roles.select(F.col("node").alias("supplier"), "role", "node_type"), "supplier", "left")
    return met.where("supplier_type is null or node_type is null or supplier_type = node_type").select("id", "dependent", "supplier", "type", "role", (F.col("status") == "possible").alias("inferred"))


def sole_sources(slot_rows: DataFrame) -> DataFrame:
    """(dependent, type, role, supplier, id, inferred) of slots with one edge."""
    g = slot_rows.groupBy("dependent", "type", "role").agg(F.count("*").alias("n"), F.min("supplier").alias("supplier"), F.min("id").alias("id"), F.max("inferred").alias("inferred"))
    return g.where("n = 1").drop("n")


def substitutability(nodes: DataFrame, alternates: DataFrame) -> DataFrame:
    """(node, state). nodes: (node, declared_sole); alternates: (node, other, denied) of outgoing substitutes.

    A declared sole source settles it; else one alternate that isn't denied is enough; else it is unknown.
    """
    alt = alternates.groupBy("node").agg(F.max(~F.col("denied")).alias("real"))
    return nodes.join(alt, "node", "left").select("node", F.when(F.col("declared_sole"), "sole").when(F.col("real"), "alternates").otherwise("unknown").alias("state"))


def chokepoints(sole: DataFrame, states: DataFrame, foreign: DataFrame) -> DataFrame:
    """(node, chokepoint): none, candidate or confirmed for each node of states. foreign: (node) under evidenced foreign control.

    Where every nominating edge is inferred, nothing is confirmed.
    """
    n = sole.groupBy(F.col("supplier").alias("node")).agg(F.count("*").alias("n_sole"), F.min("inferred").alias("all_inferred"))
    met = states.join(n, "node", "left").join(foreign.select("node", F.lit(True).alias("foreign")).distinct(), "node", "left")
    sure = ~F.col("all_inferred") & ((F.col("state") == "sole") | F.coalesce("foreign", F.lit(False)))
    label = F.when(F.col("n_sole").isNull() | (F.col("state") == "alternates"), "none").when(sure, "confirmed").otherwise("candidate")
    return met.select("node", F.coalesce("n_sole", F.lit(0)).alias("n_sole"), label.alias("chokepoint"))


def closure_counts(slot_rows: DataFrame, chokes: DataFrame) -> DataFrame:
    """(node, n_confirmed): confirmed chokepoints among what a node depends on, itself included."""
    deps = closure(slot_rows.select(F.col("dependent").alias("a"), F.col("supplier").alias("b")))
    sure = chokes.where("chokepoint = 'confirmed'").select("node")
    return deps.join(sure, "node", "left_semi").groupBy(F.col("start").alias("node")).agg(F.count("*").alias("n_confirmed")).join(chokes.select("node"), "node", "right").select("node", F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"))
