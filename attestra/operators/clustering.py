"""Clusters under cannot-link vetoes, merged in rounds of joins, in the order that a walk from the best pair down would take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.graph import components, kept

#: Rounds after which the labels' lineage is cut.
CUT = 4


def _order() -> Column:
    """The walk's order of pairs: from the highest score down, ties by their ends."""
    return F.struct((-F.col("score")).alias("s"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """(a, b) and (b, a), each once."""
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def relabelled(pairs: DataFrame, moved: DataFrame) -> DataFrame:
    """pairs whose ends are what they moved to. moved: (node, root)."""
    out = pairs
    for end in ("a", "b"):
        to = moved.select(F.col("node").alias(end), F.col("root").alias("_to"))
        out = out.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return out


def _joined(taken: DataFrame) -> DataFrame:
    """(node, root) for taken (a, b), by which each a hangs on one b: root is the smallest of all that hang together.

    Only two that hang on each other make a circle. Each step doubles how far a node looks up.
    """
    back = taken.select(F.col("b").alias("a"), F.col("a").alias("_b"))
    up = taken.join(back, (taken.a == back.a) & (taken.b == back._b), "left").select(taken.a, F.when(F.col("_b").isNotNull(), F.least(taken.a, taken.b)).otherwise(taken.b).alias("b"))
    while True:
        over = up.select(F.col("a").alias("b"), F.col("b").alias("_up"))
        up = kept(up.join(over, "b", "left").select("a", F.coalesce("_up", "b").alias("b"), (F.coalesce("_up", "b") != F.col("b")).alias("rose")))
        if up.where("rose").isEmpty():
            break
        up = up.drop("rose")
    least = up.groupBy("b").agg(F.min(F.least("a", "b")).alias("root"))
    all_ = up.select("a", "b").unionByName(up.select(F.col("b").alias("a"), "b")).distinct()
    return kept(all_.join(least, "b").select(F.col("a").alias("node"), "root"))


def clusters(pairs: DataFrame, vetoes: DataFrame) -> DataFrame:
    """(raw, cluster) by accepting pairs (a, b, score) from the best down, but for those that would join two members of a veto (a, b).

    A cluster is named by its smallest member. Only connected components that hold a veto are contested; all others are clusters as they
    are. In those, each round decides every pair that the walk could decide with what is known, so none waits for its turn:

    * a pair that is the best of both of its clusters comes before all others of theirs, so both are what they are now: it is taken;
    * a cluster's best pair is taken, too, if none of the clusters that it is barred from has a pair before it: these are then still
      apart when the walk comes to it, wherever its other end will be;
    * a pair between clusters that are barred from each other is dropped: they stay so.

    Taken pairs are contracted, and vetoes become vetoes between clusters. The best pair of all is always decided, hence the end.
    """
    root = components(pairs.select("a", "b"))
    at = lambda end: root.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    inside = vetoes.select("a", "b").join(at("a"), "a").join(at("b"), "b").where("ra = rb")
    contested = kept(inside.select(F.col("ra").alias("root")).distinct())
    free = root.join(contested, "root", "left_anti").select(F.col("node").alias("raw"), F.col("root").alias("cluster"))
    some = root.join(contested, "root", "left_semi")
    open_ = kept(pairs.join(some.select(F.col("node").alias("a")), "a", "left_semi").where("a <> b").select("a", "b", _order().alias("o")))
    bars = kept(both_ways(inside))
    labels = kept(some.select(F.col("node").alias("raw"), F.col("node").alias("cluster")))
    turn = 0
    while True:
        open_ = open_.join(bars, ["a", "b"], "left_anti")
        ends = open_.select(F.col("a").alias("c"), F.col("b").alias("to"), "o").unionByName(open_.select(F.col("b").alias("c"), F.col("a").alias("to"), "o"))
        best = kept(ends.groupBy("c").agg(F.min(F.struct("o", "to")).alias("m")).select("c", "m.o", "m.to"))
        first = bars.join(best.select(F.col("c").alias("b"), "o"), "b").groupBy(F.col("a").alias("c")).agg(F.min("o").alias("barred_at"))
        twice = best.groupBy("o").agg(F.count("*").alias("n")).where("n = 2").select("o", F.lit(True).alias("mutual"))
        met = best.join(first, "c", "left").join(twice, "o", "left")
        taken = kept(met.where(F.coalesce("mutual", F.col("barred_at").isNull() | (F.col("barred_at") > F.col("o")))).select(F.col("c").alias("a"), F.col("to").alias("b")))
        if taken.isEmpty():
            return free.unionByName(labels)
        moved = _joined(taken)
        ends = relabelled(open_, moved).where("a <> b")
        open_ = kept(ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("o").alias("o")))
        bars = kept(relabelled(bars, moved).distinct())
        labels = labels.join(moved.select(F.col("node").alias("cluster"), F.col("root").alias("_to")), "cluster", "left").select("raw", F.coalesce("_to", "cluster").alias("cluster"))
        turn += 1
        if turn % CUT == 0:
            labels = kept(labels)
