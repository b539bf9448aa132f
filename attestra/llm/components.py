"""Connected components by alternating large and small stars, over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import staging

#: A node with more than this share of all rows, and more than HEAVY_ROWS, gets its minimum by broadcast: at most 1 / HEAVY_SHARE nodes.
HEAVY_SHARE = 0.005
HEAVY_ROWS = 1000


def _with_min(df: DataFrame, rows: int) -> DataFrame:
    """df (u, v) with m, the smallest v of each u. Rows of heavy nodes stay where they are."""
    small = F.min("v").over(Window.partitionBy("u"))
    limit = max(HEAVY_ROWS, int(rows * HEAVY_SHARE))
    if rows <= limit:
        return df.withColumn("m", small)
    heavy = df.groupBy("u").agg(F.count("*").alias("c"), F.min("v").alias("m")).where(F.col("c") > limit).select("u", "m").collect()
    if not heavy:
        return df.withColumn("m", small)
    held = F.broadcast(df.sparkSession.createDataFrame(heavy, df.select("u", F.col("v").alias("m")).schema))
    return df.join(held, "u", "left_anti").withColumn("m", small).select("u", "v", "m").unionByName(df.join(held, "u").select("u", "v", "m"))


def _mark(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b): root is the smallest node that it reaches. Loops and repeats are allowed."""
    cur = staging.staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    mark = _mark(cur)
    while mark[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both, 2 * mark[0]).select("u", "v", F.least("u", "m").alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staging.staged(large, "star")
        small = _with_min(large, mark[0])
        nxt = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = staging.staged(nxt, "star")
        after = _mark(nxt)
        staging.discard(cur, large)
        cur, done, mark = nxt, after == mark, after
        if done:
            break
    out = cur.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._staged_path = cur._staged_path  # for discard
    return out
