"""Graph operators over edge tables: components, bounded reach, closure, shortest paths."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; on a local master that has none set, a new temporary one."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not own.isDefined():
        if not given and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.fspath(given) if given else tempfile.mkdtemp(prefix="spark-"))
    return given or own.get() if own.isDefined() else spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and kept in the checkpoint folder, with its lineage cut and its partitioning known."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffled files behind, where Spark has that setting: what was kept of it is read from its table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """df, computed and kept as a table in the shared folder, with its lineage cut and its size known.

    What rounds join again and again is kept so: a checkpoint goes on with the size that was guessed for its plan, and guesses
    multiply from round to round, so that no side ever counts as small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, by: str | tuple[str, ...], *more: DataFrame) -> DataFrame:
    """df and more as written, the rows of one `by` in one bucket, which Spark knows of: what groups or joins by it then moves nothing.

    Rows that were dealt by it into as many parts as a shuffle has (repartition) aren't moved to be written either. Tables that lie alike
    are put together here, each as it lies, not by a union.
    """
    spark = df.sparkSession
    by = (by,) if isinstance(by, str) else by
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"placed_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    for part in (df, *more):
        with _shuffles_removed(spark):
            part.select(df.columns).repartition(parts, *by).write.bucketBy(parts, *by).sortBy(*by).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet", mode="append")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return out


def listed(rows: DataFrame, keys: DataFrame, by: str, key: str, name: str) -> DataFrame:
    """rows with name: whether keys (by, key) has them. Rows that lie by `by` stay there; the keys come to them, those of one `by` as a list."""
    lists = keys.groupBy(by).agg(F.collect_set(key).alias("_listed"))
    return rows.join(lists, by, "left").select(*rows.columns, F.coalesce(F.array_contains("_listed", F.col(key)), F.lit(False)).alias(name))


def kept(df: DataFrame) -> DataFrame:
    """df as written, met by sorting both sides in the joins that follow.

    What grows with the input goes so in rounds: a file of keys is much smaller than its rows, so Spark would take it for small and send
    it through the driver, in each join of each round.
    """
    return written(df).hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): root is the smallest node reached. Labels fall along edges, then to the label's own label."""
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("m"))
        low = labels.join(near, labels.node == near.n, "left").select("node", F.col("root").alias("before"), F.least("root", F.coalesce("m", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("j"), F.col("root").alias("jr"))
        nxt = kept(low.join(jump, low.root == jump.j, "left").select("node", "before", F.least("root", F.coalesce("jr", "root")).alias("root")))
        labels = nxt.select("node", "root")
        if nxt.where("root <> before").isEmpty():
            return labels


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hops): what seeds (node) reach within hops undirected edges (a, b), at the least number of them."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    seen = checkpointed(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for k in range(1, hops + 1):
        front = front.select("node").join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(k))
        front = checkpointed(front)
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """(start, node): node is start or follows from it along edges (a, b), cycles allowed. Only new pairs are extended."""
    edges = checkpointed(edges.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("start")).unionByName(edges.select(F.col("b").alias("start"))).distinct()
    seen = checkpointed(nodes.withColumn("node", F.col("start")))
    front = seen
    while True:
        front = checkpointed(front.join(edges, front.node == edges.a).select("start", F.col("b").alias("node")).distinct().join(seen, ["start", "node"], "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = checkpointed(seen.unionByName(front))


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 4) -> DataFrame:
    """(src, dst, hops, nodes, edges) of the first shortest path for each pair (src, dst).

    edges: (id, type, a, b), walked both ways; type and id tell them apart. Of equally short paths the one wins whose steps come first by
    type and id. Half of the way is found from the ends, for all that lies around them; the other half from the starts of pairs that haven't
    met by then, so that no end looks at all that lies within hops of it. Of each node that was found only its first step nearer is kept.
    """
    most = min(hops, 4)
    first = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("type", "id")).alias("e"))
    one = written(first.select("a", "b", "e.type", "e.id"))  # of several edges between two nodes only the first is ever walked
    both = one.select(F.col("a").alias("x"), F.col("b").alias("y"), "type", "id").unionByName(one.select(F.col("b").alias("x"), F.col("a").alias("y"), "type", "id"))
    # the nth way out of x, in the order in which steps win: a number moves for each step, not what the step is. Kept as each join meets it
    ways = placed(both.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy("type", "id", "y"))).select("x", "y", "id", "n"), "x")
    back = placed(ways.select("y", "x", "n"), "y")
    taken = placed(ways.select("x", "n", "y", "id"), ("x", "n"))
    pairs = written(pairs.select("src", "dst").where("src <> dst").distinct())

    ring = pairs.select("dst", F.col("dst").alias("node")).distinct()
    near: dict[int, DataFrame] = {}  # (dst, node, n) by distance
    for k in range(1, most - most // 2 + 1):
        out = ring.select("dst", "node").join(back, F.col("node") == F.col("y")).select("dst", F.col("x").alias("node"), "n").where("node <> dst").groupBy("dst", "node").agg(F.min("n").alias("n"))
        for j in range(1, k):
            out = out.join(near[j].select("dst", "node"), ["dst", "node"], "left_anti")
        ring = near[k] = placed(out, ("dst", "node"))

    def apart(rows: DataFrame, k: int) -> DataFrame:
        return written(rows.join(near[k].select("dst", F.col("node").alias("src")), ["dst", "src"], "left_anti"))

    open_, half = pairs, len(near)
    for k in range(1, half + 1):
        open_ = apart(open_, k)
    for k in range(half + 1, most + 1):
        # from the starts to where the ends have come, by nodes alone; what met there goes back, through nodes that were asked for
        asked = {k: written(open_.select("dst", F.col("src").alias("node")).distinct())}
        for j in range(k - 1, half - 1, -1):
            asked[j] = asked[j + 1].join(ways, F.col("node") == F.col("x")).select("dst", F.col("y").alias("node"))
            if j > half:
                asked[j] = written(asked[j].distinct())
        ring = near[half].join(asked[half], ["dst", "node"], "left_semi")
        for j in range(half + 1, k + 1):
            ends = ring.select("dst", "node")
            if j == k:  # starts have few ways
                met = asked[j].join(ways, F.col("node") == F.col("x")).select("dst", "node", "n", F.col("y").alias("next")).join(ends.withColumnRenamed("node", "next"), ["dst", "next"], "left_semi")
            else:
                met = ends.join(back, F.col("node") == F.col("y")).select("dst", F.col("x").alias("node"), "n").join(asked[j], ["dst", "node"], "left_semi")
            ring = written(met.groupBy("dst", "node").agg(F.min("n").alias("n")))
            near[j] = near[j].unionByName(ring).distinct() if j in near else ring
        open_ = apart(open_, k)

    none = F.array().cast("array<string>")
    begin = pairs.select("src", "dst", F.col("src").alias("at"), F.array("src").alias("nodes"), none.alias("edges"))
    front = None
    for k in range(most, 0, -1):
        # those that are k steps away begin, others come from further away
        rows = begin if front is None else begin.unionByName(front)
        to = rows.join(near[k].withColumnRenamed("node", "at"), ["dst", "at"]).join(taken.withColumnRenamed("x", "at"), ["at", "n"])
        front = written(to.select("src", "dst", F.col("y").alias("at"), F.concat("nodes", F.array("y")).alias("nodes"), F.concat("edges", F.array("id")).alias("edges")))
    return front.select("src", "dst", F.size("edges").alias("hops"), "nodes", "edges")
