"""A Merkle manifest of a dataset: a tree for each source, one over their roots, and proofs read from a log in postorder.

Nodes of a tree have FANOUT children, the last of a level fewer, even one; levels go on while more than one node remains. A tree's log
has its nodes in the order in which they are completed, so an append is all that a builder ever does. A builder gets an aligned block of
BLOCK = FANOUT ** STEP nodes, which no other builder needs, writes each leaf and each node above it as its last child is there, and hands
its top node to the next round, whose builders do the same STEP levels higher. Since blocks are aligned, a node's place in its tree's log
follows from its level, its number there and the count of leaves alone (`position`), whichever builder wrote it, and a block's part of
a tree's log is one stretch of it.

A proof addresses siblings by these places. Leaves of a block meet the log rows of their own block, and the few places of their
block's path above it; siblings of their source's root in the tree of roots are on that path, too. So no table of whole proofs is ever shuffled.

H is the lowercase hex SHA-256 of its inputs' concatenation; digests go in as hex text and are kept as 32 bytes. A leaf is H of a row's
fields, each `-` if null, else its UTF-8 bytes' count, `:` and itself.

Defined cases: null is a source of its own, before all others; a null in the order comes first; rows equal in their order go by their
leaf, and wholly equal rows are interchangeable, each with a proof of its own; a source of one row has its leaf as its root, as a table
of one source has that source's root; an empty table gives an empty log and no proofs; long texts are hashed whole where they are read and
go no further; further columns, whatever their names, take no part.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.prefix import running

FANOUT = 16
STEP = 2
BLOCK = FANOUT**STEP
#: The tree over the sources' roots; a source's tree is named `-` for null, else `=` and the source.
ROOTS = "*"
LOG = "tree string, n long, level int, number long, position long, digest binary"


@dataclasses.dataclass
class Manifest:
    """log: (tree, n, level, number, position, digest); leaves: (tree, n, number, keys, digest, other); roots: (tree, n, number, digest),
    of each source's root its place among them and their count; keys: the columns that leaves are named by."""

    log: DataFrame
    leaves: DataFrame
    roots: DataFrame
    keys: list[str]

    @property
    def root(self) -> bytes | None:
        """The digest of the whole table, None of an empty one."""
        top = tops(self.log.where(F.col("tree") == ROOTS)).first()
        return bytes(top.digest) if top else None


def hashed(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def count_at(n: int, level: int) -> int:
    """Nodes of a level over n leaves."""
    return -(-n // FANOUT**level)


def height(n: int) -> int:
    """The root's level."""
    level = 0
    while n > FANOUT**level:
        level += 1
    return level


def position(n: int, level: int, number: int) -> int:
    """The place of a node in the log of a tree of n leaves, from 0: as many nodes as are complete before it."""
    reach = min((number + 1) * FANOUT**level, n)  # leaves that end with its own last
    below = sum(count_at(reach, m) for m in range(level))
    above = sum(number // FANOUT ** (m - level) for m in range(level + 1, height(n) + 1))
    return below + number + above


def run_of(n: int, level: int, number: int) -> range:
    """The numbers of the nodes that have a node's parent."""
    first = number - number % FANOUT
    return range(first, min(first + FANOUT, count_at(n, level)))


def leaf(fields: list[Column]) -> Column:
    """The leaf of a row with these fields, as bytes."""
    said = []
    for f in fields:
        text = f.cast("string")
        said.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*said), 256))


def _subtree(base: int):
    """The builder of one round: from nodes of level base of one block to all above them, up to STEP levels, in postorder."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        tree, block = key[0].as_py(), key[1].as_py()
        n = table.column("n")[0].as_py()
        by = np.argsort(table.column("number").to_numpy())
        given = [table.column("digest")[i].as_py() for i in by.tolist()]
        top = height(n)
        first = block * BLOCK
        open_: list[list[bytes]] = [[] for _ in range(STEP + 1)]
        rows: list[tuple[int, int, bytes]] = []

        def complete(step: int, number: int, digest: bytes) -> None:
            # the node is there; its parent is as soon as it was the last child
            if base == 0 or step > 0:
                rows.append((base + step, number, digest))
            if step == STEP or base + step == top:
                return
            open_[step].append(digest)
            if (number + 1) % FANOUT == 0 or number + 1 == count_at(n, base + step):
                children, open_[step] = open_[step], []
                complete(step + 1, number // FANOUT, hashed(children))

        for i, d in enumerate(given):
            complete(0, first + i, d)
        return pa.table(
            {
                "tree": pa.array([tree] * len(rows), pa.string()),
                "n": pa.array([n] * len(rows), pa.int64()),
                "level": pa.array([r[0] for r in rows], pa.int32()),
                "number": pa.array([r[1] for r in rows], pa.int64()),
                "position": pa.array([position(n, r[0], r[1]) for r in rows], pa.int64()),
                "digest": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    return build


def grow(leaves: DataFrame) -> DataFrame:
    """The log over leaves (tree, n, number, digest): rounds of builders, each an append of its own."""
    most = leaves.agg(F.max("n").alias("n")).first().n
    given, log, base = leaves.select("tree", "n", "number", "digest"), None, 0
    while True:
        blocks = given.withColumn("block", F.floor(F.col("number") / BLOCK)).groupBy("tree", "block")
        made = staging.staged(blocks.applyInArrow(_subtree(base), LOG), "merkle-log")
        log = made if log is None else log.unionByName(made)
        base += STEP
        if most is None or most <= FANOUT**base:
            return log
        # trees whose root is higher still
        given = made.where((F.col("level") == base) & (F.col("n") > FANOUT**base)).select("tree", "n", "number", "digest")


def tops(log: DataFrame) -> DataFrame:
    """(tree, n, digest) of the roots: what a tree's log ends with."""
    return log.where((F.col("number") == 0) & (F.col("level") == _height(F.col("n")))).select("tree", "n", "digest")


def _height(n: Column) -> Column:
    """height() as a column."""
    return functools.reduce(Column.__add__, [(n > F.lit(FANOUT**m)).cast("int") for m in range(15)])


def build(docs: DataFrame, fields: list[str], group: str, order: list[str], other: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs by group, leaves in this order. other: fields of a second version of a row, null where there is none;
    its leaf is kept beside the first for tests of proofs."""
    staging.prepare(docs.sparkSession)
    tree = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    changed = [F.coalesce(other[f], F.col(f)) if other and f in other else F.col(f) for f in fields]
    any_other = F.lit(False)
    for c in (other or {}).values():
        any_other = any_other | c.isNotNull()
    keys = [f"_key{i}" for i in range(len(order))]
    rows = docs.select(tree.alias("tree"), *[F.col(o).alias(k) for o, k in zip(order, keys, strict=True)], leaf([F.col(f) for f in fields]).alias("digest"), F.when(any_other, leaf(changed)).alias("other"))
    # hashed once: sorting into ranges reads its rows twice
    rows = staging.staged(rows, "leaves")
    placed = running(rows, ["tree"], [*keys, "digest"], {"number": "1"}, "numbered")
    counts = rows.groupBy("tree").agg(F.count("*").alias("n"))
    leaves = staging.staged(placed.join(counts, "tree"), "numbered-leaves")
    staging.discard(rows)
    log = grow(leaves)
    roots = tops(log).select(F.col("tree").alias("of"), "digest").withColumn("tree", F.lit(ROOTS))
    over = staging.staged(running(roots, ["tree"], ["of"], {"number": "1"}, "numbered"), "root-leaves")
    over = over.withColumn("n", F.lit(over.count()).cast("long"))
    return Manifest(log.unionByName(grow(over)), leaves.withColumnsRenamed(dict(zip(keys, order, strict=True))), over.select(F.col("of").alias("tree"), "n", "number", "digest"), order)


def _places(n: Column, level: Column, number: Column, most: int) -> Column:
    """position() as a column, for trees of at most `most` leaves."""
    top = height(most)
    power = lambda e: F.pow(F.lit(FANOUT), e).cast("long")
    reach = F.least((number + 1) * power(level), n)
    out = number
    for m in range(top + 1):
        out = out + F.when(level > m, F.ceil(reach / FANOUT**m)).when((level < m) & (n > FANOUT ** (m - 1) if m else F.lit(False)), F.floor(number / power(F.lit(m) - level))).otherwise(0)
    return out


def path_places(nodes: DataFrame, most: int, start: int) -> DataFrame:
    """(tree, from, level, position) of the runs that lie on the way up from nodes (tree, n, from), numbered from at level start."""
    power = F.pow(F.lit(FANOUT), F.col("level") - start)
    up = nodes.withColumn("level", F.explode(F.sequence(F.lit(start), F.lit(max(start, height(most) - 1))))).where(F.col("level") < _height(F.col("n")))
    first = (F.floor(F.col("from") / power / FANOUT) * FANOUT).cast("long")
    last = F.least(first + FANOUT, F.ceil(F.col("n") / F.pow(F.lit(FANOUT), "level")).cast("long")) - 1
    up = up.withColumn("number", F.explode(F.sequence(first, last)))
    return up.select("tree", "from", "level", _places(F.col("n"), F.col("level"), F.col("number"), most).cast("long").alias("position"))


def _proofs(keys: list[str], root: bytes | None):
    """Of one block's leaves all proofs, from the log rows (at, position, digest) of its subtree, its path and the tree of roots; a row
    at SOURCE has the source's root, its number among the roots as its position, and their count as its n."""

    def prove(_: tuple, leaves: pa.Table, rows: pa.Table) -> pa.Table:
        n = leaves.column("n")[0].as_py()
        where, place, digest, many = (rows.column(c).to_pylist() for c in ("at", "position", "digest", "n"))
        logs: dict[int, dict[int, bytes]] = {TREE: {}, OVER: {}, SOURCE: {}}
        for w, p, d in zip(where, place, digest, strict=True):
            logs[w][p] = d
        at = where.index(SOURCE)
        turn, n_roots, subroot = place[at], many[at], digest[at]
        held: dict[tuple[int, int, int], list[str]] = {}

        def run(log: int, n: int, level: int, number: int) -> list[str]:
            nodes = run_of(n, level, number)
            got = held.get((log, level, nodes.start))
            if got is None:
                got = held[log, level, nodes.start] = [logs[log][position(n, level, k)].hex() for k in nodes]
            return got

        said: dict[str, list] = {c: [] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
        for number, own, other in zip(*(leaves.column(c).to_pylist() for c in ("number", "digest", "other")), strict=True):
            node, proof = (other or own).hex(), hashlib.sha256()
            way = [(TREE, n, lv, number // FANOUT**lv) for lv in range(height(n))] + [(OVER, n_roots, lv, turn // FANOUT**lv) for lv in range(height(n_roots))]
            for log, size, level, k in way:
                nodes, k = run(log, size, level, k), k % FANOUT
                before, after = "".join(nodes[:k]), "".join(nodes[k + 1 :])
                proof.update(f"{before}{after}".encode())
                node = hashlib.sha256(f"{before}{node}{after}".encode()).hexdigest()
            for c, v in zip(said, (own.hex(), subroot.hex(), root.hex(), proof.hexdigest(), node, node == root.hex()), strict=True):
                said[c].append(v)
        return pa.table({**{k: leaves.column(k) for k in keys}, **said})

    return prove


#: What a log row is to a proof: of the source's tree, of the tree of roots, or the source's own root.
TREE, OVER, SOURCE = 0, 1, 2
PROOF = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(made: Manifest) -> DataFrame:
    """Of each leaf its keys, leaf, subroot, root, proof_sha256 (H of all siblings, from the leaf up, left to right), folded_root, which
    siblings and the other version of the row, where there is one, else the row, give, and verified, whether that is the root."""
    leaves = made.leaves.withColumn("block", F.floor(F.col("number") / BLOCK))
    trees, over = made.log.where(F.col("tree") != ROOTS), made.log.where(F.col("tree") == ROOTS)
    kept = ["tree", "block", "at", "position", "digest", "n"]
    own = trees.where(F.col("level") < STEP).withColumn("block", F.floor(F.col("number") / F.pow(F.lit(FANOUT), F.lit(STEP) - F.col("level")))).withColumn("at", F.lit(TREE))
    blocks = staging.staged(leaves.select("tree", "n", "block").distinct(), "blocks")
    most = blocks.agg(F.max("n").alias("n"), F.countDistinct("tree").alias("trees")).first()
    path = path_places(blocks.withColumnRenamed("block", "from"), most.n or 0, STEP).join(trees.where(F.col("level") >= STEP).select("tree", "position", "digest", "n"), ["tree", "position"])
    path = path.select(*[F.col("from").alias("block") if c == "block" else F.lit(TREE).alias(c) if c == "at" else F.col(c) for c in kept])
    beside = path_places(made.roots.select("tree", "n", F.col("number").alias("from")), most.trees, 0).join(over.select("position", "digest", "n"), "position")
    beside = beside.select("tree", F.lit(OVER).alias("at"), "position", "digest", "n")
    source = made.roots.select("tree", F.lit(SOURCE).alias("at"), F.col("number").alias("position"), "digest", "n")
    beside = beside.unionByName(source).join(blocks.select("tree", "block"), "tree").select(kept)
    rows = own.select(kept).unionByName(path).unionByName(beside)
    keys = leaves.select(*made.keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    return leaves.groupBy("tree", "block").cogroup(rows.groupBy("tree", "block")).applyInArrow(_proofs(made.keys, made.root), f"{schema}, {PROOF}")
