"""Chat formatting by quotation linking.

A line that starts with `>` marks is quoted, as deep as it has marks; consecutive lines of one depth are a passage. A message's own
text is its other lines. Own texts are hashed whole, by paragraph and by line, normalised (letters lower-cased, white space to single
spaces). A paragraph is a run of lines without a blank one; it also ends where a quote stood and before the attribution (a line that
ends in a colon) of one. A message holds a passage if it has the whole of it, or each of its paragraphs as a part of its own or line by line; a
passage is linked to the last earlier message of its conversation that holds it. Part of a line is not found. A message replies to
the link of its shallowest linked passage, and of several to the latest. Messages that replies
connect are a thread, named by its first turn; a conversation is ordered by thread, then turn, so that each message stands after
what it answers, and quotes are left out.

The messages that hold a passage are sought once for each conversation, among those with its rarest part. Links are a running maximum
over (conversation, passage) in order of turns, so equal messages are never paired with each other.
Positions come from a sort by ranges and the counts of its parts, so a hot conversation is no single task's.

Defined cases: null and empty texts have no quotes and an empty own text; messages of one turn keep an order by role and text and do
not answer each other; a null conv_id is a conversation of its own, a null turn comes first and links with nothing; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.components import components
from attestra.llm.kernels import batches

_MARKS = re.compile(r"[ \t]*>(?:[ \t]*>)*[ \t]?")


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def _hash(text: str) -> bytes | None:
    """None for a passage without words."""
    text = normalise(text)
    return hashlib.blake2b(text.encode(), digest_size=16).digest() if text else None


def parse_quotes(text: str | None) -> tuple[str, list[tuple[int, str]], list[str]]:
    """(own text, [(depth, passage)], own runs of lines between quotes). The own text loses blank lines at its ends."""
    own: list[str] = []
    runs: list[list[str]] = [[]]
    quoted: list[tuple[int, list[str]]] = []
    depth_before = 0
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        depth = m[0].count(">") if m else 0
        if not depth:
            own.append(line)
            runs[-1].append(line)
        elif depth == depth_before:
            quoted[-1][1].append(line[m.end() :])
        else:
            quoted.append((depth, [line[m.end() :]]))
            if not depth_before:
                while runs[-1] and not runs[-1][-1].strip():
                    runs[-1].pop()
                if runs[-1] and runs[-1][-1].rstrip().endswith(":"):
                    runs.append([runs[-1].pop()])
                runs.append([])
        depth_before = depth
    return "\n".join(own).strip("\n"), [(d, "\n".join(lines)) for d, lines in quoted], ["\n".join(r) for r in runs if r]


def paragraphs(text: str) -> list[str]:
    return [p for p in re.split(r"\n\s*\n", text) if p.strip()]


def passages(own: str, runs: list[str]) -> set[str]:
    """What a quote may repeat of an own text: the whole, its paragraphs and its lines."""
    return {own, *paragraphs(own), *(p for r in runs for p in paragraphs(r)), *own.split("\n")} - {""}


_QUOTE = "struct<depth:int,hash:binary,key:binary,paras:array<struct<hash:binary,lines:array<binary>>>>"
_PARSED = f"conv_id long, turn long, role string, own string, quotes array<{_QUOTE}>, holds array<binary>"


def _quote(depth: int, passage: str) -> dict:
    """hash is of the passage's words, key of its words, lines and paragraphs."""
    paras = [[x for x in p.split("\n") if x.strip()] for p in paragraphs(passage)]
    shape = "\n\n".join("\n".join(map(normalise, p)) for p in paras)
    key = hashlib.blake2b(shape.encode(), digest_size=16).digest()
    return {"depth": depth, "hash": _hash(passage), "key": key, "paras": [{"hash": _hash("\n".join(p)), "lines": list(map(_hash, p))} for p in paras]}


def _parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    binary = pa.binary()
    para = pa.struct([("hash", binary), ("lines", pa.list_(binary))])
    quote = pa.struct([("depth", pa.int32()), ("hash", binary), ("key", binary), ("paras", pa.list_(para))])
    for b in batches(it):
        own, quotes, holds = [], [], []
        for t in b.column(3):
            mine, said, runs = parse_quotes(t.as_py())
            own.append(mine)
            quotes.append([_quote(d, q) for d, q in said])
            holds.append(sorted({h for p in passages(mine, runs) if (h := _hash(p)) is not None}))
        cols = [pa.array(own, pa.string()), pa.array(quotes, pa.list_(quote)), pa.array(holds, pa.list_(binary))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols], ["conv_id", "turn", "role", "own", "quotes", "holds"])


def _number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, part = 0, TaskContext.get().partitionId()
    for b in batches(it):
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*b.schema.names, "_part", "_at"])
        at += n


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with _rank, its rows' place from 0 on in that order, which ranges of rows are dealt by."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed = staging.staged(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_number, fields + ", _part int, _at long"), "ranks")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # n rows at most
    starts = placed.groupBy("_part").agg(F.count("*").alias("c")).select("_part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def holders(said: DataFrame, m: DataFrame) -> DataFrame:
    """(conv, key, turn): the turns of the messages that hold each passage of said (conv, hash, key, paras)."""
    asked = said.select("conv", "key", "hash", "paras").dropDuplicates(["conv", "key"])
    lines = F.explode_outer("para.lines").alias("line")
    flat = asked.select("conv", "key", "hash", F.posexplode("paras").alias("n", "para")).select("conv", "key", "hash", "n", F.col("para.hash").alias("para"), lines)
    parts = flat.select("conv", F.explode(F.array("hash", "para", "line")).alias("part")).distinct()
    held = m.where("turn is not null").select("conv", "_id", "turn", F.explode("holds").alias("part")).join(parts, ["conv", "part"], "left_semi").distinct()
    held = staging.staged(held, "held")
    often = held.groupBy("conv", "part").agg(F.count("*").alias("c"))
    count = lambda c: often.select("conv", F.col("part").alias(c), F.col("c").alias(f"{c}_c"))
    counted = flat.join(count("para"), ["conv", "para"], "left").join(count("line"), ["conv", "line"], "left").fillna(0, ["para_c", "line_c"])
    # a holder has one paragraph as every other: as a whole, or the rarest of its lines
    per = counted.groupBy("conv", "key", "hash", "n", "para", "para_c").agg(F.min(F.struct("line_c", "line")).alias("least"))
    rare = per.groupBy("conv", "key", "hash").agg(F.min(F.struct((F.col("para_c") + F.col("least.line_c")).alias("c"), "para", F.col("least.line").alias("line"))).alias("r"))
    keys = rare.select("conv", "key", F.explode(F.array("hash", "r.para", "r.line")).alias("part")).distinct()
    near = keys.join(held, ["conv", "part"]).select("conv", "key", "_id").distinct()
    has = lambda h: F.array_contains("holds", h)
    whole = has(F.col("hash")) | F.forall("paras", lambda p: has(p["hash"]) | F.forall(p["lines"], has))
    met = near.join(asked, ["conv", "key"]).join(held.groupBy("_id", "turn").agg(F.collect_set("part").alias("holds")), "_id")
    return met.where(whole).select("conv", "key", "turn").distinct()


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, n_quotes, n_linked, reply_to) of each message."""
    staging.prepare(messages.sparkSession)
    m = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(_parse, _PARSED)
    m = staging.staged(m.withColumn("_id", F.unhex(F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("conv_id").cast("string"), F.lit("?")), F.coalesce(F.col("turn").cast("string"), F.lit("?")), F.coalesce("role", F.lit("?")), F.to_json(F.struct("own", "quotes", "holds"))), 256))).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("?"))), "messages")
    said = m.where("turn is not null and size(quotes) > 0").select("conv", "turn", "_id", F.explode("quotes").alias("q")).select("conv", "turn", "_id", "q.*").where("hash is not null").dropDuplicates(["_id", "depth", "key"])
    said = staging.staged(said, "quotes")
    held = holders(said, m).select("conv", "turn", F.lit(None).cast("binary").alias("_id"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("binary").alias("hash"), "key")
    both = said.drop("paras").unionByName(held).withColumn("origin", F.when(F.col("_id").isNull(), F.col("turn")))
    # turns strictly before: the frame ends one turn earlier
    earlier = Window.partitionBy("conv", "key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    linked = both.withColumn("to", F.max("origin").over(earlier)).where("_id is not null and to is not null")
    linked = linked.groupBy("_id", "depth", "hash").agg(F.max("to").alias("to"))
    per = linked.groupBy("_id").agg(F.count("*").cast("long").alias("n_linked"), F.min(F.struct("depth", (-F.col("to")).alias("back"))).alias("best"))
    out = m.join(per.hint("rebalance"), "_id", "left")
    return out.select("conv_id", "turn", "role", "own", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), (-F.col("best.back")).alias("reply_to"))


def build_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, position, thread, turn, role, text, reply_to, n_quotes, n_linked): texts without quotes, in order of replies."""
    m = staging.staged(link_quotes(messages), "linked")
    node = lambda c: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("?")), F.lit("/"), F.col(c).cast("string"))
    groups = components(m.where("reply_to is not null").select(node("turn").alias("a"), node("reply_to").alias("b")))
    turn = F.element_at(F.split("node", "/"), -1).cast("long")
    threads = groups.join(groups.groupBy("root").agg(F.min(turn).alias("thread")).hint("rebalance"), "root").select("node", "thread").hint("rebalance")
    met = m.withColumn("_node", F.coalesce(node("turn"), F.lit("-"))).join(threads, F.col("_node") == threads.node, "left").drop("_node", "node")
    met = met.withColumn("thread", F.coalesce("thread", "turn"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("thread").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("own")]
    ranked = staging.staged(numbered(met, *order), "conversations")
    first = ranked.groupBy("conv_id").agg(F.min("_rank").alias("_first")).withColumnRenamed("conv_id", "_c").hint("rebalance")
    out = ranked.join(first, ranked.conv_id.eqNullSafe(first["_c"]))
    return out.select("conv_id", (F.col("_rank") - F.col("_first")).alias("position"), "thread", "turn", "role", F.col("own").alias("text"), "reply_to", "n_quotes", "n_linked")
