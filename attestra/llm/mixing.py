"""Mixing sources to target weights, by DataFrame functions alone.

Each document gets a hash-random key; documents are range-sorted by it inside their source, running sums of their sizes are taken over
the ranges (prefix.running), and a source is cut at its exact budget: whole epochs first, then documents in order of their keys until the
words of the budget are used up, the last of them in part.

Sources in order of code points, null last, weigh weights[0], weights[1], ... in turn. They share the words of all documents, a source at
most epochs times its own; what is above is shared anew among the others by weight. That is one level: sources sorted by epochs * size /
weight are full up to some place, and a running sum of what full ones hold and weigh gives the level for the rest.

Defined cases: a null or blank text has no words and none are taken; a source of such texts has a target of 0; null is a source of its
own; rows of equal doc_id are documents of their own, and rows equal in doc_id and text are interchangeable; very long texts are rows like
others and are cut like them; an empty table gives an empty table; further columns stay, but those named size, source_size, target and
taken are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm import staging
from attestra.llm.prefix import running

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = 12
WORDS = r"[^\x20\x09-\x0D]+"
RESULT = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(_none, _source, source_size, target) of sources (_none, _source, source_size)."""
    ranked = running(sizes, [], ["_none", "_source"], {"_place": "1"}, "sources")
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_most", F.col("source_size") * epochs).withColumn("_full_at", F.col("_most") / F.col("_weight"))
    filled = running(ranked, [], ["_full_at", "_none", "_source"], {"_held": "_most", "_weighed": "_weight"}, "levels")
    # one row; the sums are those of all sources
    of = sizes.agg(F.sum("source_size").alias("all"), F.count("*").alias("n")).first()
    turns, left = divmod(of.n, len(weights))
    level = (F.lit(of.all) - F.col("_held")) / (F.lit(turns * sum(weights) + sum(weights[:left])) - F.col("_weighed"))
    # of the sources in this order the first that isn't full by its own level sets the level of all; one row again; without one all are full
    at = filled.withColumn("_level", level).where("_full_at > _level").agg(F.min(F.struct("_full_at", "_none", "_source", "_level")).getField("_level").alias("level")).first()
    target = F.least(F.col("_most").cast("double"), F.lit(float("inf") if at.level is None else at.level) * F.col("_weight"))
    return filled.select("_none", "_source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, source, text, ...) with size, source_size, target (of its source) and taken, the words that the mix takes of it."""
    rest = [c for c in docs.columns if c not in RESULT and (keep_text or c != "text")]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = docs.select(staging.packed(rest).alias("_rest"), F.col("source").isNull().alias("_none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), n_words(F.col("text")).alias("size"), key.alias("_key"))
    # counted once: sorting into ranges reads its rows twice
    counted = staging.staged(rows, "sizes")
    placed = running(counted, ["_none", "_source"], ["_key", "size"], {"_before": "size"}, "mixed")
    staging.discard(counted)
    sizes = staging.staged(placed.groupBy("_none", "_source").agg(F.sum("size").alias("source_size")), "source-sizes")
    met = placed.join(targets(sizes, weights, epochs), ["_none", "_source"])
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    met = met.withColumn("_whole", whole).withColumn("_last", budget - F.col("_whole") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_last") - F.col("_before")))
    back = staging.unpacked(rest, "_rest")
    return met.select(*[back[c] for c in rest], "size", "source_size", "target", (F.col("_whole") * F.col("size") + part).cast("long").alias("taken"))


def drawn(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document of mix_sources as often as it is taken, with its epoch; the last time perhaps its first words alone."""
    epoch = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    rows = mixed.where("taken > 0").withColumn("epoch", epoch)
    left = (F.col("taken") - (F.col("epoch") - 1) * F.col("size")).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), F.lit(1), left), " ")
    return rows.withColumn("text", F.when(left < F.col("size"), first).otherwise(F.col("text")))
