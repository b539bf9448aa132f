"""A corpus pipeline: each stage works on all its predecessor kept and hands on a Parquet table.

Defined cases: null and empty texts stay but for what a stage says of them. Rows of one doc_id are one document: repeated rows stay or go
together. A row without doc_id stays where a stage compares documents by id. Tables may be empty. Further columns stay as they are,
whatever their names; n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bpe, decontaminate, jaccard_join, line_dedup, staging, toxicity


def _of_texts(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage of docs, whose columns but doc_id and text are one struct meanwhile: no name of theirs meets one of the stage's."""
    own = ("doc_id", "text")
    rest = [c for c in docs.columns if c not in own]
    back = staging.unpacked(rest)
    return stage(docs.select(*own, staging.packed(rest).alias("rest"))).select(*[F.col(c) if c in own else back[c] for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go. It learns from the labels that it may see.

    A text that is null, empty or without words is scored by the trained bias alone, so it stays while most labels are 0. Without a label
    nothing is learned and nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return _of_texts(docs, lambda d: toxicity.score_documents(d, model).where("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more hold stay in the last of them alone. A null text becomes an empty one."""
    out = _of_texts(docs, line_dedup.dedup_lines)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 0.8 of their five-word shingles connect, the one with the smallest doc_id stays.

    All rows of that doc_id stay. So do rows without an id, and texts without words, which are copies of nothing.
    """
    keep = jaccard_join.link(docs, shingle=5, num=80, den=100).where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, docs.doc_id == keep._keep, "left_semi").unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth or more is text of the benchmark. A text without words stays."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _of_texts(docs, lambda d: decontaminate.remove_documents(d, items))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, there and back, as digests: a row for each row, repeated ones too. A null text has no ids."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: A trained classifier decides the first stage, so SQL can't say what is left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
