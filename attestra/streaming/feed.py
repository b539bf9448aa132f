"""Claims that arrive over time: append each batch, assess anew, and raise alerts from the difference.

The evidence stream has no watermark: a late claim takes part like any other, since it may reorder history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.operators.monitor import evaluate
from attestra.sources.log import ClaimLog


def watch(stream: DataFrame, log: ClaimLog, view: Callable[[DataFrame], DataFrame], trigger: dict, alerts_path: str, checkpoint: str) -> StreamingQuery:
    """Run over a stream (record_id, payload). view makes (wire, state, claim_ids) of a log; alerts are appended with their batch."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = log._old()
        before_path, after_path = f"{alerts_path}-views/{number - 1}", f"{alerts_path}-views/{number}"
        log.append(batch)
        view(log.scan()).write.mode("overwrite").parquet(after_path)
        before = spark.read.parquet(before_path) if there is not None and number else None
        evaluate(before, spark.read.parquet(after_path), trigger).withColumn("batch", F.lit(number)).write.mode("append").parquet(alerts_path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of events (ts, event_type), tumbling or sliding; on a stream, closed late after their end."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, finish, n): a user's events with less than gap between them."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")
