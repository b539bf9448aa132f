"""The append-only log of claims: readers of JSON bundles, sequence numbers, point lookups. Nothing here rewrites or deletes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.operators.graph import checkpointed


class ClaimLog:
    """A Parquet table (seq, record_id, payload) at path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, records: DataFrame, arrival: list[str] | None = None) -> int:
        """Add records (record_id, payload, the columns of arrival), once each, and return the last seq.

        seq follows arrival, by default the record ids; of several records of one id the first stays. Record ids that are there already
        are left out, so a bundle can be sent again. One writer at a time: two would take the same numbers.
        """
        order = [*(arrival or []), "record_id"]
        old = self._old()
        top = old.agg(F.max("seq").alias("m")).first().m if old is not None else None
        new = records.groupBy("record_id").agg(F.min(F.struct(*(arrival or []), "payload")).alias("r")).select("record_id", "r.*")
        if old is not None:
            new = new.join(old.select("record_id"), "record_id", "left_anti")
        start = 0 if top is None else top
        # ranges are numbered each on its own, on top of the counts of those before; staged, so that a range stays what was counted
        dealt = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        dealt = checkpointed(dealt.select("record_id", "payload", F.shiftright("_at", 33).alias("_part"), F.expr("_at & 8589934591L").alias("_at")))
        counts = dealt.groupBy("_part").agg(F.count("*").alias("n"))
        before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
        ranked = dealt.join(before, "_part").select((F.col("_before") + F.col("_at") + start + 1).alias("seq"), "record_id", "payload")
        ranked.write.mode("append").parquet(self.path)
        return self.scan().agg(F.max("seq").alias("m")).first().m or 0

    def _old(self) -> DataFrame | None:
        jvm = self.spark._jvm.org.apache.hadoop.fs
        at = jvm.Path(self.path)
        return self.scan() if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at) else None

    def scan(self) -> DataFrame:
        return self.spark.read.schema("seq long, record_id string, payload string").parquet(self.path)

    def get(self, record_id: str) -> DataFrame:
        return self.scan().where(F.col("record_id") == record_id)

    def count(self) -> int:
        return self.scan().count()


def read_bundles(spark: SparkSession, folder: str, schema: str, exclude: list[str] | None = None) -> DataFrame:
    """Claims of all JSON files of a folder, arrays or one record a line, with doc (the file's stem before __).

    A file or line that is no JSON of this schema, such as an array cut short, fails the read: nothing is left out unsaid.
    """
    strict = {"mode": "FAILFAST"}
    raw = spark.read.text(f"{folder}/*.json*", wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(__.*)?\.jsonl?$", 1).alias("doc"))
    if exclude:
        raw = raw.where(~F.col("doc").isin(exclude))
    array = F.trim("value").startswith("[")
    one = raw.where(array).select("doc", F.posexplode(F.from_json("value", f"array<struct<{schema}>>", strict)).alias("pos", "r"))
    lines = raw.where(~array).select("doc", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(F.trim("line") != "").select("doc", "pos", F.from_json("line", schema, strict).alias("r"))
    return one.unionByName(lines).select("doc", "pos", "r.*")


def canonical_json(df: DataFrame, order: list[str]) -> str:
    """A small table as JSON with sorted keys."""
    rows = [json.loads(r.j) for r in df.orderBy(*order).select(F.to_json(F.struct("*")).alias("j")).collect()]
    return json.dumps(rows, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
