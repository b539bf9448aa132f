"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.session import prepare as prepare


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master, where it is unset, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only tasks of the job at hand, since the table outlives it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_staged_path", None)
        if path:
            spark = SparkSession.getActiveSession()
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def packed(columns: list[str]) -> Column:
    """These columns, whatever their names, as one struct for a job that passes them on."""
    return F.struct(F.lit(0).alias("none"), *[F.col(f"`{c.replace('`', '``')}`").alias(f"c{i}") for i, c in enumerate(columns)])


def unpacked(columns: list[str], struct: str = "rest") -> dict[str, Column]:
    """What packed took, by name."""
    return {c: F.col(f"{struct}.c{i}").alias(c) for i, c in enumerate(columns)}
