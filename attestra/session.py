"""What a session needs so that Python workers can import this package and hold its batches."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Where the C library and Arrow take memory from and give it back to, for Python workers; what a cluster sets goes first.
_WORKERS = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> None:
    """Put a checkout's folder on the workers' path. On a cluster without it, ship the package with --py-files.

    Where Arrow batches have Spark's default of 64 MB at most, they get 8 MB. Workers give the memory of large arrays back at once:
    Spark keeps them from task to task, and what each holds in vain counts against its executor.
    """
    # texts can be long: a batch's bytes are bounded, not only its rows
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if _ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, path) if p)
    for name, value in _WORKERS.items():
        env.setdefault(name, value)
