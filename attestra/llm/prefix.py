"""Running sums over rows in order, none of which passes through one task.

Rows are sorted over ranges of (group, order); each range adds up its own rows, and the sums of the ranges before it, a row for each
range and group, are added on top. So a group of any share of all rows lies in as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm import staging


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, str], name: str = "ranges") -> DataFrame:
    """rows with a column for each of sums (new name: column, or "1" to count): the sum over the rows before it in its group.

    group has no nulls. Nulls of order come first; rows that are equal in order are told apart by their place in the input, so that
    a value that many rows share is dealt over tasks, too. The sorted rows are staged, hence a lost executor can't sort them anew into
    other ranges.
    """
    by = [*group, *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by) if by else rows
    held = staging.staged(ranged.sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()), name)
    value = lambda c: F.lit(1).cast("long") if c == "1" else F.col(c)
    parts = held.groupBy(*group, "_range").agg(*[F.sum(value(c)).alias(f"_{new}") for new, c in sums.items()])
    # as many rows as there are ranges, and one more for each further group of a range
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({f"_{new}": F.coalesce(F.sum(f"_{new}").over(earlier), F.lit(0)) for new in sums})
    inside = Window.partitionBy(*group, "_range").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    own = held.withColumns({new: F.coalesce(F.sum(value(c)).over(inside), F.lit(0)) for new, c in sums.items()})
    met = own.join(parts, [*group, "_range"])
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(new) + F.col(f"_{new}")).alias(new) for new in sums])
