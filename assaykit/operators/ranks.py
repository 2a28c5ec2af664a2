"""Row numbers, ranks and order statistics without a task that sees all rows.

Rows (or counts per distinct value) are sorted in ranges and written once; the ranges'
totals, one row each, are summed in order, and each row adds its range's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def _before(c: str) -> Column:
    """Sum over the ranges before; a window over one row a range."""
    return F.coalesce(F.sum(c).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, *order: str | Column, name: str = "row_no", start: int = 0) -> DataFrame:
    """Adds numbers from ``start`` on in the given order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = cut(ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)))
    starts = held.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", _before("_n")).drop("_n")
    out = held.join(F.broadcast(starts), "_part").withColumn(name, F.col("_base") + F.col("_at") + start)
    return out.drop("_part", "_at", "_base")


def running(df: DataFrame, value: str, *order: str | Column, name: str = "before") -> DataFrame:
    """Adds the sum of a column over the rows before each one in the given order."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = cut(ranged.withColumn("_part", F.shiftright("_at", 33)))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_at")) - F.col(value)
    heads = held.groupBy("_part").agg(F.sum(value).alias("_s")).withColumn("_base", _before("_s")).drop("_s")
    return held.withColumn("_in", inside).join(F.broadcast(heads), "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_part", "_at", "_in", "_base")


def counted(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each distinct value of a group: n, before (rows of the group with smaller values) and size (rows of the group). Nulls go."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    held = cut(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    local = held.withColumn("_upto", F.sum("n").over(Window.partitionBy("_part").orderBy(*by, value)))
    heads = held.groupBy("_part").agg(F.sum("n").alias("_s")).withColumn("_base", _before("_s")).drop("_s")
    placed = local.join(F.broadcast(heads), "_part").withColumn("_from", F.col("_base") + F.col("_upto") - F.col("n"))
    groups = placed.groupBy(*by).agg(F.min("_from").alias("_first"), F.sum("n").alias("size"))
    both = placed.join(groups, list(by)) if by else placed.join(F.broadcast(groups))
    return both.select(*by, value, "n", (F.col("_from") - F.col("_first")).alias("before"), "size")


def at_rank(rank: Column) -> Column:
    """Whether a row of ``counted`` holds the given rank (from 0)."""
    return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
