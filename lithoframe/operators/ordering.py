"""Total orders of any number of rows: numbering and neighbours without a window that one task has to hold.

The rows are parted by ranges of the order and sorted; what one range has to know of the others (its
rows before, the last value before, the first one after) is a row per range, so as many rows as
shuffle partitions. The sorted rows are written to the shared folder, as both steps have to see the
same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.runtime import durable


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with _p (range) and _i (place within it, from 0)."""
    place = F.monotonically_increasing_id()
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(parted.select("*", F.spark_partition_id().alias("_p"), place.bitwiseAND((1 << 33) - 1).alias("_i")))


def numbered(df: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """Adds the place of each row in the order, from 0 without gaps. Rows that tie are numbered in any order, so name enough columns."""
    rows = _ranged(df, [F.col(c) if isinstance(c, str) else c for c in order])
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_b"))
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def accumulated(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Adds the sum of a column from the first row of the order through each row."""
    rows = _ranged(df, [F.col(c) if isinstance(c, str) else c for c in order])
    sums = rows.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = sums.select("_p", (F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_b"))
    within = F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_w", within).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_w")).drop("_p", "_i", "_b", "_w")


def surrounded(df: DataFrame, order: list[Column | str], value: Column, before: str = "before", after: str = "after") -> DataFrame:
    """Adds the last value that isn't null at or before each row of the order, and the first one at or after it; null beyond the ends."""
    rows = _ranged(df.withColumn("_v", value), [F.col(c) if isinstance(c, str) else c for c in order])
    here = Window.partitionBy("_p").orderBy("_i")
    within = rows.withColumns({"_l": F.last("_v", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)), "_f": F.last("_v", ignorenulls=True).over(Window.partitionBy("_p").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0))})
    ends = rows.where("_v IS NOT NULL").groupBy("_p").agg(F.max_by("_v", "_i").alias("_last"), F.min_by("_v", "_i").alias("_first"))
    every = rows.select("_p").distinct().join(ends, "_p", "left")
    last = F.last("_last", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    first = F.last("_first", ignorenulls=True).over(Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1))
    carried = every.select("_p", last.alias("_cl"), first.alias("_cf"))
    met = within.join(F.broadcast(carried), "_p")
    return met.withColumns({before: F.coalesce("_l", "_cl"), after: F.coalesce("_f", "_cf")}).drop("_p", "_i", "_v", "_l", "_f", "_cl", "_cf")
