"""Regular grids of inlines and crosslines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.operators.gathers import with_flags
from lithoframe.operators.ordering import surrounded


def _ranks(df: DataFrame, axis: str, name: str) -> DataFrame:
    """(axis, name): rank from 0 of each distinct value. The window runs over distinct axis values, which are as many as a survey has lines."""
    return df.select(axis).distinct().select(axis, (F.row_number().over(Window.orderBy(axis)) - 1).alias(name))


def grid_index(df: DataFrame, il: str = "inline", xl: str = "crossline") -> DataFrame:
    """(trace_number, il, xl, row, col) of every trace on the grid; (0, 0) and nulls mean no place."""
    on = df.where(f"{il} IS NOT NULL AND {xl} IS NOT NULL AND NOT ({il} = 0 AND {xl} = 0)").select("trace_number", F.col(il).alias("il"), F.col(xl).alias("xl"))
    return on.join(_ranks(on, "il", "row"), "il").join(_ranks(on, "xl", "col"), "xl").select("trace_number", "il", "xl", "row", "col")


def grid_summary(index: DataFrame, max_duplicates: float = 0.1) -> DataFrame:
    """One row (traces, inlines, crosslines, duplicates, usable, post_stack): usable from four traces and two lines each way on."""
    s = index.agg(F.count(F.lit(1)).alias("traces"), F.count_distinct("il").alias("inlines"), F.count_distinct("xl").alias("crosslines"), (F.count(F.lit(1)) - F.count_distinct("il", "xl")).alias("duplicates"))
    return s.withColumn("usable", F.expr("traces >= 4 AND inlines >= 2 AND crosslines >= 2")).withColumn("post_stack", F.expr(f"usable AND duplicates <= {max_duplicates} * traces"))


def first_per_cell(index: DataFrame) -> DataFrame:
    """(il, xl, trace_number): the first trace of each cell."""
    return index.groupBy("il", "xl").agg(F.min("trace_number").alias("trace_number"))


def nearest_value(values: DataFrame, column: str, target: float) -> DataFrame:
    """One row (value): the value nearest to the target, the lower one at a tie; targets beyond the ends give the end value."""
    return values.agg(F.min(F.struct(F.abs(F.col(column) - target).alias("d"), F.col(column).alias("value"))).alias("m")).select("m.value")


def line_traces(index: DataFrame, axis: str, target: float) -> DataFrame:
    """(trace_number, across, position) along the line nearest to the target, first trace per cell, ordered across."""
    across = "xl" if axis == "il" else "il"
    cells = first_per_cell(index)
    on_line = with_flags(cells, nearest_value(cells, axis, target)).where(F.col(axis) == F.col("value"))
    return on_line.select("trace_number", F.col(across).alias("across"), (F.row_number().over(Window.orderBy(across)) - 1).alias("position"))


def trace_at(index: DataFrame, il: int, xl: int) -> DataFrame:
    """(trace_number): the first trace of a cell, null if it is empty."""
    return index.where((F.col("il") == il) & (F.col("xl") == xl)).agg(F.min("trace_number").alias("trace_number"))


def nearest_rank(ranks: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, rank): rank of the axis value nearest to each query's target, -1 outside the axis, the lower one at a tie.

    ranks (value, rank) is merged with the queries: each query looks at the last value before and the
    first one after it.
    """
    both = ranks.select(F.col("value").cast("double").alias("v"), F.col("rank").cast("int").alias("rank"), F.lit(None).cast("bigint").alias("qid")).unionByName(
        queries.select(F.col("target").cast("double").alias("v"), F.lit(None).cast("int").alias("rank"), "qid")
    )
    merged = surrounded(both, ["v"], F.when(F.col("rank").isNotNull(), F.struct("v", "rank")), "lo", "hi").where("qid IS NOT NULL")
    # equal values tie, so a query may stand on either side of its own: looking both ways meets it
    nearest = F.when(F.col("lo").isNull() | F.col("hi").isNull(), F.when(F.coalesce("lo.v", "hi.v") == F.col("v"), F.coalesce("lo.rank", "hi.rank")).otherwise(F.lit(-1))).when(F.col("v") - F.col("lo.v") <= F.col("hi.v") - F.col("v"), F.col("lo.rank")).otherwise(F.col("hi.rank"))
    return merged.select("qid", nearest.alias("rank"))


def bounds(index: DataFrame) -> DataFrame:
    return index.agg(F.min("il").alias("il0"), F.max("il").alias("il1"), F.min("xl").alias("xl0"), F.max("xl").alias("xl1"))


def union_bounds(a: DataFrame, b: DataFrame) -> DataFrame:
    """The smallest box around two boxes; an empty one adds nothing."""
    return a.unionByName(b).agg(F.min("il0").alias("il0"), F.max("il1").alias("il1"), F.min("xl0").alias("xl0"), F.max("xl1").alias("xl1"))


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def in_box(index: DataFrame, il: tuple[int, int], xl: tuple[int, int]) -> DataFrame:
    """Traces inside a box of lines, edges included, ends in either order."""
    return index.where(F.col("il").between(min(il), max(il)) & F.col("xl").between(min(xl), max(xl)))


def cell_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_trace, b_trace, il, xl): every trace of A with the first trace of B in its cell."""
    return a.select(F.col("trace_number").alias("a_trace"), "il", "xl").join(first_per_cell(b).withColumnRenamed("trace_number", "b_trace"), ["il", "xl"])


def places(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(trace_number, il, xl, row, col) of wanted traces (trace_number); those without a place have none."""
    return index.join(wanted.select("trace_number").distinct(), "trace_number")
