"""Sources and receivers as points: identity by number or place, links between them, nearest point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.scalar import is_finite
from lithoframe.operators.gathers import with_flags
from lithoframe.operators.ordering import numbered


def _kind(kind: str) -> tuple[str, str, str, str]:
    if kind not in ("source", "receiver"):
        raise ValueError(f"kind is source or receiver, not {kind}")
    return f"{kind}_id", f"{kind}_x", f"{kind}_y", f"has_{kind}"


def id_conflicts(df: DataFrame, kind: str, with_zero: bool = False) -> DataFrame:
    """(id, places): numbers that stand for more than one exact place. Number 0 means none, unless with_zero."""
    i, x, y, has = _kind(kind)
    located = df.where(F.col(has) & F.col(i).isNotNull())
    if not with_zero:
        located = located.where(F.col(i) != 0)
    return located.groupBy(F.col(i).alias("id")).agg(F.count_distinct(F.struct(x, y)).alias("places")).where("places > 1")


def identity_flags(df: DataFrame, kind: str) -> DataFrame:
    """One row (conflict, all_have_ids, uses_coordinates): how points of the kind are told apart."""
    i, _, _, has = _kind(kind)
    named = df.agg(F.coalesce(F.bool_and(F.when(F.col(has), F.coalesce(F.col(i), F.lit(0)) != 0)), F.lit(False)).alias("all_have_ids"))
    both = with_flags(named, id_conflicts(df, kind).agg((F.count(F.lit(1)) > 0).alias("conflict")))
    return both.select("conflict", "all_have_ids", (F.col("conflict") | ~F.col("all_have_ids")).alias("uses_coordinates"))


def points(df: DataFrame, kind: str, by_place: bool) -> DataFrame:
    """(point, id, x, y, traces, first_trace, offset_min, offset_max) of every located point, numbered from 0 as first seen.

    Points without a place are left out; by number, those without a number too.
    """
    i, x, y, has = _kind(kind)
    located = df.where(F.col(has) & is_finite(x) & is_finite(y))
    keys = [F.col(x).alias("kx"), F.col(y).alias("ky")] if by_place else [F.col(i).alias("kid")]
    if not by_place:
        located = located.where(F.coalesce(F.col(i), F.lit(0)) != 0)
    off = F.when(F.col("has_offset"), F.col("trace_offset"))
    out = located.groupBy(*keys).agg(
        F.min_by(i, "trace_number").alias("id"), F.min_by(x, "trace_number").alias("x"), F.min_by(y, "trace_number").alias("y"),
        F.count(F.lit(1)).alias("traces"), F.min("trace_number").alias("first_trace"), F.min(off).alias("offset_min"), F.max(off).alias("offset_max"),
    )
    return out.select("id", "x", "y", "traces", "first_trace", "offset_min", "offset_max")


def links(df: DataFrame) -> DataFrame:
    """(source_id, receiver_id, traces): which source was recorded by which receiver, by number."""
    return df.where("source_id <> 0 AND receiver_id <> 0").groupBy("source_id", "receiver_id").agg(F.count(F.lit(1)).alias("traces"))


def counterparts(df: DataFrame, kind: str, together: int = 4096) -> DataFrame:
    """(id, part, others, n_others): the sorted numbers at the other end of each source's or receiver's traces, at most `together` a row; parts from 0, in order."""
    i, other = ("source_id", "receiver_id") if kind == "source" else ("receiver_id", "source_id")
    each = numbered(links(df).select(F.col(i).alias("id"), F.col(other).alias("other")), ["id", "other"])
    first = each.groupBy("id").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("n_others"))
    placed = each.join(first, "id").withColumn("part", F.floor((F.col("n") - F.col("first")) / together))
    return placed.groupBy("id", "part", "n_others").agg(F.sort_array(F.collect_list("other")).alias("others")).select("id", "part", "others", "n_others")


def nearest_points(queries: DataFrame, pts: DataFrame, max_distance: float) -> DataFrame:
    """(qid, first_trace, distance): for each query (qid, x, y) the nearest point within the distance; ties take the first seen.

    Cells as wide as the distance make it an equi-join: a query looks at its own and the eight cells around it.
    """
    cell = lambda c: F.floor(F.col(c) / max_distance)
    q = queries.select("qid", F.col("x").alias("qx"), F.col("y").alias("qy")).where(is_finite("qx") & is_finite("qy"))
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    q = q.select("qid", "qx", "qy", F.explode(around).alias("d")).select("qid", "qx", "qy", (cell("qx") + F.col("d.i")).alias("cx"), (cell("qy") + F.col("d.j")).alias("cy"))
    p = pts.select("first_trace", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    near = q.join(p, ["cx", "cy"]).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= max_distance)
    return near.groupBy("qid").agg(F.min(F.struct("distance", "first_trace")).alias("m")).select("qid", F.col("m.first_trace").alias("first_trace"), F.col("m.distance").alias("distance"))
