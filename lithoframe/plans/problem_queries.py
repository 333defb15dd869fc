"""Queries of the two general training-data problems (points near points or regions, units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators.proximity import containing_ranges, distinct_positions, near_pairs, normal_ranges
from lithoframe.operators.units import common_units, units_sql
from lithoframe.runtime import table

#: Metres within which traces of two lines count as near.
NEAR_M = 15.0
#: Metres per side of a block's cell, the same in both joins, so that they share the blocks.
CELL_M = 64.0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id_a, id_b: traces of different lines at most 15 m apart, and traces inside rectangles."""
    points = distinct_positions(table(spark, sf_dir, "trajectory"), "trace_id", "line")
    ranges = normal_ranges(table(spark, sf_dir, "xy_ranges"))
    near = near_pairs(points, NEAR_M, CELL_M).select(F.lit("near").alias("kind"), "id_a", "id_b")
    inside = containing_ranges(points, ranges, CELL_M).select(F.lit("inside").alias("kind"), "id_a", "id_b")
    return near.unionByName(inside).distinct()


_P1_SQL = """
WITH t AS (SELECT DISTINCT trace_id, line, x, y FROM trajectory WHERE valid AND isfinite(x) AND isfinite(y)),
r AS (SELECT DISTINCT range_id, least(x_min, x_max) AS x0, greatest(x_min, x_max) AS x1, least(y_min, y_max) AS y0, greatest(y_min, y_max) AS y1
      FROM xy_ranges WHERE valid AND isfinite(x_min) AND isfinite(x_max) AND isfinite(y_min) AND isfinite(y_max) AND x_min <> x_max AND y_min <> y_max),
a AS (SELECT *, CAST(floor(x / 15) AS BIGINT) AS cx, CAST(floor(y / 15) AS BIGINT) AS cy FROM t),
b AS (SELECT trace_id, line, x, y, cx + dx AS cx, cy + dy AS cy FROM a, (VALUES (-1), (0), (1)) p(dx), (VALUES (-1), (0), (1)) q(dy))
SELECT DISTINCT 'near' AS kind, a.trace_id AS id_a, b.trace_id AS id_b FROM a JOIN b ON a.cx = b.cx AND a.cy = b.cy
WHERE a.trace_id < b.trace_id AND a.line <> b.line AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 15
UNION
SELECT DISTINCT 'inside', t.trace_id, r.range_id FROM t JOIN r ON t.x BETWEEN r.x0 AND r.x1 AND t.y BETWEEN r.y0 AND r.y1
"""



def p5_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid trace with its position in common units, and whether navigation overruled the records."""
    common = common_units(*(table(spark, sf_dir, t) for t in ("trace_coordinates", "segy_files", "navigation")))
    return common.select("coord_id", F.round("x_exact", 3).alias("x_exact"), F.round("y_exact", 3).alias("y_exact"), "x_common", "y_common", "mended")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coord_id, x_common, y_common of the valid traces whose recorded x or y isn't the common value yet."""
    common = common_units(*(table(spark, sf_dir, t) for t in ("trace_coordinates", "segy_files", "navigation")))
    return common.where("x <> x_common OR y <> y_common").select("coord_id", "x_common", "y_common").distinct()


_P5_SQL = units_sql("trace_coordinates", "segy_files", "navigation", "duckdb")

QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_common": p5_common}
SQL = {
    "p1_found": _P1_SQL,
    "p5_found": f"SELECT DISTINCT coord_id, x_common, y_common FROM ({_P5_SQL}) c WHERE x <> x_common OR y <> y_common",
    "p5_common": f"SELECT coord_id, round(x_exact, 3) AS x_exact, round(y_exact, 3) AS y_exact, x_common, y_common, mended FROM ({_P5_SQL}) c",
}
