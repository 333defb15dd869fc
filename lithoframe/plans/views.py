"""Domain views of the test tables, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.runtime import table

RECORD_COLUMNS = (
    "record_id line trace_number source_id receiver_id cdp trace_in_field inline crossline source_x source_y receiver_x receiver_y midpoint_x midpoint_y has_source has_receiver has_midpoint "
    "has_computed_offset has_azimuth header_offset computed_offset trace_offset azimuth has_header_offset has_cdp has_offset coordinate_units coordinate_scalar delay_ms sample_interval_us sample_count "
    "header_valid header_error header_sample_count header_sample_interval_us coordinate_scalar_valid coordinate_scalar_error recorded_at"
).split()
RECORD_B_COLUMNS = (
    "record_id line_label trace_number source_id receiver_id cdp source_x source_y receiver_x receiver_y has_source has_receiver has_cdp trace_offset has_offset azimuth has_azimuth delay_ms sample_interval_us recorded_at"
).split()

#: Opens a SQL oracle over the records of both sources, each record once.
REC = f"WITH rec AS (SELECT DISTINCT {', '.join(RECORD_COLUMNS)} FROM prestack_records), recb AS (SELECT DISTINCT {', '.join(RECORD_B_COLUMNS)} FROM prestack_records_b)"
#: Opens a SQL oracle over sampled traces: 64 samples each, on a grid of 25 crosslines.
TRC = (
    "WITH trc AS (SELECT vec_id AS trace, CAST(embedding AS DOUBLE[]) AS samples, 1000 + vec_id // 25 AS il, 2000 + vec_id % 25 AS xl FROM embeddings), "
    "trb AS (SELECT vec_id - 1 AS trace, CAST(embedding AS DOUBLE[]) AS samples FROM embeddings WHERE vec_id >= 1), "
    "smp AS MATERIALIZED (SELECT trace, il, xl, s AS sample, samples[s + 1] AS v FROM trc, generate_series(0, 63) g(s)), smb AS (SELECT trace, s AS sample, samples[s + 1] AS v FROM trb, generate_series(0, 63) g(s))"
)
#: Opens a SQL oracle over the valid positions of lines, each trace once.
TRJ = "WITH trj AS (SELECT line, trace, min(cdp) AS cdp, bool_or(has_cdp) AS has_cdp, min(x) AS x, min(y) AS y FROM trajectory WHERE valid AND isfinite(x) AND isfinite(y) GROUP BY line, trace)"
#: Opens a SQL oracle over control points, copies averaged.
NAV = "WITH nav AS (SELECT line, trace, avg(x) AS x, avg(y) AS y FROM navigation GROUP BY line, trace)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prestack_records").select(*RECORD_COLUMNS).distinct()


def records_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prestack_records_b").select(*RECORD_B_COLUMNS).distinct()


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace, samples, il, xl): 64 samples at 2000 us."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("trace"), F.col("embedding").cast("array<double>").alias("samples"), (F.floor(F.col("vec_id") / 25) + 1000).alias("il"), (F.col("vec_id") % 25 + 2000).alias("xl"))


def traces_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second volume: on each place the samples of the next trace."""
    e = table(spark, sf_dir, "embeddings").where("vec_id >= 1")
    return e.select((F.col("vec_id") - 1).alias("trace"), F.col("embedding").cast("array<double>").alias("samples"))


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, trace, cdp, has_cdp, x, y) of the valid positions, each trace once."""
    t = table(spark, sf_dir, "trajectory").where("valid AND NOT isnan(x) AND NOT isnan(y) AND abs(x) < double('Infinity') AND abs(y) < double('Infinity')")
    return t.groupBy("line", "trace").agg(F.min("cdp").alias("cdp"), F.bool_or("has_cdp").alias("has_cdp"), F.min("x").alias("x"), F.min("y").alias("y"))


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, trace, x, y) of the control points, copies averaged."""
    return table(spark, sf_dir, "navigation").groupBy("line", "trace").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
