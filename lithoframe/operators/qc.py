"""Fold, quality counters and distributions of prestack records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.scalar import is_finite
from lithoframe.operators.gathers import offset_bin, with_flags

BINS = 32


def fold_bins(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fold, mean_x, mean_y, offset_min/max, azimuth_min/max) per gather; values that aren't there don't count."""
    mid, off, az = F.col("has_midpoint"), F.when(F.col("has_offset") & is_finite("trace_offset"), F.col("trace_offset")), F.when(F.col("has_azimuth") & is_finite("azimuth"), F.col("azimuth"))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fold"), F.avg(F.when(mid, F.col("midpoint_x"))).alias("mean_x"), F.avg(F.when(mid, F.col("midpoint_y"))).alias("mean_y"),
        F.min(off).alias("offset_min"), F.max(off).alias("offset_max"), F.min(az).alias("azimuth_min"), F.max(az).alias("azimuth_max"),
    )


def fold_stats(bins: DataFrame) -> DataFrame:
    """One row (bins, traces, fold_min, fold_max, fold_mean); nulls and zeros for no bins."""
    return bins.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("fold"), F.lit(0)).alias("traces"), F.min("fold").alias("fold_min"), F.max("fold").alias("fold_max"), F.avg("fold").alias("fold_mean"))


def quality(df: DataFrame, file_count: int, file_interval: int) -> DataFrame:
    """One row of counters over all traces. A missing number counts as a missing source or receiver, and a raw header word of 0 as inconsistent."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    return df.agg(
        F.count(F.lit(1)).alias("traces"),
        n(~F.col("header_valid")).alias("invalid_headers"),
        n(zero("source_id")).alias("missing_ffid"),
        n(zero("source_id") | ~F.col("has_source")).alias("missing_source"),
        n(zero("receiver_id") | ~F.col("has_receiver")).alias("missing_receiver"),
        n(~F.col("has_cdp")).alias("missing_cdp"),
        n(~F.col("has_offset") | ~is_finite("trace_offset")).alias("missing_offset"),
        n(~F.col("has_azimuth")).alias("missing_azimuth"),
        n(~F.col("coordinate_scalar_valid")).alias("scalar_errors"),
        n(F.col("header_sample_count") != file_count).alias("count_inconsistent"),
        n(F.col("header_sample_interval_us") != file_interval).alias("interval_inconsistent"),
        F.count_distinct(offset_bin()).alias("common_offset_bins"),
    )


def histogram(df: DataFrame, value: str, chosen: str | None = None, bins: int = BINS) -> DataFrame:
    """(bin, lo, hi, n[, n_chosen]): equal bins over the finite values, the last one closed; one bin if all are equal, no rows if there are none.

    Every bin has a row. chosen names a boolean column: its rows are counted beside on the same bins.
    """
    known = df.where(is_finite(value)).select(F.col(value).cast("double").alias("v"), *([F.coalesce(F.col(chosen), F.lit(False)).alias("c")] if chosen else []))
    span = known.agg(F.min("v").alias("v0"), F.max("v").alias("v1")).where("v0 IS NOT NULL").withColumn("k", F.when(F.col("v1") > F.col("v0"), F.lit(bins)).otherwise(F.lit(1)))
    span = span.withColumn("w", (F.col("v1") - F.col("v0")) / F.col("k"))
    placed = with_flags(known, span).withColumn("bin", F.when(F.col("w") > 0, F.least(F.floor((F.col("v") - F.col("v0")) / F.col("w")), F.col("k") - 1)).otherwise(F.lit(0)).cast("int"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *([F.count_if("c").alias("n_chosen")] if chosen else []))
    frame = span.select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"), "v0", "w")
    extra = [F.coalesce("n_chosen", F.lit(0)).alias("n_chosen")] if chosen else []
    return frame.join(counts, "bin", "left").select("bin", (F.col("v0") + F.col("bin") * F.col("w")).alias("lo"), (F.col("v0") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), *extra)


def value_range(df: DataFrame, value: str) -> DataFrame:
    """One row (lo, hi, n) over the finite values; nulls if there are none."""
    v = F.when(is_finite(value), F.col(value))
    return df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))


def field_summary(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, total, present, coverage): of each field how many rows satisfy its presence condition."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.expr(c)).alias(f) for f, c in fields.items()))
    stacked = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields)))
    return counts.select("total", stacked.alias("s")).select("s.field", "total", "s.present", F.when(F.col("total") > 0, F.col("s.present") / F.col("total")).alias("coverage"))


def report_rows(section: str, one_row: DataFrame) -> DataFrame:
    """(section, field, value): a one-row aggregate as report lines."""
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in one_row.columns)))
    return one_row.select(fields.alias("s")).select(F.lit(section).alias("section"), "s.field", "s.value")
