"""The central fact table: one row per trace, with presence flags and derived geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.scalar import azimuth_degrees, hypot, is_finite, scaled


def decode_records(headers: DataFrame, offset_mapped: bool = True) -> DataFrame:
    """Typed records of raw header words (source_x_raw ..., coordinate_scalar).

    A header whose sample count or interval is 0 stays as an invalid row that takes the file's values
    file_sample_count and file_sample_interval_us; the raw words remain in header_*.
    """
    s = F.col("coordinate_scalar")
    place = {c: scaled(f"{c}_raw", s) for c in ("source_x", "source_y", "receiver_x", "receiver_y", "cdp_x", "cdp_y")}
    zero_n, zero_dt = F.coalesce(F.col("header_sample_count"), F.lit(0)) == 0, F.coalesce(F.col("header_sample_interval_us"), F.lit(0)) == 0
    return headers.withColumns(
        place
        | {
            "header_valid": ~(zero_n | zero_dt),
            "header_error": F.when(zero_n, "sample count is zero").when(zero_dt, "sample interval is zero"),
            "sample_count": F.when(zero_n, F.col("file_sample_count")).otherwise(F.col("header_sample_count")),
            "sample_interval_us": F.when(zero_dt, F.col("file_sample_interval_us")).otherwise(F.col("header_sample_interval_us")),
            "has_header_offset": F.lit(offset_mapped),
        }
    )


def derive_geometry(df: DataFrame) -> DataFrame:
    """Adds d_has_source, d_has_receiver, d_midpoint_x/y, d_has_midpoint, d_computed_offset, d_azimuth, d_offset, d_has_offset.

    A place is present if it is flagged and finite; (0, 0) is a legal place. The midpoint is half way,
    the azimuth holds for offsets above 0 only, and a header offset wins over a computed one even if 0.
    """
    both = F.col("d_has_source") & F.col("d_has_receiver")
    dx, dy = F.col("receiver_x") - F.col("source_x"), F.col("receiver_y") - F.col("source_y")
    df = df.withColumns({f"d_has_{p}": F.coalesce(F.col(f"has_{p}"), F.lit(False)) & is_finite(f"{p}_x") & is_finite(f"{p}_y") for p in ("source", "receiver")})
    df = df.withColumns(
        {
            "d_has_midpoint": both,
            "d_midpoint_x": F.when(both, (F.col("source_x") + F.col("receiver_x")) / 2),
            "d_midpoint_y": F.when(both, (F.col("source_y") + F.col("receiver_y")) / 2),
            "d_computed_offset": F.when(both, hypot(dx, dy)),
        }
    )
    header = F.coalesce(F.col("has_header_offset"), F.lit(False)) & is_finite("header_offset")
    return df.withColumns(
        {
            "d_azimuth": F.when(F.col("d_computed_offset") > 0, azimuth_degrees(dx, dy)),
            "d_offset": F.when(header, F.col("header_offset")).otherwise(F.col("d_computed_offset")),
            "d_has_offset": header | F.col("d_has_midpoint"),
        }
    )


def uses_grid(df: DataFrame, share: float = 0.9) -> DataFrame:
    """One row (uses_grid, any_cdp): whether inline or crossline is non-zero on so large a share of the traces, and whether any CDP is there. False for an empty table."""
    on = (F.coalesce("inline", F.lit(0)) != 0) | (F.coalesce("crossline", F.lit(0)) != 0)
    return df.agg(
        F.coalesce(F.count_if(on) >= F.count(F.lit(1)) * share, F.lit(False)).alias("on_share"), F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("has_cdp")), F.lit(False)).alias("any_cdp")
    ).select((F.col("on_share") & (F.col("n") > 0)).alias("uses_grid"), "any_cdp")
